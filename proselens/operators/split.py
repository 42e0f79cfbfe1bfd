"""Bold spans and sentence splitting.

Where a text has no backtick and no line end, which is nearly always, the bold spans come from pieces between
markers, in the JVM. The rest, and splitting, need a scanner with memory; that is an Arrow function.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselens.functions import text as T
from proselens.shipping import ship

#: Unicode White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
JA = re.compile("[々〆ぁ-ゟ゠-ヿ一-鿿]")
CLOSER = {"「": "」", "『": "』", "（": "）"}
EVENT = re.compile(r"\*\*|[\n`「」『』（）。！？]")


def scan_bold(text: str) -> list[tuple[int, int]]:
    """Spans from marker to marker; none in code spans, and an open marker is forgotten at a blank line."""
    out, opened, code, line = [], None, False, 0
    for m in re.finditer(r"\*\*|[\n`]", text):
        c, at = m[0], m.start()
        if c == "\n":
            if not text[line:at].strip(SPACES):
                opened, code = None, False
            line = at + 1
        elif c == "`":
            code = not code
        elif not code:
            if opened is None:
                opened = at
            else:
                out.append((opened, m.end()))
                opened = None
    return out


def split_text(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a segment that hold Japanese, trimmed."""
    bold = scan_bold(text)
    starts = [s for s, _ in bold]
    out: list[tuple[int, int]] = []
    closers: list[str] = []
    code, begin, line = False, 0, 0

    def add(end: int) -> None:
        s, e = begin, end
        while s < e and text[s] in SPACES:
            s += 1
        while e > s and text[e - 1] in SPACES:
            e -= 1
        if JA.search(text, s, e):
            out.append((s, e))

    for m in EVENT.finditer(text):
        c, at = m[0], m.start()
        if c == "**":
            continue
        k = bisect_right(starts, at) - 1
        bolded = k >= 0 and at < bold[k][1]
        if c == "\n":
            blank = not text[line:at].strip(SPACES)
            line = at + 1
            if blank:
                closers, code = [], False
            elif closers or code or bolded:
                continue
            add(at)
            begin = at + 1
        elif bolded:
            continue
        elif c == "`":
            code = not code
        elif code:
            continue
        elif c in CLOSER:
            closers.append(CLOSER[c])
        elif closers:
            if closers[-1] == c:
                closers.pop()
        elif c in T.TERMINATORS:
            add(at + 1)
            begin = at + 1
    add(len(text))
    return out


def bold_spans(text: Column) -> Column:
    """Every second marker closes what the one before opened; a backtick or a line end can change that, so texts with either are scanned."""

    def paired(marks: Column) -> Column:
        pair = lambda k: T.span(F.get(marks, 2 * k)["s"], F.get(marks, 2 * k + 1)["e"])
        return F.when(F.size(marks) > 1, F.transform(F.sequence(F.lit(0), F.floor(F.size(marks) / 2).cast("int") - 1), pair)).otherwise(T.no_spans())

    scanned = F.when(text.rlike("[`\\n]"), _scan_native(text)).otherwise(T.let(T.occurrences(text, "**"), paired))
    return F.when(F.contains(text, F.lit("**")), scanned).otherwise(T.no_spans())


def _scan_native(text: Column) -> Column:
    """The scanner as a fold over its events, in the JVM: markers, backticks and line ends in order."""
    events = F.array_sort(
        F.concat(
            F.transform(T.occurrences(text, "**"), lambda x: F.struct(x["s"].alias("s"), F.lit("*").alias("c"))),
            F.transform(T.occurrences(text, "`"), lambda x: F.struct(x["s"].alias("s"), F.lit("`").alias("c"))),
            F.transform(T.occurrences(text, "\n"), lambda x: F.struct(x["s"].alias("s"), F.lit("n").alias("c"))),
        )
    )
    start = F.struct(F.lit(-1).alias("open"), F.lit(False).alias("code"), F.lit(0).alias("line"), T.no_spans().alias("out"))

    def step(a: Column, x: Column) -> Column:
        blank = T.trim(F.substring(text, a["line"] + 1, x["s"] - a["line"])) == ""
        end, tick, mark = x["c"] == "n", x["c"] == "`", (x["c"] == "*") & ~a["code"]
        closes = mark & (a["open"] >= 0)
        return F.struct(
            F.when((end & blank) | closes, -1).when(mark, x["s"]).otherwise(a["open"]).alias("open"),
            F.when(end & blank, False).when(tick, ~a["code"]).otherwise(a["code"]).alias("code"),
            F.when(end, x["s"] + 1).otherwise(a["line"]).alias("line"),
            F.when(closes, F.concat(a["out"], F.array(T.span(a["open"], x["s"] + 2)))).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(events, start, step)["out"]


def split_sentences(segments: DataFrame) -> DataFrame:
    """segments (doc_id, seg_id, kind, text, and more) to a row a sentence: sent_id in its segment, s, e, text, seg_text."""
    ship(segments.sparkSession)

    @F.pandas_udf(T.SPANS)
    def sentences(texts):
        return texts.map(lambda t: [{"s": s, "e": e} for s, e in split_text(t)] if t else [])

    rows = segments.filter(T.has_japanese(F.col("text"))).withColumnRenamed("text", "seg_text")
    rows = rows.select("*", F.posexplode(sentences("seg_text")).alias("in_seg", "x"))
    return rows.select(*[c for c in rows.columns if c not in ("x",)], F.col("x.s").alias("s"), F.col("x.e").alias("e"), T.cut(F.col("seg_text"), F.col("x")).alias("text")).drop("x")


def number(sentences: DataFrame) -> DataFrame:
    """After cells without a predicate are gone: sent_id over the document, and whether a line end parts a sentence from the one before."""
    by_doc = Window.partitionBy("doc_id").orderBy("seg_id", "in_seg")
    gap = F.lag("e").over(Window.partitionBy("doc_id", "seg_id").orderBy("in_seg"))
    between = F.substring(F.col("seg_text"), gap + 1, F.col("s") - gap)
    return sentences.withColumn("sent_id", F.row_number().over(by_doc) - 1).withColumn("newline_before", F.coalesce(F.contains(between, F.lit("\n")), F.lit(False)))
