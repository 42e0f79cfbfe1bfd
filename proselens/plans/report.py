"""From documents to a report: extraction, sentences, tokens, measures, findings, scores; and its printed forms."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.operators import measures as M
from proselens.operators import rules as R
from proselens.operators import score as S
from proselens.operators.lexicon import tokenize, with_tokens
from proselens.operators.split import number, split_sentences
from proselens.operators.tally import tallies
from proselens.rulesdata import HEADINGS, LAYERS, RULE_ORDER
from proselens.settings import Settings
from proselens.sources import files

RATIOS = ("polite_ratio", "plain_ratio", "wago_noun_ratio", "wago_verb_ratio", "final_wago_ratio", "ga_per_sentence")


@dataclass
class Report:
    settings: Settings
    documents: DataFrame  # doc_id, name
    sentences: DataFrame
    tallied: DataFrame
    findings: DataFrame

    def scores(self) -> DataFrame:
        """A row a document, also those without a sentence."""
        rows = S.document_scores(self.tallied, self.settings.weights, self.settings.floor)
        every = self.documents.join(rows, "doc_id", "left").join(self.tallied.select("doc_id", *RATIOS), "doc_id", "left")
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("ja_chars", "sentences")}
        return every.withColumns(zero | {"mode": F.coalesce("mode", F.lit("count_only")), "by_rule": F.coalesce("by_rule", F.expr("cast(map() as map<string,bigint>)"))})

    def total(self) -> DataFrame:
        return S.grand_total(self.tallied, self.settings.weights, self.settings.floor)

    def exceeds(self, threshold: float) -> bool:
        return not self.scores().filter(S.exceeds(threshold)).isEmpty() or not self.total().filter(S.exceeds(threshold)).isEmpty()

    def located(self) -> DataFrame:
        """Findings with the lines of the segment they stand in, in order."""
        where = self.sentences.select("doc_id", "sent_id", "path", "line_start", "line_end", "commit")
        return self.findings.join(where, ["doc_id", "sent_id"]).orderBy("doc_id", "phase", F.when(F.col("phase") == 0, F.col("sent_id")), "rule_ord", "span_ord")


def sentences_of(segments: DataFrame, backend: Callable = tokenize) -> DataFrame:
    segments = segments if "commit" in segments.columns else segments.withColumn("commit", F.lit(None).cast("string"))
    return number(with_tokens(split_sentences(segments), backend))


def report(segments: DataFrame, documents: DataFrame, settings: Settings | None = None, backend: Callable = tokenize) -> Report:
    settings = settings or Settings()
    sentences = sentences_of(segments, backend)
    facts = M.sentence_facts(sentences)
    measured = M.document_measures(facts)
    return Report(settings, documents.select("doc_id", "name"), sentences, tallies(sentences, settings.lists, settings.floor), R.findings(sentences, measured, M.final_words(facts), settings.lists, settings.floor))


def check(spark: SparkSession, paths: list[str], settings: Settings | None = None) -> tuple[Report, DataFrame]:
    """The report over files and folders, and the warnings."""
    settings = settings or Settings.load(start=paths[0] if paths else ".")
    docs, warnings = files.read_files(spark, paths, settings)
    segments = files.extract_documents(docs)
    kept = docs.join(segments.select("doc_id").distinct(), "doc_id", "left_semi")
    return report(segments, kept, settings), warnings


def bench(spark: SparkSession, path: str, settings: Settings | None = None) -> tuple[DataFrame, bool]:
    """Scores and verdicts of a manifest's sets, in one plan over all of them, and whether none is violated."""
    from proselens.sources import messages

    settings = settings or Settings.load(start=path)
    sets, parts, members, base = files.manifest(path), [], [], 0
    for s in sets:
        if s.commits is not None:
            with open(s.commits, encoding="utf-8", errors="replace") as f:
                log = one = spark.createDataFrame([(0, f.read())], "log_id int, log string")
            records = messages.log_records(log, ["log_id"])
            rows = messages.message_segments(records.select((F.col("k") + base).cast("long").alias("doc_id"), "message", F.col("hash").alias("path")), ["doc_id", "path"])
            own = rows.select("doc_id", "path", "seg_id", "kind", "text", "line_start", "line_end")
        else:
            docs, _ = files.read_files(spark, list(s.paths), settings)
            own = files.extract_documents(docs.withColumn("doc_id", F.col("doc_id") + base))
        parts.append(own)
        members.append(own.select(F.lit(s.name).alias("set_name"), "doc_id").distinct())
        base += 1 << 40
    segments, membership = parts[0], members[0]
    for p, m in zip(parts[1:], members[1:]):
        segments, membership = segments.unionByName(p), membership.unionByName(m)
    made = report(segments, segments.select("doc_id", F.col("path").alias("name")).distinct(), settings)
    known = spark.createDataFrame([(s.name, s.side, s.judge, k) for k, s in enumerate(sets)], "set_name string, side string, judge boolean, set_ord int")
    scores = known.join(S.set_scores(made.tallied, membership, settings.weights, settings.floor), "set_name", "left")
    scores = scores.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("ja_chars", "sentences")}).withColumn("verdict", S.verdict(settings.floor))
    return scores, scores.filter("verdict = 'violated'").isEmpty()


# --- printed forms, on the driver: a report is what a person reads


def _mode(row) -> dict:
    if row["mode"] == "count_only":
        return {"kind": "count_only"}
    return {"kind": "normalized", "per_1000": row["per_1000"], "by_layer": {n: row["by_layer"][n] for n in LAYERS.values() if n in row["by_layer"]}}


def _score(row) -> dict:
    return {"ja_chars": row["ja_chars"], "sentences": row["sentences"], "mode": _mode(row), "by_rule": {r: row["by_rule"][r] for r in RULE_ORDER if r in row["by_rule"]}}


def to_json(r: Report, summary: bool = False) -> str:
    found: dict[int, list[dict]] = {}
    if not summary:
        for f in r.located().toLocalIterator():
            origin = {"path": f.path, "lines": {"start": f.line_start, "end": f.line_end}, "commit": f["commit"]}
            found.setdefault(f.doc_id, []).append({"rule": f.rule, "layer": f.layer, "origin": origin, "excerpt": f.excerpt, "hint": f.hint})
    docs = []
    for row in r.scores().orderBy("doc_id").toLocalIterator():
        score = _score(row) | {"measures": {k: row[k] for k in RATIOS}, "findings": None if summary else found.get(row.doc_id, [])}
        docs.append({"name": row["name"], "score": score})
    return json.dumps({"documents": docs, "total": _score(r.total().first())}, ensure_ascii=False, indent=2)


def point_line(row) -> str:
    head = f"{row['ja_chars']} 字  {row['sentences']} 文  "
    if row["mode"] == "count_only":
        return head + f"指摘 {sum(row['by_rule'].values())} 件"
    layers = "、".join(f"{n} {row['by_layer'][n]:.1f}" for n in LAYERS.values() if n in row["by_layer"])
    return head + f"正規化 {row['per_1000']:.1f} 点（{layers}）"


def to_text(r: Report, summary: bool = False) -> str:
    lines = [] if summary else [f"{f.path}:{f.line_start}: {f.rule} {f.excerpt}  {f.hint}" for f in r.located().toLocalIterator()]
    lines += [f"{row['name']}: {point_line(row)}" for row in r.scores().orderBy("doc_id").toLocalIterator()]
    return "\n".join([*lines, f"合計: {point_line(r.total().first())}"])


def aligned(rows: list[list[str]]) -> str:
    """Columns padded to their widest cell, the first to the left, the others to the right; characters beyond ASCII are two wide."""
    width = lambda s: sum(1 if c.isascii() else 2 for c in s)
    widest = [max(map(width, column)) for column in zip(*rows)]
    pad = lambda k, c, w: c + " " * (w - width(c)) if k == 0 else " " * (w - width(c)) + c
    return "\n".join("  ".join(pad(k, c, w) for k, (c, w) in enumerate(zip(row, widest))).rstrip() for row in rows)


# The words of the printed forms.
EMPTY, REFERENCE, BELOW = "集合が空", "参考", "下限未満"
HEAD = ["集合", "側", "文字数", "文数", "点"]
MET, UNMET = "受け入れ基準を満たす", "受け入れ基準を満たさない"


def bench_text(scores: DataFrame, met: bool) -> str:
    """The sets' points, their rates by rule, and the judgment."""
    rows, points, rates, notes = scores.orderBy("set_ord").collect(), [[*HEAD, *LAYERS.values()]], [["集合", *RULE_ORDER]], []  # a manifest's sets
    for r in rows:
        own = [r["set_name"], r["side"], str(r["ja_chars"]), str(r["sentences"])]
        if r["mode"] == "normalized":
            points.append([*own, f"{r['per_1000']:.2f}", *(f"{(r['by_layer'] or {}).get(n, 0.0):.2f}" for n in LAYERS.values())])
        else:
            points.append([*own, EMPTY if r["verdict"] == "empty" else BELOW, *("-" for _ in LAYERS)])
        found = r["by_rule"] or {}
        rates.append([r["set_name"], *(f"{found.get(k, 0) * 1000 / r['ja_chars'] if r['ja_chars'] else 0.0:.1f}" for k in RULE_ORDER)])
    notes = [f"  {r['set_name']}  {r['side']}  {r['per_1000']:.2f} 点" for r in rows if r["verdict"] == "violated"]
    for r in rows:
        if r["verdict"] == "empty":
            notes.append(f"  {EMPTY}  {r['set_name']}")
        elif r["verdict"] == "reference":
            notes.append(f"  {REFERENCE}  {r['set_name']}  {r['side']}" + (f"  {r['per_1000']:.2f} 点" if r["per_1000"] is not None else ""))
    return "\n".join([aligned(points), "", aligned(rates), "", MET if met else UNMET, *notes])


def rules_text(settings: Settings | None = None) -> str:
    """A line a rule: id, layer, weight, heading."""
    weights = (settings or Settings()).weights
    return "\n".join(f"{r}  {LAYERS[r[0]]}  {weights[r]:.2f}  {HEADINGS[r]}" for r in RULE_ORDER)


def of_segments(segments: DataFrame, settings: Settings | None = None) -> Report:
    """The report over segments that are there already: messages and diffs."""
    return report(segments, segments.select("doc_id", F.col("path").alias("name")).distinct(), settings)
