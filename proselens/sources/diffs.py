"""Intervals of lines, and unified diffs as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselens.functions.text import has_japanese, touches

#: Lines of a bucket of the interval join.
BUCKET = 64


def touched(segments: DataFrame, added: DataFrame, key: list[str]) -> DataFrame:
    """Segments (key, line_start, line_end) that share a line with an added range (key, start, end).

    Both sides are cut into buckets of lines, so that the join has an equality on key and bucket and no task
    compares all ranges of a long file with all its segments.
    """
    bucket = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div {BUCKET}"), F.expr(f"{b} div {BUCKET}")))
    left = segments.withColumn("_b", bucket("line_start", "line_end"))
    right = added.select(*key, "start", "end", bucket("start", "end").alias("_b"))
    s, a = left.alias("s"), right.alias("a")
    same = F.lit(True)
    for k in [*key, "_b"]:
        same = same & (F.col(f"s.{k}") == F.col(f"a.{k}"))
    met = s.join(a, same & touches(F.col("s.line_start"), F.col("s.line_end"), F.col("a.start"), F.col("a.end")), "left_semi")
    return met.drop("_b").dropDuplicates()


def outermost(spans: DataFrame, key: list[str], start: str, end: str, tie: str | None = None) -> DataFrame:
    """By start, the longest first: spans that reach beyond all before them."""
    order = [F.col(start), F.col(end).desc()] + ([F.col(tie)] if tie else [])
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max(end).over(before)).filter("_reach is null or " + f"`{end}` > _reach").drop("_reach")


def merged(comments: DataFrame, key: list[str]) -> DataFrame:
    """Comments on consecutive lines as one: key, line_start, line_end, text."""
    by = Window.partitionBy(*key).orderBy("line_start")
    new = F.coalesce((F.lag("line_end").over(by) + 1 != F.col("line_start")).cast("int"), F.lit(1))
    rows = comments.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by))
    ordered = F.array_sort(F.collect_list(F.struct("line_start", "text")))
    found = rows.groupBy(*key, "_run").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
    return found.drop("_run")


def added_range(line: Column) -> Column:
    """Of a hunk header, struct<start, end> of the lines it adds, or null."""
    pattern = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    start, count = F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)
    start, count = start.try_cast("int"), F.when(count == "", F.lit(1)).otherwise(count.try_cast("int"))
    return F.when((start > 0) & (count > 0), F.struct(start.alias("start"), (start + count - 1).cast("int").alias("end")))


def changes(diff: DataFrame, key: list[str], text_col: str = "diff") -> DataFrame:
    """Unified diffs (`-U0`) to rows of key, path, start, end: the added ranges of each file.

    A file begins at `diff --git`; its path stands above its first hunk, so body lines that look like headers
    are none. The file's number and whether a hunk has begun are running sums over the lines.
    """
    lines = diff.select(*key, F.posexplode(F.split(text_col, "\n")).alias("k", "line"))
    by = Window.partitionBy(*key).orderBy("k")
    rows = lines.withColumn("_file", F.sum(F.startswith("line", F.lit("diff --git ")).cast("int")).over(by))
    hunk = F.startswith("line", F.lit("@@ "))
    rows = rows.withColumn("_hunks", F.sum(hunk.cast("int")).over(Window.partitionBy(*key, "_file").orderBy("k")))
    path = F.when((F.col("_hunks") == 0) & F.startswith("line", F.lit("+++ b/")), F.regexp_replace(F.substring("line", 7, 1 << 20), "\t+$", ""))
    ranges = rows.select(*key, "_file", "k", path.alias("path"), F.when(hunk, added_range(F.col("line"))).alias("r"))
    whole = Window.partitionBy(*key, "_file")
    found = ranges.withColumn("path", F.first("path", ignorenulls=True).over(whole)).filter("r is not null and path is not null")
    return found.select(*key, "path", "r.start", "r.end")


def change_segments(segments: DataFrame, added: DataFrame, commit: str | None = None) -> DataFrame:
    """Of the segments (doc_id, path, .., text, line_start, line_end) of changed files those that share a line with a range their diff adds
    (path, start, end), stamped with the commit; files none of whose touched segments holds Japanese go."""
    met = touched(segments, added.select("path", "start", "end"), ["path"])
    japanese = met.filter(has_japanese(F.col("text"))).select("doc_id").distinct()
    return met.join(japanese, "doc_id", "left_semi").withColumn("commit", F.lit(commit).cast("string"))
