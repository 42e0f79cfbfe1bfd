"""Exact deduplication by skew-safe combining, native operators only.

Equal texts meet in three steps, each comparing the whole content and not only its digest: every
input task merges its own copies (the partial aggregate), salted groups merge what the tasks left,
and the winners of all salts merge into one class. A text that a third of all rows share so arrives
as one row per task, then as one row per salt.

Defined results: null text counts as empty; an empty table gives no rows; of equal texts the
smallest id stays and a null id stays only if no other id has that text; rows that repeat both id and text of the
kept row are the same row and are kept with it; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.llm.common import skewed_join, spaced, stash, table

#: Rows of one digest are spread over so many groups before they meet.
SALTS = 16


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), spaced(F.col(f"`{text_col}`")).alias("_content"))
    return rows.withColumn("_digest", F.sha2("_content", 256))


def exact_classes(rows: DataFrame) -> DataFrame:
    """_digest, _content, keep_id, group_size: one row per different content."""
    salted = rows.groupBy("_digest", "_content", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).alias("_salt")).agg(
        F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return salted.groupBy("_digest", "_content").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _clash(found: DataFrame) -> bool:
    return not found.groupBy("_digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256."""
    rows = _rows(docs, id_col, text_col)
    found = stash(exact_classes(rows).drop("_content"), "classes")
    if _clash(found):
        joined = skewed_join(rows, exact_classes(rows), ["_digest", "_content"], "group_size", "_id")
    else:  # a digest names one content, so the slim join decides on full content too
        joined = skewed_join(rows.select("_id", "_digest"), found, ["_digest"], "group_size", "_id")
    return joined.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold their text's kept id, with all their columns. Id and content decide together, and as the
    join's key holds the id, the copies of one text are spread over all tasks."""
    found = stash(exact_classes(_rows(docs, id_col, text_col)).drop("_content", "group_size"), "classes")
    keys = ["_digest"]
    rows = docs.select(F.struct("*").alias("_row"), F.col(f"`{id_col}`").alias("_id"), spaced(F.col(f"`{text_col}`")).alias("_content"))
    if _clash(found):
        found, keys = exact_classes(_rows(docs, id_col, text_col)), ["_digest", "_content"]
    rows = rows.withColumn("_digest", F.sha2("_content", 256)).select("_row", "_id", *keys)
    same = [rows[k] == found[k] for k in keys]
    return rows.join(found, [*same, rows["_id"].eqNullSafe(found["keep_id"])], "left_semi").select("_row.*")


def op4_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""
