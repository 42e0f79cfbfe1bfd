"""Commit logs and commit messages as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proselens.functions import text as T

#: Record separators of `git log --format=%H%x00%B%x00`.
NUL = "\x00"


def log_records(logs: DataFrame, key: list[str], log_col: str = "log", separator: str = NUL) -> DataFrame:
    """A log's fields come in pairs of hash and message; records without a hash are dropped: key, k, hash, message."""
    fields = F.split(log_col, "\\Q" + separator + "\\E", -1)
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size("_f") / 2).cast("int")), lambda i: F.struct(T.trim(F.element_at("_f", i * 2 - 1)).alias("hash"), F.element_at("_f", i * 2).alias("message")))
    rows = logs.select(*key, fields.alias("_f")).filter(F.size("_f") >= 2)
    return rows.select(*key, F.posexplode(pairs).alias("k", "r")).select(*key, "k", "r.hash", "r.message").filter("hash <> ''")


def message_segments(rows: DataFrame, key: list[str], message_col: str = "message") -> DataFrame:
    """A message's subject and paragraphs: key, seg_id, kind, line_start, line_end, text.

    Lines from a scissors line on, lines that begin with # and the trailers of the last of several paragraphs are
    no prose. Line and paragraph numbers are windows over the lines of one message.
    """
    lines = rows.select(*key, F.posexplode(F.split(message_col, "\r?\n", -1)).alias("k", "line"))
    by = Window.partitionBy(*key).orderBy("k")
    sc = (F.startswith("line", F.lit("#")) & F.contains("line", F.lit(">8"))).cast("int")
    lines = lines.withColumn("_cut", F.max(sc).over(by)).filter((F.col("_cut") == 0) & ~F.startswith("line", F.lit("#")))
    blank = T.trim(F.col("line")) == ""
    lines = lines.withColumn("_para", F.sum(blank.cast("int")).over(by)).filter(~blank)
    whole = Window.partitionBy(*key)
    lines = lines.withColumn("_first", F.min("_para").over(whole)).withColumn("_last", F.max("_para").over(whole))
    trailer = F.col("line").rlike("^[A-Za-z-]+: ") & (F.col("_para") == F.col("_last")) & (F.col("_first") < F.col("_last"))
    lines = lines.filter(~trailer)
    ordered = F.array_sort(F.collect_list(F.struct("k", "line")))
    paragraphs = lines.groupBy(*key, "_para", "_first").agg(
        (F.min("k") + 1).cast("int").alias("line_start"), (F.max("k") + 1).cast("int").alias("line_end"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text")
    )
    # the subject is the first line; what follows it without a blank line is body
    subject = F.col("_para") == F.col("_first")
    parts = F.when(
        subject & F.contains("text", F.lit("\n")),
        F.array(
            F.struct(F.lit("commit_subject").alias("kind"), F.col("line_start"), F.col("line_start").alias("line_end"), F.substring_index("text", "\n", 1).alias("text")),
            F.struct(F.lit("commit_body").alias("kind"), (F.col("line_start") + 1).alias("line_start"), F.col("line_end"), F.expr("substring(text, locate('\n', text) + 1)").alias("text")),
        ),
    ).otherwise(F.array(F.struct(F.when(subject, "commit_subject").otherwise("commit_body").alias("kind"), "line_start", "line_end", "text")))
    found = paragraphs.select(*key, F.explode(parts).alias("p")).select(*key, "p.*")
    return found.withColumn("seg_id", (F.row_number().over(Window.partitionBy(*key).orderBy("line_start")) - 1).cast("int"))


def commit_name(hash_col: str = "hash", subject_col: str = "subject"):
    """Seven characters of the hash and twenty of the subject."""
    return F.concat_ws(" ", F.left(hash_col, F.lit(7)), F.expr(f"nullif(left({subject_col}, 20), '')"))


#: Fixed value: the name of the document that a draft message is.
DRAFT = "<commit-msg>"


def message_document(spark, message: str) -> DataFrame:
    """A draft message's segments as one document; none if it holds no Japanese."""
    rows = spark.createDataFrame([(0, DRAFT, message)], "doc_id long, path string, message string")
    return message_segments(rows.filter(T.has_japanese(F.col("message"))), ["doc_id", "path"]).select("doc_id", "path", "seg_id", "kind", "text", "line_start", "line_end").withColumn("commit", F.lit(None).cast("string"))


def with_draft(draft: DataFrame, changed: DataFrame) -> DataFrame:
    """What a commit-msg hook looks at: the draft first, then the documents of the staged diff."""
    return draft.unionByName(changed.withColumn("doc_id", F.col("doc_id") + 1).select(draft.columns))
