"""Shared plumbing: table access, the shared working folder, byte tables for the word rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.shipping import ship

#: Rows of an Arrow batch handed to Python: long texts stay a few MB a batch.
BATCH_ROWS = 1024
BATCH_BYTES = 8 << 20

#: A-Z to a-z and the six ASCII white-space bytes to a space; UTF-8 stays valid.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Bytes outside `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` become spaces, A-Z become a-z.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Before Python stages: bounds the rows and bytes of an Arrow batch, so that very long texts fit a worker, and ships the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    A session that names none gets a folder of its own if it runs in one process (tests, a laptop); on a cluster that is an error,
    since rows written to an executor's own disk would be missing later.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="proselens-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's own part of the shared folder, which is deleted when the driver's JVM ends."""
    context = spark.sparkContext
    top = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/proselens/{context.applicationId}")
    system = top.getFileSystem(context._jsc.hadoopConfiguration())
    if not system.exists(top):
        system.mkdirs(top)
        system.deleteOnExit(top)
    return f"{top.toString()}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors. compression: else the session's;
    "none" for bytes that are packed already, as a compressor holds a whole page beside the heap."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def spaced(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text, modulo folds; a null id is fold of the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


#: A key with more than one in so many rows is hot; there are fewer such keys than this.
HOT_SHARE = 1000


def skewed_join(rows: DataFrame, found: DataFrame, keys: list[str], size: str, spread: str) -> DataFrame:
    """rows with the other columns of found, which has one row for each key and in `size` the number of its rows.

    The keys of more than one in HOT_SHARE rows, fewer than HOT_SHARE in number, are broadcast; their rows are dealt by `spread` instead of the
    key, so that no task gets a hot key's rows together.
    """
    total = found.agg(F.sum(size)).first()[0] or 0
    values = F.struct(*(c for c in found.columns if c not in keys))
    hot = F.broadcast(found.filter(F.col(size) * HOT_SHARE > total).select(*keys, values.alias("_hot")))
    marked = rows.join(hot, keys, "left").withColumn("_deal", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1))
    cold = found.select(*keys, values.alias("_cold"), F.lit(0).cast("long").alias("_deal"))
    return marked.join(cold, [*keys, "_deal"], "left").select(*rows.columns, F.coalesce("_hot", "_cold").alias("_found")).select(*rows.columns, "_found.*")
