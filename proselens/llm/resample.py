"""Quality by importance resampling: hashed n-gram models of good text and of all text, sampled by Gumbel top-k.

Two bags of hashed unigrams and bigrams are counted, one over texts labelled good (TARGET_ROWS of them at most) and one over all.
A text's weight is the mean log ratio of the two over its n-grams, times SHARPNESS; adding a Gumbel value, drawn
from the row key, and keeping the largest draws rows without replacement in proportion to exp(weight).
The threshold is found by counting keys in ever finer bins, so no task sees more than one bin's rows.

Defined results: null and empty texts have no n-gram and weight 0; a null id has the draw of a
null; keys that tie are ordered by id (null first), and rows that tie in both are kept or left together with the first; no good label: all
weights are 0 and the sample is uniform; ids are whole numbers; repeated rows have equal keys; texts of any length are read whole; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.llm.common import LOWER, arrow_batches, stash, table

BUCKETS = 1 << 16
SHARE = 0.8
#: Good texts that the target model is fitted on, at most; their ids are what is broadcast.
TARGET_ROWS = 20_000
#: A text's weight counts as that of so many n-grams, whatever its length.
SHARPNESS = 60.0
SMOOTHING = 1.0
#: Rows of a bin of keys that are few enough to sort.
FEW = 20_000
MEMORY = 400_000


class Hashes(dict):
    """Hashes of the words that were asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = h = zlib.crc32(word)
        return h


def buckets(text: bytes | None, memory: Hashes) -> np.ndarray:
    """Buckets of a text's words and of its pairs of neighbours."""
    ws = text.translate(LOWER).split() if text else []
    if not ws:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(memory.__getitem__, ws), dtype=np.uint64, count=len(ws))
    pair = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) * np.uint64(0x85EBCA77C2B2AE63) >> np.uint64(40)
    return np.concatenate((h % np.uint64(BUCKETS // 2), np.uint64(BUCKETS // 2) + pair % np.uint64(BUCKETS // 2))).astype(np.int64)


def count_buckets(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """rows: _text binary, _good boolean. Counts over all rows and over the good."""

    def go(batches):
        import pyarrow as pa

        every, good, memory = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64), Hashes()
        for b in batches:
            found = [buckets(t, memory) for t in b.column(0).to_pylist()]
            marked = [f for f, g in zip(found, b.column(1).to_pylist()) if g]
            every += np.bincount(np.concatenate(found), minlength=BUCKETS) if found else 0
            good += np.bincount(np.concatenate(marked), minlength=BUCKETS) if marked else 0
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at]), pa.array(good[at])], names=["b", "n", "g"])

    got = rows.mapInArrow(go, "b long, n long, g long").groupBy("b").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).toArrow()  # BUCKETS rows at most
    every, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = got.column("b").to_numpy()
    every[at], good[at] = got.column("n").to_numpy(), got.column("g").to_numpy()
    return every, good


def log_ratios(every: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Log of good over all, in each half (words, pairs)."""
    if not good.sum():
        return np.zeros(BUCKETS)
    out = np.zeros(BUCKETS)
    for half in (slice(0, BUCKETS // 2), slice(BUCKETS // 2, BUCKETS)):
        share = lambda n: (n[half] + SMOOTHING) / (n[half].sum() + SMOOTHING * (BUCKETS // 2))
        out[half] = np.log(share(good)) - np.log(share(every))
    return out


def threshold(scored: DataFrame, k: int):
    """The condition that holds for the k largest of key (double), ties by `_id`."""
    low, high = scored.agg(F.min("key"), F.max("key")).first()
    above, inside = 0, F.lit(True)
    while low is not None and high > low:
        step = (high - low) / 1024
        edge = lambda i: low + i * step if i < 1024 else high  # noqa: B023, E731
        b = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(step)), F.lit(1023)).cast("int")
        bins = {r.b: (r.n, r.lo, r.hi) for r in scored.filter(inside).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for i in sorted(bins, reverse=True):
            n, lo, hi = bins[i]
            if above + n > k or i == min(bins):
                break
            above += n
        low, high = lo, hi
        inside = (F.col("key") >= F.lit(lo)) & (F.col("key") <= F.lit(hi))
        if n <= FEW:
            break
    if low is None:
        return F.lit(False)
    if low == high:  # rows that tie in key go by id
        tied = scored.filter(F.col("key") == F.lit(high))
        nulls, lo, hi = tied.agg(F.count_if(F.col("_id").isNull()), F.min("_id"), F.max("_id")).first()
        want = k - above
        while lo is not None and lo < hi:
            mid = (lo + hi) // 2
            if nulls + tied.filter(F.col("_id") <= F.lit(mid)).count() >= want:
                hi = mid
            else:
                lo = mid + 1
        within = F.lit(want > 0) & (F.col("_id").isNull() | (F.lit(want > nulls) & (F.col("_id") <= F.lit(hi))))
        return (F.col("key") > F.lit(high)) | ((F.col("key") == F.lit(high)) & F.coalesce(within, F.lit(False)))
    last = scored.filter(inside).groupBy("key", "_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("key").desc(), F.col("_id").asc_nulls_first()).limit(FEW + 1).collect()
    cut = None
    for r in last:
        if above >= k:
            break
        above += r.n
        cut = r
    if cut is None:
        return F.col("key") > F.lit(high)
    tie = F.col("_id").isNull() if cut["_id"] is None else F.coalesce(F.col("_id") <= F.lit(cut["_id"]), F.lit(True))
    return (F.col("key") > F.lit(cut["key"])) | ((F.col("key") == F.lit(cut["key"])) & tie)


def resample(docs: DataFrame, good: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """good: ids of good texts. Per row: the id, n_grams, log_ratio (mean), key and kept, for round(share x rows) rows."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    ids = good.select(F.col(id_col).cast("long").alias("_id")).filter("_id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("_id", F.lit(5)), "_id").limit(TARGET_ROWS).withColumn("_good", F.lit(True))
    every = count_buckets(rows.select("_text", F.lit(False).alias("_good")))[0]
    target = count_buckets(rows.join(F.broadcast(ids), "_id").select("_text", "_good"))[1]
    sent = spark.sparkContext.broadcast(log_ratios(every, target))

    def go(batches):
        import pyarrow as pa

        memory = Hashes()
        for b in batches:
            n, mean = [], []
            for t in b.column(1).to_pylist():
                x = sent.value[buckets(t, memory)]
                n.append(len(x))
                mean.append(float(x.mean()) if len(x) else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, type=pa.int64()), pa.array(mean)], names=["_id", "n_grams", "log_ratio"])

    u = (F.shiftrightunsigned(F.xxhash64("_id", F.lit(17)), 11).cast("double") + 0.5) * 2.0**-53
    gumbel = -F.log(-F.log(u))
    scored = stash(rows.mapInArrow(go, "_id long, n_grams long, log_ratio double").withColumn("key", F.col("log_ratio") * SHARPNESS + gumbel), "weights")
    k = round(share * scored.count())
    return scored.select(F.col("_id").alias(id_col), "n_grams", "log_ratio", "key", threshold(scored, k).alias("kept"))


def op6_importance_resampling(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return resample(table(spark, sf_dir, "documents"), labels.filter("quality = 1").select("doc_id"))
