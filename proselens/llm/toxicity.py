"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Each class has its own interpolated Kneser-Ney model of a word's bytes given the seven before; what a
class has not seen backs off to counts that both classes share, so that a rare spelling of a known
stem still speaks for its class while a word new to both says nothing. Per word the two
log-likelihoods are compared; a text's comparison is normalised by length, as a whole and in its
strongest windows, and a logistic function fitted on labelled rows kept out of the counts turns
these into a probability.

The counts come from a bounded sample of labelled rows (COUNT_ROWS of each class, CALIBRATION_ROWS
for the logistic function); every document is scored, whole.

Defined results: null and empty texts have no words and score as such a text does; without labels
of both classes every text scores the share of label 1 (0 if there is no label); null labels are ignored;
labels that repeat an id count once, the larger one; columns of docs pass through whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proselens.llm.common import ALNUM, arrow_batches, fold, table

#: Labelled rows of each class that are counted, at most.
COUNT_ROWS = 6000
#: Labelled rows that the logistic function is fitted on, at most.
CALIBRATION_ROWS = 12000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
DISCOUNT = 0.75
#: Bytes of history and of a whole gram.
HISTORY = 7
GRAM = HISTORY + 1
START, END = b"\x01" * HISTORY, b"\x02"
#: Words longer than this are scored in pieces of this many bytes.
LONGEST = 64
WINDOWS = (1, 4, 16)
#: Distinct words whose scores a worker remembers before it starts over.
MEMORY = 400_000


def words(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM).split() if text else []


def pieces(text: bytes | None) -> list[bytes]:
    """The words of a text, those that are too long in parts."""
    ws = words(text)
    if ws and max(map(len, ws)) > LONGEST:
        ws = [w[a : a + LONGEST] for w in ws for a in range(0, len(w), LONGEST)]
    return ws


def grams(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All eight-byte grams of the padded words as integers, and the word each belongs to."""
    flat = np.frombuffer(b"".join(START + w + END for w in ws), dtype=np.uint8)
    n = np.array([len(w) + 1 for w in ws], dtype=np.int64)
    ends = np.cumsum(n)
    begin = np.cumsum(n + HISTORY) - n - HISTORY
    at = np.arange(ends[-1] if len(ws) else 0) + np.repeat(begin - (ends - n), n)
    key = np.zeros(len(at), dtype=np.uint64)
    for k in range(GRAM):
        key = key << np.uint64(8) | flat[at + k]
    return key, np.repeat(np.arange(len(ws)), n)


@dataclass
class KneserNey:
    """Per gram the log ratio of the two classes; per history that of a gram neither class has seen."""

    gram: np.ndarray
    ratio: np.ndarray
    history: np.ndarray
    unseen: np.ndarray
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    prior: float = 0.0

    @staticmethod
    def fit(ws: list[bytes], counts: np.ndarray) -> KneserNey:
        """counts: (words, 2), how often each word stands in ordinary and in toxic texts."""
        key, owner = grams(ws)
        gram, inverse = np.unique(key, return_inverse=True)
        c = np.stack([np.bincount(inverse, weights=counts[owner, k], minlength=len(gram)) for k in (0, 1)], axis=1)
        shared = _shared(gram, c.sum(axis=1))
        hist, at = np.unique(gram >> np.uint64(8), return_inverse=True)
        total = np.stack([np.bincount(at, weights=c[:, k], minlength=len(hist)) for k in (0, 1)], axis=1)
        kinds = np.stack([np.bincount(at, weights=c[:, k] > 0, minlength=len(hist)) for k in (0, 1)], axis=1)
        rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        p = np.maximum(c - DISCOUNT, 0) / np.maximum(total[at], 1) + rest[at] * shared[:, None]
        ratio = np.log(p)
        return KneserNey(gram, (ratio[:, 1] - ratio[:, 0]).astype(np.float32), hist, (np.log(rest[:, 1]) - np.log(rest[:, 0])).astype(np.float32))

    def words(self, ws: list[bytes]) -> np.ndarray:
        """Log-likelihood of each word as toxic less that as ordinary."""
        if not ws or not len(self.gram):
            return np.zeros(len(ws))
        key, owner = grams(ws)
        i = np.minimum(np.searchsorted(self.gram, key), len(self.gram) - 1)
        h = np.minimum(np.searchsorted(self.history, key >> np.uint64(8)), len(self.history) - 1)
        value = np.where(self.gram[i] == key, self.ratio[i], np.where(self.history[h] == key >> np.uint64(8), self.unseen[h], 0.0))
        return np.bincount(owner, weights=value, minlength=len(ws))

    def features(self, texts: list[bytes | None], memory: dict[bytes, float]) -> np.ndarray:
        parts = [pieces(t) for t in texts]
        if len(memory) > MEMORY:
            memory.clear()
        new = list({w for p in parts for w in p} - memory.keys())
        for a in range(0, len(new), 50_000):
            memory.update(zip(new[a : a + 50_000], self.words(new[a : a + 50_000]).tolist()))
        out = np.zeros((len(texts), len(WINDOWS) + 2))
        for k, p in enumerate(parts):
            if p:
                x = np.fromiter(map(memory.__getitem__, p), dtype=np.float64, count=len(p))
                run = np.concatenate(([0.0], np.cumsum(x)))
                out[k, 0] = x.mean()
                out[k, 1] = np.log(len(p))
                for j, w in enumerate(WINDOWS):
                    w = min(w, len(p))
                    out[k, 2 + j] = (run[w:] - run[:-w]).max() / w
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.prior = float(y.mean()) if len(y) else 0.0
        if not len(y) or y.min() == y.max() or not len(self.gram):
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._expand(x)
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (y - p) - 1e-2 * w
            curve = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 1e-2 * np.eye(len(w))
            w = w + np.linalg.solve(curve, slope)
        self.weights = w

    def _expand(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        z = np.clip(z, -6, 6)
        return np.concatenate((np.ones((len(z), 1)), z, z[:, 2:] ** 2, z[:, 1:2] * z[:, 2:]), axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._expand(x) @ self.weights, -30, 30)))


def _shared(gram: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Interpolated Kneser-Ney probability of each gram's last byte, over both classes."""
    order, keys, x = GRAM, gram, count.astype(np.float64)
    levels = []
    while True:
        hist, at = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(at, weights=x), np.bincount(at)
        levels.append((keys, np.maximum(x - DISCOUNT, 0) / total[at], (DISCOUNT * kinds / total)[at]))
        if order == 1:
            break
        order -= 1
        keys, x = np.unique(keys & np.uint64((1 << 8 * order) - 1), return_counts=True)
        x = x.astype(np.float64)
    below, p = None, None
    for keys, own, rest in reversed(levels):
        if below is None:
            p = own + rest / 256
        else:
            bits = 8 * next(GRAM - 1 - k for k, lv in enumerate(levels) if lv[0] is keys)
            p = own + rest * p[np.searchsorted(below, keys & np.uint64((1 << bits) - 1))]
        below = keys
    return p


def _with_labels(docs: DataFrame, id_col: str, text_col: str, sample: DataFrame) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    return rows.join(F.broadcast(sample), "_id").select("_text", "_label")  # sample: bounded by its limit


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn=None) -> KneserNey:
    """learn: a condition on `_id` for the labels that may be read; by default all."""
    spark = docs.sparkSession
    arrow_batches(spark)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    known = known.filter(learn) if learn is not None else known
    part = F.pmod(F.xxhash64("_id"), F.lit(4))
    order = F.xxhash64("_id", F.lit(1))
    counted = [known.filter((part > 0) & (F.col("_label") == k)).orderBy(order, "_id").limit(COUNT_ROWS) for k in (0, 1)]

    def count(batches):
        import pyarrow as pa
        from collections import Counter

        found = (Counter(), Counter())
        for b in batches:
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found[k].update(pieces(t))
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(list(found[k]), type=pa.binary()), pa.array([k] * len(found[k]), type=pa.int32()), pa.array(list(found[k].values()), type=pa.int64())], names=["w", "k", "n"])

    rows = _with_labels(docs, id_col, text_col, counted[0].unionByName(counted[1]))
    pairs = rows.mapInArrow(count, "w binary, k int, n long").groupBy("w").agg(F.sum(F.when(F.col("k") == 0, F.col("n"))).alias("n0"), F.sum(F.when(F.col("k") == 1, F.col("n"))).alias("n1"))
    got = pairs.fillna(0).toArrow().sort_by("w")
    counts = np.stack([got.column("n0").to_numpy(), got.column("n1").to_numpy()], axis=1).astype(np.float64) if got.num_rows else np.zeros((0, 2))
    model = KneserNey.fit(got.column("w").to_pylist(), counts) if got.num_rows and counts.sum(axis=0).min() > 0 else KneserNey(*(np.zeros(0, t) for t in (np.uint64, np.float32, np.uint64, np.float32)))
    del got
    sent = spark.sparkContext.broadcast(model)

    def features(batches):
        import pyarrow as pa

        memory: dict[bytes, float] = {}
        for b in batches:
            x = sent.value.features(b.column(0).to_pylist(), memory)
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=["y", *(f"x{k}" for k in range(x.shape[1]))])

    kept = known.filter(part == 0).orderBy(order, "_id").limit(CALIBRATION_ROWS)
    wide = len(WINDOWS) + 2
    seen = _with_labels(docs, id_col, text_col, kept).mapInArrow(features, "y int, " + ", ".join(f"x{k} double" for k in range(wide))).toPandas().to_numpy(dtype=np.float64)
    model.calibrate(seen[:, 1:], seen[:, 0])
    return model


def score(docs: DataFrame, model: KneserNey, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col appended, the probability of label 1; no row moves."""
    arrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def go(batches):
        import pyarrow as pa

        memory: dict[bytes, float] = {}
        for b in batches:
            p = sent.value.probability(sent.value.features(b.column(at).cast(pa.binary()).to_pylist(), memory))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, score_col])

    return docs.mapInArrow(go, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def not_held_out():
    return fold(F.col("_id"), FOLDS) != HELD_OUT


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below the threshold, columns as they were."""
    name = "_toxic_score"
    while name in docs.columns:
        name += "_"
    model = train(docs, labels, learn=not_held_out())
    return score(docs, model, score_col=name).filter(F.col(name) < threshold).drop(name)


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), learn=not_held_out())
    return score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
