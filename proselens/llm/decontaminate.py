"""Benchmark decontamination with an FM-index per training shard.

A shard is a block of whole documents inside one task. Words become ids of the benchmark's
vocabulary; words outside it can be in no window, so they end a run, and runs shorter than the shortest
window are left out of the index (no occurrence is lost). The shard's runs are suffix-sorted by
prefix doubling, their Burrows-Wheeler transform goes into a wavelet matrix, all test windows are
searched backwards at once through its ranks, occurrences are located by walking to sampled suffix
positions, and the spans of one document are merged.

Defined results: null or empty text has no words; a null id is passed through; an item without
words has no window; repeated items and rows each count for themselves; the benchmark is sent to the
tasks in blocks of at most BLOCK_WORDS words, so what is broadcast is bounded.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.llm.common import ALNUM, arrow_batches, table

WINDOW = 8
#: Words of the benchmark that are searched, and broadcast, at a time.
BLOCK_WORDS = 2_000_000
#: A shard is closed at this many words of text, whole documents only.
SHARD_WORDS = 4_000_000
#: Every so manieth suffix position of a run is stored.
SAMPLE = 8


def words(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM).split() if text else []


class Phrases:
    """The distinct windows of a block of items, as ids, and the items that hold each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        found: dict[tuple[int, ...], set[int]] = {}
        for k, (_, ws) in enumerate(items):
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws]
            for s in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[s : s + window]), set()).add(k)
        self.lens = np.array([len(p) for p in found], dtype=np.int64)
        self.rows = np.zeros((len(found), window), dtype=np.int64)
        for k, p in enumerate(found):
            self.rows[k, window - len(p) :] = p  # aligned at the end, where the search begins
        self.owners = np.array([i for o in found.values() for i in sorted(o)], dtype=np.int64)
        self.owner_at = np.cumsum([0] + [len(o) for o in found.values()])
        self.shortest = int(self.lens.min()) if len(found) else 0


class FMIndex:
    """Self-index of integer runs: symbols from 1 up, a 0 ends each run."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        n = self.n = len(seq)
        ends = np.flatnonzero(seq == 0)
        rank = seq.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))  # each end sorts by itself, so comparisons stop there
        step, order = 1, np.argsort(rank, kind="stable")
        while True:
            sorted_rank = rank[order]
            if (sorted_rank[1:] != sorted_rank[:-1]).all():
                break
            after = np.zeros(n, dtype=np.int64)
            after[:-step] = rank[step:] + 1
            key = rank * (n + len(ends) + sigma + 2) + after
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
            step *= 2
        prev = order - 1
        bwt = np.where(prev >= 0, seq[prev], 0)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma + 1))))
        keep = (order % sample == 0) | (bwt == 0)  # a run's first position ends every walk
        self.sampled, self.at = keep, order
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        cur = bwt
        for b in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            bit = (cur >> b) & 1
            zeros = np.concatenate(([0], np.cumsum(bit == 0)))
            self.levels.append((b, bit.astype(bool), zeros, int(zeros[-1])))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))
        self.base = self._sink(np.arange(sigma + 1), np.zeros(sigma + 1, dtype=np.int64))

    def _sink(self, sym: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, _, zeros, total in self.levels:
            z = zeros[i]
            i = np.where((sym >> b) & 1 == 0, z, total + i - z)
        return i

    def rank(self, sym: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of sym among the first i symbols of the transform."""
        return self._sink(sym, i) - self.base[sym]

    def search(self, rows: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of all patterns, each searched from its last symbol to its first."""
        lo, hi = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), self.n, dtype=np.int64)
        live = np.arange(len(rows))
        for t in range(rows.shape[1]):
            live = live[(lens[live] > t) & (hi[live] > lo[live])]
            if not len(live):
                break
            sym = rows[live, rows.shape[1] - 1 - t]
            lo[live] = self.first[sym] + self.rank(sym, lo[live])
            hi[live] = self.first[sym] + self.rank(sym, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out, walk, steps = np.empty(len(row), dtype=np.int64), np.arange(len(row)), 0
        row = row.copy()
        while len(walk):
            done = self.sampled[row]
            out[walk[done]] = self.at[row[done]] + steps
            walk, row = walk[~done], row[~done]
            sym, i = np.zeros(len(row), dtype=np.int64), row
            for b, bit, zeros, total in self.levels:
                one = bit[i]
                sym |= one.astype(np.int64) << b
                i = np.where(one, total + i - zeros[i], zeros[i])
            row = self.first[sym] + i - self.base[sym]
            steps += 1
        return out


def ragged(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0] .. lo[0]+n[0]-1, lo[1] .. and so on."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(lo - (ends - n), n)


def search_shard(texts: list[bytes | None], ph: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per text: its number of words, merged hit spans (first word, end) and the sorted items found."""
    sizes, parts = [], []
    get = ph.vocab.get
    for t in texts:
        ws = words(t)
        sizes.append(len(ws))
        parts.append(np.fromiter((get(w, 0) for w in ws), dtype=np.int64, count=len(ws)))
        parts.append(np.zeros(1, dtype=np.int64))
    ids = np.concatenate(parts)
    start_of = np.cumsum([0] + [s + 1 for s in sizes])
    out: list[tuple[int, list[tuple[int, int]], list[str]]] = [(s, [], []) for s in sizes]
    inside = np.concatenate(([0], (ids > 0).astype(np.int8), [0]))
    begin, end = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    long = end - begin >= max(1, ph.shortest)
    begin, end = begin[long], end[long]
    if not ph.shortest or not len(begin):
        return out
    place = ragged(begin, end - begin + 1)  # with the 0 behind each run
    fm = FMIndex(ids[place], len(ph.vocab))
    lo, hi = fm.search(ph.rows, ph.lens)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    at = place[fm.locate(ragged(lo, n))]
    if not len(at):
        return out
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + ph.lens[which], -1)
    hit = np.concatenate(([0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]))
    s, e = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
    doc = np.searchsorted(start_of, s, side="right") - 1
    for d, a, b in zip(doc.tolist(), (s - start_of[doc]).tolist(), (e - start_of[doc]).tolist()):
        out[d][1].append((a, b))
    doc = np.searchsorted(start_of, at, side="right") - 1
    held = ph.owner_at[which + 1] - ph.owner_at[which]
    pairs = np.unique(np.repeat(doc, held) * len(ph.items) + ph.owners[ragged(ph.owner_at[which], held)])
    for p in pairs.tolist():
        out[p // len(ph.items)][2].append(ph.items[p % len(ph.items)])
    return out


SCHEMA = "_id {kind}, _a long, _b long, n_words long, spans array<struct<s:long,e:long>>, items array<string>"


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Blocks of (item, words); the rows come through the driver one partition at a time."""
    block, n = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator():
        ws = words(bytes(text) if text is not None else None)
        if n and n + len(ws) > BLOCK_WORDS:
            yield block
            block, n = [], 0
        block.append(("" if item is None else item, ws))
        n += len(ws)
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: the id, n_words, spans (merged word ranges to remove) and items found."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text")).select("*", F.xxhash64("_text").alias("_a"), F.xxhash64(F.lit(1), "_text").alias("_b"))
    schema = SCHEMA.format(kind=rows.schema["_id"].dataType.simpleString())

    def run(sent):
        def go(batches):
            import pyarrow as pa

            ph = sent.value
            def made(ids, texts, a, b):
                got = search_shard(texts, ph)
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, type=kind),
                        pa.array(a, type=pa.int64()),
                        pa.array(b, type=pa.int64()),
                        pa.array([g[0] for g in got], type=pa.int64()),
                        pa.array([[{"s": s, "e": e} for s, e in g[1]] for g in got], type=pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                        pa.array([sorted(g[2]) for g in got], type=pa.list_(pa.string())),
                    ],
                    names=["_id", "_a", "_b", "n_words", "spans", "items"],
                )

            held, size, kind = ([], [], [], []), 0, None
            for b in batches:
                kind = b.column(0).type
                for row in zip(*(b.column(k).to_pylist() for k in range(4))):
                    for h, x in zip(held, row):
                        h.append(x)
                    size += len(row[1] or b"")
                    if size > SHARD_WORDS * 6:
                        yield made(*held)
                        held, size = ([], [], [], []), 0
            if held[0]:
                yield made(*held)

        return rows.mapInArrow(go, schema)

    frames = [run(spark.sparkContext.broadcast(Phrases(b))) for b in _blocks(benchmark, item_col, item_text)]
    if len(frames) == 1:
        return frames[0].drop("_a", "_b").withColumnRenamed("_id", id_col)
    # rows of the same id and text have the same result; they are merged and then given as often as they were there
    every = functools.reduce(DataFrame.unionByName, (f.withColumn("_block", F.lit(k)) for k, f in enumerate(frames)))
    merged = every.groupBy("_id", "_a", "_b").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.flatten(F.transform(F.collect_set(F.struct("_block", "items")), lambda x: x["items"]))).alias("items"),
        (F.count(F.lit(1)) / len(frames)).cast("int").alias("_rows"),
    )
    joined = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<s:long,e:long>>)"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (F.element_at(a, -1)["e"] >= x["s"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["s"].alias("s"), F.greatest(F.element_at(a, -1)["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(a, F.array(x))),
    )
    whole = merged.withColumn("spans", joined).withColumn("_row", F.explode(F.sequence(F.lit(1), "_rows")))
    return whole.select(F.col("_id").alias(id_col), "n_words", "spans", "items")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text with the words of each span cut out, and what stands between them."""
    at = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", text.translate(ALNUM))]
    out, begin = [], 0
    for s, e in spans:
        out.append(text[begin : at[s][0]])
        begin = at[e - 1][1]
    return b"".join([*out, text[begin:]])


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str = "n_chars", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with every benchmark window cut from its text (until none is left) and length_col, if there, renewed.

    Texts without a hit stay as they are, null too; a text of which no word is left goes. No row moves.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns else None
    sent = [spark.sparkContext.broadcast(Phrases(block)) for block in _blocks(benchmark, item_col, item_text)]
    return docs.mapInArrow(_cutter(sent, at, size), docs.schema)


def _cutter(sent: list, at: int, size: int | None):
    def go(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            keep, changed, todo = [True] * len(texts), False, list(range(len(texts)))
            while todo:
                hit = set()
                for block in sent:
                    found = search_shard([texts[k] for k in todo], block.value)
                    for k, f in zip(todo, found):
                        if f[1]:
                            texts[k] = without(texts[k], f[1])
                            keep[k] = bool(words(texts[k]))
                            changed = True
                            hit.add(k)
                todo = sorted(hit)
            if changed:
                column = pa.array(texts, type=pa.binary()).cast(b.schema.field(at).type)
                columns = [*b.columns]
                if size is not None:
                    import pyarrow.compute as pc

                    columns[size] = pc.if_else(pc.equal(column, columns[at]).fill_null(True), columns[size], pc.utf8_length(column).cast(columns[size].type))
                columns[at] = column
                b = pa.RecordBatch.from_arrays(columns, names=b.schema.names).filter(pa.array(keep))
            yield b

    return go


def op7_benchmark_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]).alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_items >= 2).alias("contaminated"),
    )


OP7_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS k, array_to_string(w[p : p + least(len(w), 8) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS p FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT k FROM wins
), found AS (
  SELECT d.doc_id, d.p, d.k, wins.item_id
  FROM (SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS g
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM docs, sizes WHERE len(w) >= k)) d
  JOIN wins ON wins.g = d.g AND wins.k = d.k
), hits AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM found) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN held USING (doc_id)
"""
