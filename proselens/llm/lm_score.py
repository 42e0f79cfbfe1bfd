"""Language-model scores: causal self-attention over subword ids, beside a counted base.

The attention reads the pieces so far and weighs EXPERTS word distributions; what a word is given by an expert, and what the two words
before it say, are counts of all training texts:

1. One pass cuts all texts into units of about UNIT bytes, each with its own numbered words and their pieces, and counts the training texts' pieces.
2. The experts are a mixture of unigrams over pieces. A bounded sample (FIT_TEXTS passages) seeds it; its shares and priors are those of
   TURNS passes of EM over all training texts. Each training text goes to its expert.
3. Units send their different words and their different three-word sequences, each once with its count, to shards by hash. Shards add
   up the training counts, answer every unit, and count classes, unseen words and spellings. What moves and is kept grows with the input;
   a sequence that a third of all texts hold arrives as one row entry a unit.
4. The attention starts from a fit to the sample of step 2. Units meet their answers, and every task goes on from that start over all
   training texts in it, each word as counted without itself; the tasks' parameters are averaged by what they have read, a piece's row by how often
   the piece was read. The trust in repeated sequences is fitted by EM over the ratios that all training words had on the way.
5. Each unit, with its answers, is scored: p = trust * repeated + (1 - trust) * sum of expert weights and expert probabilities.

An expert gives frequent words their own smoothed share, rarer ones the share of the expert they stand in most, times
their share of that class, and leaves a share for unseen words, spelled by a byte trigram model with an end; so the probabilities of all
words add up to one. A sequence's shard key has 40 bits of its context besides the shard's number and 24 bits of the next word; words have
64 bits besides. Contexts of two of the COMMON most frequent words are left to the attention: of the words that are among a unit's
COMMON most frequent, those with the most occurrences in all training texts.

Defined results: null and empty texts are one end; a null id has the remainder of the empty text; repeated rows are scored alike
each time and count each time; texts of any length are read whole, in parts of PART bytes that see the HISTORY words before; with no training
text the base is that of N = V = 0; ids may be of any type; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import copy
from itertools import chain as chained
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.llm.attention import EXPERTS, LENGTH, SPAN, Attention
from proselens.llm.common import LOWER, arrow_batches, fold, stash, table
from proselens.llm.slots import Numbers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD_OUT = 7, 2
#: The sample that starts the fits: passages of FIT_CHARS characters, each from a hashed place of one of FIT_TEXTS training texts.
FIT_TEXTS, FIT_CHARS = 4000, 600
#: Passes over the sample, windows of a batch; passes of EM over all training texts, windows of a batch there, rate of learning.
PASSES, BATCH = 4, 64
TURNS, MANY, RATE = 3, 1024, 0.004
#: Ratios of a repeated sequence's share to the experts' are told apart by so many steps a unit of their logarithm, up to MOST.
STEPS, MOST = 16, 20
#: Rows of the embedding: pieces by frequency, one for all others, one for a text's beginning.
ROWS = 4096
RARE, BEGIN = ROWS - 2, ROWS - 1
#: Bytes of text in a unit and in a part of a long text; words a part sees of the one before.
UNIT, PART, HISTORY = 2_000_000, 1_000_000, 16
#: Words of which there is one in so many or more are frequent; there are fewer such words than this.
FREQUENT = 250_000
COMMON = 128
#: Bytes of text whose sequences meet in one shard.
SHARD = 4_000_000
#: Words whose pieces a task remembers before it starts over.
MEMORY = 120_000
#: Words of a unit that are scored at once; bytes of an Arrow batch, which holds one unit at least.
STRETCH, BATCH_BYTES = 50_000, 1 << 20
#: Trust cells by a context's count: 1, 2, 3 to 4, 5 to 8, more.
CELLS = np.array([0, 1, 2, 3, 3, 4, 4, 4, 4, 5])
#: Taken off the count of a repeated sequence; words of an expert that weigh like all the others' together.
DISCOUNT, STRENGTH = 0.25, 1000.0
END = b"\n"
SAMPLE = -2
WORDS, TRIPLES, SPELLING = 0, 1, 2

_encoder = {}


def encoder(model: str):
    if model not in _encoder:
        import sentencepiece

        _encoder[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _encoder[model]


def words(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


def pieces(ws: list[bytes], model: str) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of all words, one after another, and how many each has; a word always has one."""
    got = encoder(model).encode([w.decode("utf-8", "replace") for w in ws], num_threads=1)
    got = [g or [0] for g in got]
    n = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
    return np.fromiter(chained.from_iterable(got), dtype=np.int64, count=int(n.sum())), n


def ragged(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.repeat((lo - (np.cumsum(n) - n)).astype(lo.dtype), n)
    out += np.arange(len(out), dtype=out.dtype)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def hashed(ws: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))


def pack(x: np.ndarray) -> bytes:
    """Whole numbers by planes of their bytes, compressed."""
    import zstandard

    x = np.ascontiguousarray(x)
    return bytes([x.dtype.itemsize]) + zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers by their steps."""
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def unpack(b: bytes) -> np.ndarray:
    """As unsigned numbers."""
    import zstandard

    size = b[0]
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(f"<u{size}").reshape(-1)


class Words:
    """Numbers words as they come, with their pieces' rows, one word's after another's."""

    def __init__(self, row: np.ndarray, model: str):
        self.row, self.model = row, model
        self.clear()

    def clear(self) -> None:
        self.known, self.names = Numbers(), []
        self.rows, self.n = np.zeros(0, np.uint16), np.zeros(0, np.int64)

    def kinds(self, parts: list[list[bytes]]) -> np.ndarray:
        if len(self.known) > MEMORY:
            self.clear()
        old = len(self.known)
        kind = np.fromiter(map(self.known.__getitem__, chained.from_iterable(parts)), dtype=np.int64, count=sum(map(len, parts)))
        if len(self.known) > old:
            fresh = list(islice(self.known, old, None))
            ids, n = pieces(fresh, self.model)
            self.names += fresh
            self.rows, self.n = np.concatenate((self.rows, self.row[ids])), np.concatenate((self.n, n))
            self.begin = np.cumsum(self.n) - self.n
        return kind


def parts(text: bytes | None):
    """A text's words in parts of about PART bytes: (words, how many of them are history, whether the text ends)."""
    if not text or len(text) <= PART:
        yield words(text) + [END], 0, True
        return
    at, before = 0, []
    while at < len(text):
        stop = at + PART
        if stop < len(text):  # not within a word
            while stop < len(text) and text[stop] not in b" \t\n\x0b\x0c\r":
                stop += 1
        last = stop >= len(text)
        own = words(text[at:stop])
        yield before + own + [END] * last, len(before), last
        before, at = (before + own)[-HISTORY:], stop


class Unit:
    """Parts of texts: `kind` of each word, `size` and `hist` words of each part, `train` and `expert` of its text, and of each kind its name, rows and number of rows."""

    FIELDS = ("kind", "size", "hist", "train", "expert", "rows", "n")

    def __init__(self, names: list[bytes], **arrays):
        self.names = names
        for k in self.FIELDS:
            setattr(self, k, arrays[k])

    def dump(self) -> dict[str, bytes]:
        kinds = {"kind": np.uint32, "size": np.uint32, "hist": np.uint8, "train": np.uint8, "expert": np.uint8, "rows": np.uint16, "n": np.uint32}
        return {k: pack(getattr(self, k).astype(kinds[k])) for k in self.FIELDS} | {"names": pack(np.frombuffer(b"\t".join(self.names), dtype=np.uint8))}

    @classmethod
    def load(cls, names: bytes, *fields: bytes) -> Unit:
        return cls(unpack(names).tobytes().split(b"\t"), **{k: unpack(b).astype(np.int64) for k, b in zip(cls.FIELDS, fields)})

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its part and its position there."""
        part = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        return part, np.arange(len(self.kind), dtype=np.int32) - np.repeat((np.cumsum(self.size) - self.size).astype(np.int32), self.size)

    def stretches(self, triples: tuple):
        """The parts that begin in the same STRETCH words: (their words, a unit of them with all names, their triples)."""
        i, *counts, own = triples
        end = np.cumsum(self.size)
        first = np.flatnonzero(np.diff((end - self.size) // STRETCH, prepend=-1)).tolist()
        for lo, hi in zip(first, [*first[1:], len(end)]):
            a, b = int(end[lo] - self.size[lo]), int(end[hi - 1])
            x, y = np.searchsorted(i, (a, b)).tolist()
            parts = {k: getattr(self, k)[lo:hi] for k in ("size", "hist", "train", "expert")}
            yield slice(a, b), Unit(self.names, kind=self.kind[a:b], rows=self.rows, n=self.n, **parts), (i[x:y] - a, *(c[x:y] for c in counts), own[a:b])

    def likely(self, share: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """(parts, experts): the log of prior and shares of a part's pieces."""
        fit = np.ascontiguousarray(np.add.reduceat(share[:, self.rows], np.cumsum(self.n) - self.n, axis=1).T)
        return np.add.reduceat(fit[self.kind], np.cumsum(self.size) - self.size, axis=0) + np.log(prior)

    def deal(self, row: np.ndarray, share: np.ndarray, prior: np.ndarray) -> Unit:
        """From piece ids to rows; each part goes to the expert that gives it the most."""
        self.rows = row[self.rows].astype(np.int64)
        self.expert = self.likely(share, prior).argmax(axis=1)
        return self

    def taught(self) -> np.ndarray:
        """Whether a word is a training text's and counted here."""
        part, at = self.places()
        return (at >= self.hist[part]) & (self.train[part] > 0)

    def triples(self, hashes: np.ndarray, common: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the words that have a stored context: place, shard and key; and whether a word is scored here."""
        part, at = self.places()
        begin = np.uint64(0x5BD1E995)
        c = common[self.kind]
        known = np.where(at >= 1, np.roll(c, 1), True) & np.where(at >= 2, np.roll(c, 2), True)
        own = at >= self.hist[part]
        i = np.flatnonzero(own & ~known)
        at = at[i]
        del part, c, known
        with np.errstate(over="ignore"):
            ctx = mix(np.where(at >= 2, hashes[self.kind[i - 2]], begin) + np.uint64(7)) * np.uint64(0x100000001B3)
            ctx = mix(ctx + np.where(at >= 1, hashes[self.kind[i - 1]], begin))
        shard = ((ctx >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)
        return i, shard.astype(np.int64), (ctx << np.uint64(24)) | (mix(hashes[self.kind[i]]) >> np.uint64(40)), own


def by_frequency(n: np.ndarray) -> np.ndarray:
    """The row of each piece: the most frequent have their own."""
    row = np.full(len(n), RARE, dtype=np.uint16)
    row[np.argsort(-n, kind="stable")[:RARE]] = np.arange(min(RARE, len(n)))
    return row


def experts(sample: list[list[bytes]], model: str, row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row of each piece, and the log shares (experts, rows) and priors of a mixture of unigrams, fitted by EM from spread-out passages.
    row: that of each piece, else by the sample."""
    size = encoder(model).get_piece_size()
    ids, n = pieces([w for d in sample for w in d], model)
    of = np.repeat(np.repeat(np.arange(len(sample)), [len(d) for d in sample]), n)
    if row is None:
        row = by_frequency(np.bincount(ids, minlength=size))
    x = np.bincount(of * ROWS + row[ids], minlength=len(sample) * ROWS).reshape(len(sample), ROWS).astype(np.float32)
    total = x.sum(axis=0) + 0.1
    prior, share = np.full(EXPERTS, 1 / EXPERTS), np.tile(np.log(total / total.sum()), (EXPERTS, 1)).astype(np.float32)
    if len(sample) < EXPERTS:
        return row, share, prior
    norm = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1)
    first = [int(np.argmax(x.sum(axis=1)))]  # each next one is farthest from those before
    near = norm @ norm[first[0]]
    while len(first) < EXPERTS:
        first.append(int(np.argmin(near)))
        near = np.maximum(near, norm @ norm[first[-1]])
    r = np.eye(EXPERTS, dtype=np.float32)[(norm @ norm[first].T).argmax(axis=1)]
    for _ in range(15):
        c = r.T @ x + 20 * total / total.sum()
        share = np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32)
        prior = (r.sum(axis=0) + 1) / (len(r) + EXPERTS)
        z = x @ share.T + np.log(prior)
        r = np.exp(z - z.max(axis=1, keepdims=True))
        r = (r / r.sum(axis=1, keepdims=True)).astype(np.float32)
    return row, share, prior


UNIT_COLUMNS = ["names", *Unit.FIELDS]


def build(seen: Words, share: np.ndarray | None, prior: np.ndarray | None, texts: list[list[bytes]], hist: list[int], train: list[bool]) -> Unit:
    """A unit of parts; each part goes to the expert that gives it the most, without shares to none yet."""
    kind = seen.kinds(texts)
    here = np.zeros(len(seen.n), dtype=np.int64)
    here[kind] = 1
    used = np.flatnonzero(here)
    here[used] = np.arange(len(used))
    kind, size, n = here[kind], np.array([len(t) for t in texts], dtype=np.int64), seen.n[used]
    rows = seen.rows[ragged(seen.begin[used], n)]
    u = Unit([seen.names[k] for k in used.tolist()], kind=kind, size=size, hist=np.array(hist), train=np.array(train, dtype=np.int64), expert=np.zeros(len(size), np.int64), rows=rows, n=n)
    if share is not None:
        u.expert = u.likely(share, prior).argmax(axis=1)
    return u


def units(rows: DataFrame, row: np.ndarray, share: np.ndarray | None, prior: np.ndarray | None, model: str) -> DataFrame:
    """rows: no, _id, _train, _text. One row a unit: unit, the parts' numbers and ids, tokens and texts it teaches, bytes, how often it
    teaches each piece's row, the COMMON words it teaches most often, and the unit's arrays."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["_id"].dataType)
    sent = rows.sparkSession.sparkContext.broadcast((row, share, prior))

    def go(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        row, share, prior = sent.value
        seen, unit, held, size = Words(row, model), TaskContext.get().partitionId() << 32, [], 0

        def out(held, size, unit):
            nos, ids, train, texts, hist, last = zip(*held)
            u = build(seen, share, prior, list(texts), list(hist), list(train))
            taught = sum(len(t) - h for t, h, k in zip(texts, hist, train) if k), sum(e for e, k in zip(last, train) if k)
            d, often = u.dump(), np.bincount(u.kind[u.taught()], minlength=len(u.names))
            counts = np.bincount(u.rows, weights=np.repeat(often, u.n), minlength=int(row.max()) + 1).astype(np.uint32)
            top = [u.names[k] for k in np.argsort(-often, kind="stable")[:COMMON].tolist() if often[k]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([unit]), pa.array([list(nos)], type=pa.list_(pa.int64())), pa.array([list(ids)], type=pa.list_(id_type)), *(pa.array([x]) for x in (*taught, size)), pa.array([pack(counts)], type=pa.binary()), pa.array([top], type=pa.list_(pa.binary())), *(pa.array([d[k]], type=pa.binary()) for k in UNIT_COLUMNS)],
                names=["unit", "nos", "ids", "tokens", "texts", "bytes", "counts", "top", *UNIT_COLUMNS],
            )

        for b in batches:
            for no, i, train, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                for ws, hist, last in parts(text):
                    held.append((no, i, train, ws, hist, last))
                    size += min(len(text or b""), PART)
                    if size > UNIT:
                        yield from out(held, size, unit)
                        held, size, unit = [], 0, unit + 1
        if held:
            yield from out(held, size, unit)

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(go, f"unit long, nos array<long>, ids array<{kind}>, tokens long, texts long, bytes long, counts binary, top array<binary>, " + ", ".join(f"{k} binary" for k in UNIT_COLUMNS))


def totals(found: DataFrame) -> dict[int, np.ndarray]:
    """found: at long, x array<double>. The sum of the arrays of each `at`."""

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, x in zip(b.column(0).to_pylist(), b.column(1)):
                x = x.values.to_numpy()
                sums[at] = sums[at] + x if at in sums else x.copy()
        for at, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([x], type=pa.list_(pa.float64()))], names=["at", "x"])

    got = found.repartition("at").mapInArrow(add, "at long, x array<double>").toArrow()
    return {at: x.values.to_numpy() for at, x in zip(got.column("at").to_pylist(), got.column("x"))}


def emitted(arrays: dict[int, np.ndarray]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(list(arrays), type=pa.int64()), pa.array([np.asarray(x, dtype=np.float64) for x in arrays.values()], type=pa.list_(pa.float64()))], names=["at", "x"])


def piece_counts(every: DataFrame, size: int) -> np.ndarray:
    """How often all training texts have each piece."""

    def go(batches):
        n = np.zeros(-(-size // 64) * 64)
        for b in batches:
            for x in b.column(0).to_pylist():
                x = unpack(x)
                n[: len(x)] += x
        yield emitted(dict(enumerate(n.reshape(-1, 64))))

    got = totals(every.select("counts").mapInArrow(go, "at long, x array<double>"))
    return np.concatenate([got[k] for k in range(len(got))])[:size] if got else np.zeros(size)


def turn(every: DataFrame, row: np.ndarray, share: np.ndarray, prior: np.ndarray, asked: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A turn of EM over all training texts: the new shares and priors; and how often the asked words stand in them."""
    sent = every.sparkSession.sparkContext.broadcast((row, share, prior, {w: k for k, w in enumerate(asked)}))
    asks = len(asked)

    def go(batches):
        row, share, prior, asked = sent.value
        c, n, counts = np.zeros((ROWS, EXPERTS)), np.zeros(EXPERTS), np.zeros(asks)
        for b in batches:
            for x in zip(*(b.column(k).to_pylist() for k in range(b.num_columns))):
                u = Unit.load(*x)
                u.rows = row[u.rows].astype(np.int64)
                z = u.likely(share, prior)
                r = np.exp(z - z.max(axis=1, keepdims=True))
                r /= r.sum(axis=1, keepdims=True)
                r[r < 1e-20] = 0  # far below the last digit of any sum
                taught = u.train > 0
                n += r[taught].sum(axis=0)
                start, size = np.cumsum(u.size) - u.size + u.hist, u.size - u.hist
                by = np.zeros((len(u.names), EXPERTS))
                for k in range(EXPERTS):
                    on = np.flatnonzero(taught & (r[:, k] > 0))
                    by[:, k] = np.bincount(u.kind[ragged(start[on], size[on])], weights=np.repeat(r[on, k], size[on]), minlength=len(u.names))
                order = np.argsort(u.rows.astype(np.uint16), kind="stable")
                rows = u.rows[order]
                first = np.flatnonzero(np.diff(rows, prepend=-1))
                c[rows[first]] += np.add.reduceat(by[np.repeat(np.arange(len(u.n)), u.n)[order]], first, axis=0)
                mine = u.taught()
                kind = u.kind[mine]
                if asks:
                    at = np.array([asked.get(w, -1) for w in u.names])
                    counts[at[at >= 0]] += np.bincount(kind, minlength=len(u.names))[at >= 0]
        yield emitted(dict(enumerate(c)) | {ROWS: n, ROWS + 1: counts})

    got = totals(every.select(*UNIT_COLUMNS).mapInArrow(go, "at long, x array<double>"))
    if not got or not got[ROWS].sum():
        return share, prior, np.zeros(asks)
    c = np.stack([got[k] for k in range(ROWS)], axis=1)
    total = c.sum(axis=0) + 0.1
    c += 20 * total / total.sum()
    n = got[ROWS]
    return np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32), (n + 1) / (n.sum() + EXPERTS), got[ROWS + 1]


def spelled(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of three bytes running (the two before, or 0x20, and the byte or the 0x20 that ends the word), and how often each stands."""
    if not names:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    b = np.frombuffer(b" " + b" ".join(b" " + w for w in names) + b" ", dtype=np.uint8).astype(np.uint32)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return np.unique(code[(b[1:-1] != 32) | (b[2:] != 32)], return_counts=True)


def shares(unit: Unit, hashes: np.ndarray, common: np.ndarray, shards: int):
    """What a unit sends: (shard, sort, arrays)."""
    part, at = unit.places()
    own = at >= unit.hist[part]
    taught = own & (unit.train[part] > 0)
    pair, m = np.unique(unit.kind[taught] * EXPERTS + unit.expert[part[taught]], return_counts=True)
    shard = ((hashes >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    edge = np.searchsorted(shard[order], np.arange(shards + 1))
    by = np.argsort(where[pair // EXPERTS], kind="stable")
    pair, m = pair[by], m[by]
    pos = where[pair // EXPERTS]
    cut = np.searchsorted(pos, edge)
    for s in np.flatnonzero(np.diff(edge)).tolist():
        a, b, c, d = edge[s], edge[s + 1], cut[s], cut[s + 1]
        yield s, WORDS, (hashes[order[a:b]], (pos[c:d] - a).astype(np.uint32) * EXPERTS + (pair[c:d] % EXPERTS).astype(np.uint32), m[c:d].astype(np.uint32))
    i, shard, key, _ = unit.triples(hashes, common, shards)
    for s, k, n, _ in grouped(shard, key, (unit.train[part[i]] > 0)):
        yield s, TRIPLES, (k, n.astype(np.uint32))
    known = np.unique(unit.kind[taught])
    yield 0, SPELLING, tuple(x.astype(np.uint32) for x in spelled([unit.names[k] for k in known.tolist() if unit.names[k] != END]))


def grouped(shard: np.ndarray, key: np.ndarray, taught: np.ndarray):
    """By shard: its different keys in order, how many of the places that teach have each, and (all places in order, their key's number)."""
    order = np.argsort(key)
    if len(shard) and shard.max():
        by = shard[order]
        order = order[np.argsort(by.astype(np.uint16) if by.max() < 1 << 16 else by, kind="stable")]
    s, k = shard[order], key[order]
    first = np.ones(len(k), dtype=bool)
    first[1:] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(first)
    n = np.add.reduceat(taught[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    number = np.cumsum(first) - 1
    edge = np.flatnonzero(np.concatenate(([True], s[at][1:] != s[at][:-1], [True]))) if len(at) else [0]
    for a, b in zip(edge[:-1], edge[1:]):
        lo, hi = at[a], at[b] if b < len(at) else len(k)
        yield int(s[at[a]]), k[at[a:b]], n[a:b], (order[lo:hi], number[lo:hi] - a)


def adding(a: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The different values of all arrays, their summed weights, and each array's numbers of values."""
    value, at = np.unique(np.concatenate(a), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(weights), minlength=len(value)).astype(np.int64)
    return value, total, np.split(at, np.cumsum([len(x) for x in a])[:-1])


def answer_words(found: list[tuple], frequent: float):
    """found: (hashes, pairs, counts) of each unit. Answers (count, class) of each unit's words, and what the shard counts."""
    value, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    ats = np.split(at, np.cumsum([len(f[0]) for f in found])[:-1])
    by = np.zeros((len(value), EXPERTS), dtype=np.int64)
    for (_, pair, m), own in zip(found, ats):
        np.add.at(by.reshape(-1), own[pair // EXPERTS] * EXPERTS + pair % EXPERTS, m.astype(np.int64))
    n, cls = by.sum(axis=1), by.argmax(axis=1)
    often = n >= frequent
    rare = (n > 0) & ~often
    classes = np.zeros((EXPERTS, EXPERTS), dtype=np.int64)  # class, expert
    np.add.at(classes, cls[rare], by[rare])
    once = by[n == 1].sum(axis=0)
    stats = {"known": np.array([(n > 0).sum()]), "all": by.sum(axis=0), "once": once, "classes": classes.ravel(), "hash": value[often].view(np.int64), "by": by[often].ravel()}
    return [(n[x].astype(np.uint32), cls[x].astype(np.uint8)) for x in ats], stats


def answer_triples(found: list[tuple]):
    """found: (keys, counts) of each unit. Answers (count of the sequence, of its context, different words after the context)."""
    value, n, ats = adding([f[0] for f in found], [f[1] for f in found])
    ctx = value >> np.uint64(24)
    first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
    of = np.cumsum(np.concatenate(([0], (ctx[1:] != ctx[:-1]).astype(np.int64))))
    total, kinds = np.add.reduceat(n, first)[of], np.add.reduceat((n > 0).astype(np.int64), first)[of]
    return [(n[x].astype(np.uint32), total[x].astype(np.uint32), kinds[x].astype(np.uint32)) for x in ats]


STATS = ("known", "all", "once", "classes", "hash", "by")


def answers(every: DataFrame, common: set[bytes], shards: int, frequent: float, dealt: tuple | None = None) -> DataFrame:
    """dealt: of units of piece ids the rows, shares and priors that deal them to experts. unit, shard, sort, a, b, c: the answers to each unit; with a null unit what a shard has counted, in `stats`."""
    sent = every.sparkSession.sparkContext.broadcast((common, dealt))

    def send(batches):
        import pyarrow as pa

        common, dealt = sent.value
        for b in batches:
            for k in range(b.num_rows):
                u = Unit.load(*(b.column(1 + j)[k].as_py() for j in range(len(UNIT_COLUMNS))))
                if dealt:
                    u.deal(*dealt)
                hashes = hashed(u.names)
                is_common = np.fromiter((w in common for w in u.names), dtype=bool, count=len(u.names))
                got = [(s, sort, [(pack_sorted if sort == TRIPLES and not j else pack)(x) for j, x in enumerate(arrays)]) for s, sort, arrays in shares(u, hashes, is_common, shards)]
                unit = b.column(0)[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s if sort != SPELLING else unit % 8 for s, sort, _ in got], type=pa.int64()), pa.array([sort for _, sort, _ in got], type=pa.int32()), pa.array([unit] * len(got), type=pa.int64()), *(pa.array([x[j] if j < len(x) else None for _, _, x in got], type=pa.binary()) for j in range(3))],
                    names=["shard", "sort", "unit", "a", "b", "c"],
                )

    def reply(batches):
        import pyarrow as pa

        def out(key, held):
            sort = key[1]
            arrays = [tuple((unpack_sorted if sort == TRIPLES and not j else unpack)(x) for j, x in enumerate(h[1:]) if x is not None) for h in held]
            stats = {k: None for k in STATS}
            if sort == WORDS:
                got, stats = answer_words(arrays, frequent)
            elif sort == TRIPLES:
                got = answer_triples(arrays)
            else:
                code, n, _ = adding([x[0] for x in arrays], [x[1] for x in arrays])
                got, stats = [], stats | {"hash": code.astype(np.int64), "by": n}
            m = len(got)
            packed = [[pack(x) for x in g] for g in got]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * m, type=pa.int64()), pa.array([sort] * m, type=pa.int32()), pa.array([h[0] for h in held][:m], type=pa.int64()), *(pa.array([p[j] if j < len(p) else None for p in packed], type=pa.binary()) for j in range(3)), *(pa.nulls(m, pa.list_(pa.int64())) for _ in STATS)], names=names
            )
            if sort != TRIPLES:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], type=pa.int64()), pa.array([sort], type=pa.int32()), pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.binary()) for _ in range(3)), *(pa.array([None if stats[k] is None else stats[k]], type=pa.list_(pa.int64())) for k in STATS)], names=names)

        names, key, held = ["shard", "sort", "unit", "a", "b", "c", *STATS], None, []
        for b in batches:
            for r in zip(*(b.column(j).to_pylist() for j in range(6))):
                if r[:2] != key and held:
                    yield from out(key, held)
                    held = []
                key = r[:2]
                held.append(r[2:])
        if held:
            yield from out(key, held)

    sends = every.select("unit", *UNIT_COLUMNS).mapInArrow(send, "shard long, sort int, unit long, a binary, b binary, c binary")
    met = sends.repartition("shard", "sort").sortWithinPartitions("shard", "sort", "unit")
    return met.mapInArrow(reply, "shard long, sort int, unit long, a binary, b binary, c binary, " + ", ".join(f"{k} array<long>" for k in STATS))


class Model:
    """Word probabilities by expert, the attention, and the trust in repeated sequences."""

    def __init__(self, spelling, words_all, once, classes, often, by, prior):
        self.codes, self.code_n = spelling
        n_k = words_all.astype(np.float64)
        self.unseen = (once + 0.5) / (n_k + 1.0)
        blend = STRENGTH / (n_k + STRENGTH)
        total = max(1.0, n_k.sum())
        order = np.argsort(often.view(np.uint64))
        self.often = often.view(np.uint64)[order]
        by = by.reshape(-1, EXPERTS)[order]
        seen = (1 - self.unseen)
        self.share = (seen * ((1 - blend) * by / np.maximum(n_k, 1) + blend * by.sum(axis=1, keepdims=True) / total)).astype(np.float32)
        classes = classes.reshape(EXPERTS, EXPERTS).astype(np.float64)
        self.rare = seen * ((1 - blend) * classes / np.maximum(n_k, 1) + blend * classes.sum(axis=1, keepdims=True) / total)
        self.rare = (self.rare / np.maximum(classes.sum(axis=1, keepdims=True), 1)).astype(np.float32)  # of one occurrence
        self.net = Attention(ROWS, prior=prior)
        self.trust = np.full((6, 3), 0.5)
        self.trust[0] = 0
        self.log_spell = None

    def spelling(self, names: list[bytes]) -> np.ndarray:
        """log10 probability that an unseen word is spelled so, its end included."""
        if not names:
            return np.zeros(0)
        if self.log_spell is None:
            n2 = np.bincount(self.codes & 0xFFFF, weights=self.code_n, minlength=1 << 16).reshape(256, 256)
            p1 = (n2.sum(axis=0) + 1) / (n2.sum() + 256)
            p2 = (n2 + 5 * p1) / (n2.sum(axis=1, keepdims=True) + 5)
            self.log_spell, first = np.empty(1 << 24, dtype=np.float16), self.codes >> 16
            for a in range(256):  # by the first byte, as the whole in wider numbers is large
                mine = first == a
                own = np.bincount(self.codes[mine] & 0xFFFF, weights=self.code_n[mine], minlength=1 << 16).reshape(256, 256)
                self.log_spell[a << 16 : (a + 1) << 16] = np.log10((own + 5 * p2) / (own.sum(axis=1, keepdims=True) + 5)).ravel()
        b = np.frombuffer(b"  " + b"  ".join(names) + b" ", dtype=np.uint8).astype(np.uint32)
        code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        log = np.where((b[1:-1] != 32) | (b[2:] != 32), self.log_spell[code].astype(np.float32), 0)
        n = np.fromiter(map(len, names), dtype=np.int64, count=len(names)) + 2
        return np.add.reduceat(log, np.cumsum(n) - n).astype(np.float64)

    def word_shares(self, names: list[bytes], hashes: np.ndarray, n: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, experts): the probability of each word, and as if one occurrence less had been counted."""
        at = np.minimum(np.searchsorted(self.often, hashes), max(0, len(self.often) - 1))
        often = self.often[at] == hashes if len(self.often) else np.zeros(len(hashes), dtype=bool)
        few = np.flatnonzero(n <= 1)  # only these are spelled
        spell = np.maximum(self.unseen * 10.0 ** np.maximum(self.spelling([names[k] for k in few.tolist()]), -30)[:, None], 1e-35).astype(np.float32)
        out = self.rare[cls] * n[:, None].astype(np.float32)
        none = n[few] == 0
        out[few[none]] = spell[none]
        if often.any():
            out[often] = self.share[at[often]]
        less = out * ((n - 1) / np.maximum(n, 1))[:, None].astype(np.float32)
        less[few] = spell
        return out, less

    def layout(self, u: Unit) -> tuple[np.ndarray, np.ndarray]:
        """Rows in blocks, each part's behind an empty one; and of each word the place after which it comes."""
        part, at = u.places()
        n = u.n[u.kind]
        size = np.add.reduceat(n, np.cumsum(u.size) - u.size) + 1
        per = 1 - (-size // SPAN)
        first = (np.cumsum(per) - per + 1) * SPAN
        before = np.cumsum(n) - n
        place = (first[part] + before - before[np.cumsum(u.size) - u.size][part]).astype(np.int32)
        rows = np.full(int(per.sum()) * SPAN, ROWS, dtype=np.int32)
        rows[first] = BEGIN
        rows[ragged(place + 1, n)] = u.rows[ragged((np.cumsum(u.n) - u.n).astype(np.int32)[u.kind], n)]
        return rows.reshape(-1, SPAN), place

    def repeated(self, u: Unit, i: np.ndarray, c: np.ndarray, total: np.ndarray, kinds: np.ndarray, less: bool):
        """Of every word: trust cell (context count, what befell the word before), the repeated share, and what it passes on."""
        size = len(u.kind)
        cell, out, rest = np.zeros(size, dtype=np.int64), np.zeros(size), np.ones(size)
        if less:
            kinds, c, total = kinds - (c == 1), c - 1, total - 1
        on = total > 0
        at, c, total, kinds = i[on], c[on], total[on], kinds[on]
        cell[at] = CELLS[np.minimum(total, len(CELLS) - 1)]
        out[at], rest[at] = np.maximum(c - DISCOUNT, 0) / total, np.minimum(DISCOUNT * kinds / total, 1)
        before = np.zeros(size, dtype=np.int64)
        before[1:] = ((cell > 0).astype(np.int64) + (out > 0))[:-1]
        first = np.cumsum(u.size) - u.size
        before[first[first < size]] = 0
        return cell, before, out, rest

    def score(self, u: Unit, hashes: np.ndarray, n: np.ndarray, cls: np.ndarray, triples) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of every word (0 where it is history), and without the text's own occurrence."""
        if not hasattr(self, "tables"):
            self.tables = self.net.tables()
        both, tables = np.zeros((2, len(u.kind))), self.word_shares(u.names, hashes, n, cls)
        for span, v, (i, c, total, kinds, own) in u.stretches(triples):
            rows, place = self.layout(v)
            g = self.net.weights(rows, place, self.tables)
            for k, table in enumerate(tables):
                q = np.einsum("ij,ij->i", g, table[v.kind]).astype(np.float64)
                cell, before, out, rest = self.repeated(v, i, c, total, kinds, k == 1)
                trust = self.trust[cell, before]
                both[k, span] = np.where(own, np.log10(trust * (out + rest * q) + (1 - trust) * q), 0)
        return both[0], np.where(np.repeat(u.train, u.size) > 0, both[1], both[0])

    def fit(self, u: Unit, hashes: np.ndarray, n: np.ndarray, cls: np.ndarray, triples) -> Model:
        """On the sample, counted without itself: first the attention, then the trust by EM."""
        i, c, total, kinds, _ = triples
        _, less = self.word_shares(u.names, hashes, n, cls)
        rows, place = self.layout(u)
        like, valid = np.zeros((rows.size, EXPERTS), dtype=np.float32), np.zeros(rows.size, dtype=bool)
        like[place], valid[place] = less[u.kind], True
        like, valid = like.reshape(*rows.shape, EXPERTS), valid.reshape(rows.shape)
        live = np.flatnonzero(valid.any(axis=1))
        rng = np.random.default_rng(0)
        for turn in range(PASSES):
            order = rng.permutation(live)
            batches = ((np.concatenate((rows[b - 1], rows[b]), axis=1), valid[b], like[b]) for b in (order[a : a + BATCH] for a in range(0, len(order), BATCH)))
            self.net.train(batches, 0.02 if turn < PASSES // 2 else 0.004)
        g = self.net.weights(rows, place, self.net.tables())
        q = np.einsum("ij,ij->i", g, less[u.kind]).astype(np.float64)
        cell, before, out, rest = self.repeated(u, i, np.maximum(c, 1), np.maximum(total, 1), kinds, True)
        memory, at = out + rest * q, cell * 3 + before
        for _ in range(20):
            t = self.trust[cell, before]
            r = t * memory / np.maximum(t * memory + (1 - t) * q, 1e-300)
            self.trust = ((np.bincount(at, weights=r, minlength=18) + 0.5) / (np.bincount(at, minlength=18) + 1)).reshape(6, 3)
            self.trust[0] = 0
        return self


class Learner:
    """One task's way over the training texts of its units, from the model's start, each word as counted without itself."""

    VECTORS = Attention.NAMES[1:]

    def __init__(self, model: Model):
        self.model, self.net = model, copy.deepcopy(model.net)
        self.words, self.read = 0, np.zeros(ROWS + 1)
        self.ratio = np.zeros((18, 2 * STEPS * MOST + 1))

    def over(self, found) -> None:
        """found: units with their answers."""
        self.net.train((b for x in found for b in self.batches(*x)), RATE)

    def batches(self, u: Unit, hashes: np.ndarray, n: np.ndarray, cls: np.ndarray, triples):
        mine = u.taught()
        _, less = self.model.word_shares(u.names, hashes, n, cls)
        rows, place = self.model.layout(u)
        next_, given = np.full(rows.size, -1, dtype=np.int32), np.zeros(rows.shape, dtype=np.float32)
        next_[place[mine]] = u.kind[mine]
        next_ = next_.reshape(rows.shape)
        valid = next_ >= 0
        live = np.flatnonzero(valid.any(axis=1))
        order = np.random.default_rng(len(rows)).permutation(live)
        for a in range(0, len(order), MANY):
            b = order[a : a + MANY]
            ok = valid[b]
            yield np.concatenate((rows[b - 1], rows[b]), axis=1), ok, less.take(next_[b][ok], axis=0)
            given[b] = self.net.given
        self.words += int(mine.sum())
        self.read += np.bincount(rows[live].ravel(), minlength=ROWS + 1) + np.bincount(rows[live - 1].ravel(), minlength=ROWS + 1)
        given = given.reshape(-1)
        for span, v, (i, c, total, kinds, _) in u.stretches(triples):
            cell, before, out, rest = self.model.repeated(v, i, c, total, kinds, True)
            on = np.flatnonzero(mine[span] & (cell > 0))
            q = np.maximum(given[place[span][on]].astype(np.float64), 1e-35)
            log = np.log(np.maximum(out[on] / q + rest[on], 1e-9))
            at = np.clip(np.rint(log * STEPS), -STEPS * MOST, STEPS * MOST).astype(np.int64) + STEPS * MOST
            self.ratio += np.bincount((cell * 3 + before)[on] * self.ratio.shape[1] + at, minlength=self.ratio.size).reshape(self.ratio.shape)

    def told(self) -> dict[int, np.ndarray]:
        """Sums that tasks add up: of each read row its weight and weighted embedding, then the other parameters, then the ratios."""
        if not self.words:
            return {}
        flat = np.concatenate([getattr(self.net, k).ravel() for k in self.VECTORS])
        rows = {r: self.read[r] * np.concatenate(([1], self.net.e[r])) for r in np.flatnonzero(self.read[:ROWS]).tolist()}
        return rows | {ROWS: self.words * np.concatenate(([1], flat)), ROWS + 1: self.ratio.ravel()}

    def merged(self, told: dict[int, np.ndarray]) -> tuple[Attention, np.ndarray]:
        """The attention by the sums of all tasks, and the trust by EM."""
        net, trust = self.net, self.model.trust.copy()
        if not told:
            return net, trust
        for r, x in told.items():
            if r < ROWS:
                net.e[r] = x[1:] / x[0]
        flat, at = (told[ROWS][1:] / told[ROWS][0]).astype(np.float32), 0
        for k in self.VECTORS:
            old = getattr(net, k)
            setattr(net, k, flat[at : at + old.size].reshape(old.shape))
            at += old.size
        seen = told[ROWS + 1].reshape(self.ratio.shape)
        times, t = np.exp((np.arange(seen.shape[1]) - STEPS * MOST) / STEPS), np.full((18, 1), 0.5)
        for _ in range(20):
            t = ((seen * t * times / (t * times + 1 - t)).sum(axis=1, keepdims=True) + 0.5) / (seen.sum(axis=1, keepdims=True) + 1)
        trust[1:] = t.reshape(6, 3)[1:]
        return net, trust


def shuffled_once(df: DataFrame) -> DataFrame:
    """df over the very rows of one execution, so that several jobs read the same shuffle instead of making it again."""
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), session)


def gathered(u: Unit, hashes: np.ndarray, common: np.ndarray, shards: int, got: dict) -> tuple:
    """A unit's answers in its own order: of each word count and class; of each place with a stored context the counts."""
    shard = ((hashes >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    n, cls = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
    mine = [got[s, WORDS] for s in np.unique(shard).tolist()]
    n[order], cls[order] = np.concatenate([unpack(x[0]) for x in mine]), np.concatenate([unpack(x[1]) for x in mine])
    i, shard, key, own = u.triples(hashes, common, shards)
    counts = np.zeros((len(i), 3), dtype=np.int64)
    for s, _, _, (places, number) in grouped(shard, key, np.zeros(len(i), dtype=bool)):
        counts[places] = np.stack([unpack(x) for x in got[s, TRIPLES]], axis=1)[number]
    counts = np.ascontiguousarray(counts.T)
    return n, cls, (i, *counts, own)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Per row: the id, held_out, n_tokens, n_known, train_tokens, base_score, score, and score_without_own: for a training text as
    if each of its words had been counted once less, so that it too is scored by what the others teach."""
    import pyarrow as pa

    spark = docs.sparkSession
    arrow_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).withColumn("_train", fold(F.col("_id"), FOLDS) != HELD_OUT)
    at = F.xxhash64("_id", F.lit(3))
    sample = rows.filter("_train").select(at.alias("h"), F.expr(f"substring(_text, 1 + int(pmod(xxhash64(_id, 5), greatest(length(_text) - {FIT_CHARS}, 1))), {FIT_CHARS})").alias("t"))
    part = min(1.0, 2.0 * FIT_TEXTS / max(1, rows.filter("_train").count()))  # so that tasks send few more than are taken
    sample = sample.filter(F.pmod("h", F.lit(1 << 30)) < F.lit(int(part * (1 << 30))))
    found = [words(r.t.encode()) for r in sample.orderBy("h", "t").limit(FIT_TEXTS).collect() if r.t]
    found = [w[1:-1] if len(w) > 8 else w for w in found]  # the outer words may be cut
    found = [w for w in found if w] or [[END]]
    numbered = rows.select(F.monotonically_increasing_id().alias("no"), "_id", "_train", F.col("_text").cast("binary").alias("_text"))
    vocabulary = encoder(model).get_piece_size()
    ids = np.arange(vocabulary, dtype=np.uint16)
    every = stash(units(numbered, ids, None, None, model), "units", "none")
    row, share, prior = experts(found, model, by_frequency(piece_counts(every, vocabulary)))
    asked = sorted(bytes(r.w) for r in every.select(F.explode("top").alias("w")).distinct().collect())
    for k in range(TURNS):
        share, prior, counts = turn(every, row, share, prior, [] if k else asked)
        if not k:
            common = {asked[j] for j in np.argsort(-counts, kind="stable")[:COMMON].tolist()}
    n_all, texts, size = (x or 0 for x in every.agg(F.sum("tokens"), F.sum("texts"), F.sum("bytes")).first())
    shards = int(min(1 << 23, max(1, size // SHARD)))
    own = build(Words(ids, model), None, None, found, [0] * len(found), [False] * len(found))
    dumped = own.dump()
    own.deal(row, share, prior)
    fit_rows = spark.createDataFrame(pa.table({"unit": [SAMPLE], **{k: [dumped[k]] for k in UNIT_COLUMNS}}))  # rows would start Python workers that stay for a minute
    replies = stash(answers(every.select("unit", *UNIT_COLUMNS).unionByName(fit_rows), common, shards, max(1.0, n_all / FREQUENT), (row, share, prior)), "replies", "none")
    stats = replies.filter("unit is null")
    add = {k: np.zeros(m, dtype=np.int64) for k, m in (("known", 1), ("all", EXPERTS), ("once", EXPERTS), ("classes", EXPERTS * EXPERTS))}
    flat = lambda c: c.combine_chunks().values.to_numpy() if len(c) else np.zeros(0, np.int64)
    sums = [F.transform(F.array(*(F.sum(F.col(k)[j]) for j in range(m))), lambda x: F.coalesce(x, F.lit(0))).alias(k) for k, m in ((k, len(v)) for k, v in add.items())]
    for k, v in stats.filter(f"sort = {WORDS}").agg(*sums).first().asDict().items():
        add[k] += np.array(v, dtype=np.int64)
    got = stats.filter(f"sort = {WORDS}").select("hash", "by").toArrow()
    often, often_by = flat(got.column("hash")), flat(got.column("by"))
    got = stats.filter(f"sort = {SPELLING}").select("hash", "by").toArrow()
    code, m, _ = adding([flat(got.column("hash"))], [flat(got.column("by"))])
    v_all = int(add["known"][0])
    made = Model((code, m), add["all"], add["once"], add["classes"], often, often_by, prior)
    mine = replies.filter(F.col("unit") == SAMPLE).select("shard", "sort", "a", "b", "c").collect()
    if n_all:
        hashes, is_common = hashed(own.names), np.array([w in common for w in own.names])
        made.fit(own, hashes, *gathered(own, hashes, is_common, shards, {(r.shard, r["sort"]): tuple(bytes(x) for x in (r.a, r.b, r.c) if x is not None) for r in mine}))
    sent = spark.sparkContext.broadcast((made, common, row))
    kind = rows.schema["_id"].dataType.simpleString()
    denominator = float(np.log10(n_all + 1.0 * (v_all + 1)))

    def answered(batches):
        """Units as they come, each behind its parts' numbers and ids: (nos, ids, unit, hashes, counts, classes, triples)."""
        _, common, row = sent.value

        def out(unit, got):
            u = Unit.load(*unit[2:])
            u.rows = row[u.rows].astype(np.int64)
            hashes = hashed(u.names)
            is_common = np.fromiter((w in common for w in u.names), dtype=bool, count=len(u.names))
            return *unit[:2], u, hashes, *gathered(u, hashes, is_common, shards, got)

        key, unit, got = None, None, {}
        for b in batches:
            for r in zip(*(b.column(j).to_pylist() for j in range(b.num_columns))):
                if r[0] != key and unit:
                    yield out(unit, got)
                if r[0] != key:
                    key, unit, got = r[0], None, {}
                if r[2] is None:
                    unit = r[6:]
                else:
                    got[r[1], r[2]] = tuple(x for x in r[3:6] if x is not None)
        if unit:
            yield out(unit, got)

    def learn(batches):
        own = Learner(sent.value[0])
        own.over(x[2:] for x in answered(batches))
        yield emitted(own.told())

    def go(batches):
        import pyarrow as pa

        sent.value[0].spelling([END])  # once a worker
        made = copy.copy(sent.value[0])
        made.net, made.trust = fitted.value
        made.tables = made.net.tables()
        for nos, ids, u, hashes, n, cls, triples in answered(batches):
            log, less = made.score(u, hashes, n, cls, triples)
            mine = triples[-1]
            add = lambda x: np.add.reduceat(x, np.cumsum(u.size) - u.size)
            base = np.log10(n + 1.0) - denominator
            columns = [u.size - u.hist, add(np.where(mine, n[u.kind] > 0, False).astype(np.int64)), add(np.where(mine, base[u.kind], 0)), add(log), add(less)]
            yield pa.RecordBatch.from_arrays([pa.array(nos, type=pa.int64()), pa.array(ids, type=id_type), *map(pa.array, columns)], names=["no", "_id", "tokens", "known", "base", "score", "less"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["_id"].dataType)
    unit_rows = every.select("unit", F.lit(None).cast("long").alias("shard"), F.lit(None).cast("int").alias("sort"), *(F.lit(None).cast("binary").alias(k) for k in "abc"), "nos", "ids", *UNIT_COLUMNS)
    answer_rows = replies.filter(F.col("unit") != SAMPLE).select("unit", "shard", "sort", "a", "b", "c", F.lit(None).cast("array<long>").alias("nos"), F.lit(None).cast(f"array<{kind}>").alias("ids"), *(F.lit(None).cast("binary").alias(k) for k in UNIT_COLUMNS))
    met = shuffled_once(unit_rows.unionByName(answer_rows).repartition("unit").sortWithinPartitions("unit", F.col("sort").asc_nulls_first()))
    fitted = spark.sparkContext.broadcast(Learner(made).merged(totals(met.mapInArrow(learn, "at long, x array<double>"))))
    scored = met.mapInArrow(go, f"no long, _id {kind}, tokens long, known long, base double, score double, less double")
    whole = scored.groupBy("no").agg(F.first("_id").alias("_id"), *(F.sum(k).alias(k) for k in ("tokens", "known", "base", "score", "less")))
    return whole.select(
        F.col("_id").alias(id_col),
        (fold(F.col("_id"), FOLDS) == HELD_OUT).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
        F.col("less").alias("score_without_own"),
    )


def op1_lm_scoring(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))
