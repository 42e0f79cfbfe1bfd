"""SentencePiece segmentations sampled without replacement by Gumbel top-k, and their decoding.

A text is cut before its spaces and at its line ends; a piece never spans such a cut, so the lattice
of the text is the chain of its chunks' lattices. Each lattice node holds the log mass of all its
completions, which turns its edges into a distribution. The root's Gumbel value is drawn once. A search
over perturbed values then takes, again and again, the branch with the largest: the part of the lattice
that shares a prefix with an emitted segmentation and leaves it at one chunk. Its value is a
Gumbel truncated at its parent's, so the values come out in falling order, the segmentations are distinct, and they
are the ones that perturbing every path of the whole lattice would rank first. The largest value left
is the threshold of inclusion: log_inclusion is the log probability that a segmentation lies above it.

All draws are hashes of the row key and of the place in the text, so a retried or differently
batched task gives the same rows. The vocabulary file has merge ranks in place of probabilities; a
piece of rank r gets the weight 1 / (r + RANK_SHIFT), a byte the last rank's.

Defined results: null and empty texts have the one empty segmentation; texts with fewer segmentations than
asked give those they have; letters outside the vocabulary become their bytes, so decoding
gives back every text exactly; repeated rows repeat their segmentations; other columns are ignored.
Masses under 1e-13 of a chunk that stay after its emitted segmentations count as none.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.llm.common import arrow_batches, table
from proselens.llm.slots import Numbers, Slots

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
RANK_SHIFT = 3.0
#: Bytes of text that are worked on at once.
UNIT = 400_000
#: Edges of chunk lattices that a task keeps for its next texts.
KEPT_EDGES = 1_500_000
LEAST_MASS = 1e-13
SPACE, LITERAL = 0x2581, 0x200000
CHUNK = re.compile(r" +[^ \n]*|[^ \n]+|\n")


class Pieces:
    """The vocabulary as a trie: node and letter to node."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = np.full(256, -1, dtype=np.int64)
        self.byte_of = {}
        real = []
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(self.text[i][3:5], 16)] = i
                self.byte_of[i] = int(self.text[i][3:5], 16)
            elif not sp.is_control(i) and not sp.is_unknown(i):
                real.append(i)
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        weight = 1 / (np.arange(len(real)) + RANK_SHIFT)
        total = weight.sum() + 256 * weight[-1]
        self.log_byte = float(np.log(weight[-1] / total))
        log_p = dict(zip(real, np.log(weight / total).tolist()))
        child, ends, logs = {}, [-1], [0.0]
        for i in real:
            node = 0
            for c in self.text[i]:
                key = node << 21 | ord(c)
                if key not in child:
                    child[key] = len(ends)
                    ends.append(-1)
                    logs.append(0.0)
                node = child[key]
            ends[node], logs[node] = i, log_p[i]
        self.child = Slots(np.array(list(child), dtype=np.int64), np.array(list(child.values()), dtype=np.int64))
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else t.replace("▁", " ").encode() for i, t in enumerate(self.text)]
        self.ends, self.logs = np.array(ends, dtype=np.int64), np.array(logs)

        self.raw_length = np.array([len(r) for r in self.raw], dtype=np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.raw_bytes = np.frombuffer(b"".join(self.raw), dtype=np.uint8)

        self.roots = self.child.find(np.arange(1 << 14, dtype=np.int64))

    def begin(self, cps: np.ndarray) -> np.ndarray:
        """The nodes below the root by letter, from a table for the frequent ones."""
        node = self.roots[np.minimum(cps, len(self.roots) - 1)]
        far = np.flatnonzero(cps >= len(self.roots))
        node[far] = self.child.find(cps[far])
        return node

    def gives(self, ids: np.ndarray, at: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Whether the ids from at[k] to at[k + 1] decode to texts[k], for all at once."""
        size = self.raw_length[ids]
        got = self.raw_bytes[ragged(self.raw_start[ids], size)]
        sizes = np.add.reduceat(size, at[:-1])
        want = np.frombuffer(b" " + b" ".join(texts), dtype=np.uint8)
        same = sizes == np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        if same.all():
            return ~np.logical_or.reduceat(got != want, np.cumsum(sizes) - sizes)
        return np.array([self.decode(ids[a:b].tolist()).encode("utf-8", "surrogatepass") == t for a, b, t in zip(at[:-1].tolist(), at[1:].tolist(), texts)])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", errors="surrogatepass")[1:]


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def mixed(seed: np.ndarray, *place: int | np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for k, p in enumerate(place):
            seed = mix(seed + np.asarray(p).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    return seed


def uniform(seed: np.ndarray, *place: int | np.ndarray) -> np.ndarray:
    """In (0, 1), from a row's seed and a place."""
    seed = mixed(seed, *place)
    return ((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def stepped(seed: np.ndarray, step: int) -> np.ndarray:
    """In [0, 1), from mixed seeds and a count of steps; one round, as the seeds are mixed already."""
    with np.errstate(over="ignore"):
        x = seed + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    x >>= np.uint64(11)
    return x.astype(np.float64) * 2.0**-53


def uniform_one(seed: int, *place: int) -> float:
    """uniform, for one place."""
    top = (1 << 64) - 1
    for k, p in enumerate(place):
        x = (seed + p * 0x9E3779B97F4A7C15 + k + 1) & top
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & top
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & top
        seed = x ^ (x >> 31)
    return ((seed >> 11) + 0.5) * 2.0**-53


def ragged(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(lo - (ends - n), n)


class Lattice:
    """The lattices of many chunks: each node's edges together, with cumulative probabilities."""

    def __init__(self, chunks: list[str], voc: Pieces):
        cps = np.frombuffer("".join(chunks).encode("utf-32-le", errors="surrogatepass"), dtype=np.uint32).astype(np.int64)
        cps = np.where(cps == SPACE, LITERAL, np.where(cps == 32, SPACE, cps))
        size = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        self.end = np.cumsum(size)
        self.start = self.end - size
        stop = np.repeat(self.end, size)
        n = len(cps)
        at, node, depth = np.arange(n), np.zeros(n, dtype=np.int64), 0
        found = []
        single = np.zeros(n, dtype=bool)
        while len(at):
            node = voc.begin(cps) if depth == 0 else voc.child.find(node << 21 | cps[at + depth])
            ok = node >= 0
            at, node = at[ok], node[ok]
            depth += 1
            e = voc.ends[node]
            hit = e >= 0
            found.append((at[hit], np.full(int(hit.sum()), depth), e[hit], voc.logs[node[hit]]))
            if depth == 1:
                single[at[hit]] = True
            go = at + depth < stop[at]
            at, node = at[go], node[go]
        bare = np.flatnonzero(~single)
        cp = np.where(cps[bare] == LITERAL, SPACE, cps[bare])
        width = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
        found.append((bare, np.ones(len(bare), dtype=np.int64), np.where(cp < 0x80, voc.bytes[np.minimum(cp, 127)], -cp), width * voc.log_byte))
        src, length, piece, log_p = (np.concatenate(x) for x in zip(*found))
        # masses from the ends, all chunks at once: nodes at the same distance from their end go together
        away = stop[src] - src
        order = np.argsort((away * (n + 1) + src) * 32 - np.minimum(length, 31))  # a node's longest piece first: mostly the likeliest
        src, length, piece, log_p, away = src[order], length[order], piece[order], log_p[order], away[order]
        mass = np.zeros(n + 1)
        value = np.empty(len(src))
        cut = np.flatnonzero(np.diff(away, prepend=-1))
        last = stop[src] == src + length
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(src)]):
            v = log_p[a:b] + np.where(last[a:b], 0.0, mass[np.minimum(src[a:b] + length[a:b], n)])
            first = np.flatnonzero(np.diff(src[a:b], prepend=-1))
            top = np.maximum.reduceat(v, first)
            many = np.diff(np.concatenate((first, [b - a])))
            mass[src[a:b][first]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, many)), first))
            value[a:b] = v - mass[src[a:b]]
        self.size = n
        self.length, self.piece, self.log_p = length.astype(np.int32), piece.astype(np.int32), value
        p = np.exp(value)
        run = np.cumsum(p)
        first = np.flatnonzero(np.diff(src, prepend=-1))
        many = np.diff(np.concatenate((first, [len(src)])))
        run = run - np.repeat(run[first] - p[first], many)
        run[first + many - 1] = 2.0  # no draw passes a node's last edge
        self.cdf = run
        self.first, self.many = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.first[src[first]], self.many[src[first]] = first, many

    def add(self, other: Lattice) -> None:
        """other's chunks behind this one's."""
        edges, n = len(self.cdf), self.size
        self.start, self.end = np.concatenate((self.start, other.start + n)), np.concatenate((self.end, other.end + n))
        self.first = np.concatenate((self.first, other.first + edges))
        for k in ("many", "cdf", "length", "piece", "log_p"):
            setattr(self, k, np.concatenate((getattr(self, k), getattr(other, k))))
        self.size = n + other.size

    def sample(self, kind: np.ndarray, seed: np.ndarray, word: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each chunk its number of pieces, log probability and pieces (one after another)."""
        n = len(kind)
        at, end, live = self.start[kind], self.end[kind], np.arange(n)
        count, log_p = np.zeros(n, dtype=np.int64), np.zeros(n)
        steps, step = [], 0
        base = mixed(seed, word, turn)
        while len(live):
            node = at[live]
            e, x = self.first[node], stepped(base if len(live) == n else base[live], step)
            on = np.flatnonzero(self.cdf[e] <= x)
            while len(on):
                e[on] += 1
                on = on[self.cdf[e[on]] <= x[on]]
            steps.append((live, self.piece[e]))
            log_p[live] += self.log_p[e]
            node = node + self.length[e]
            at[live] = node
            count[live] += 1
            live = live[node < end[live]]
            step += 1
        base = np.cumsum(count) - count
        out = np.empty(int(count.sum()), dtype=np.int64)
        for k, (i, p) in enumerate(steps):
            out[base[i] + k] = p
        return count, np.minimum(log_p, 0.0), out


    def other(self, kind: int, taken: list[list[int]], seed: int, word: int, turn: int) -> tuple[list[int], float] | None:
        """A segmentation of one chunk, drawn from all but those taken; None if none is left."""
        at, end, step = int(self.start[kind]), int(self.end[kind]), 0
        apart = [self._rests(at, t) for t in taken]
        out, log_p = [], 0.0
        while at < end:
            a, b = int(self.first[at]), int(self.first[at] + self.many[at])
            logs, piece = self.log_p[a:b], self.piece[a:b]
            weight = np.exp(logs)
            for p in {t[step] for t in taken}:
                same = [rest[step + 1] for t, rest in zip(taken, apart) if t[step] == p]
                left = -math.expm1(same[0]) if len(same) == 1 else 1 - sum(map(math.exp, same))
                weight[piece == p] *= left if left > LEAST_MASS else 0.0
            run = np.cumsum(weight)
            if not run[-1] > 0:
                return None
            e = int(np.searchsorted(run, run[-1] * uniform_one(seed, word, turn, step), side="right"))
            e = min(e, b - a - 1)
            keep = [k for k, t in enumerate(taken) if t[step] == piece[e]]
            taken, apart = [taken[k] for k in keep], [apart[k] for k in keep]
            out.append(int(piece[e]))
            log_p += float(logs[e])
            at += int(self.length[a + e])
            step += 1
        return out, min(log_p, 0.0)

    def _rests(self, at: int, ids: list[int]) -> list[float]:
        """Log probability of the rest of a segmentation at each of its steps."""
        logs = []
        for p in ids:
            a, b = int(self.first[at]), int(self.first[at] + self.many[at])
            e = a + int(np.flatnonzero(self.piece[a:b] == p)[0])
            logs.append(float(self.log_p[e]))
            at += int(self.length[e])
        return [*np.cumsum(logs[::-1])[::-1].tolist(), 0.0]


def first_at(value: np.ndarray, begin: np.ndarray, top: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Of each owner the first place where value is its top."""
    hit = np.flatnonzero(value == top[owner])
    _, i = np.unique(owner[hit], return_index=True)
    return hit[i]


class Chunks:
    """The lattices of the chunks seen so far, begun anew when they become too many."""

    def __init__(self, voc: Pieces):
        self.voc, self.known, self.lattice = voc, Numbers(), None

    def kinds(self, chunks: list[list[str]], size: int) -> np.ndarray:
        if self.lattice is None or len(self.lattice.cdf) > KEPT_EDGES:
            self.known, self.lattice = Numbers(), None
        known, old = self.known, len(self.known)
        kind = np.fromiter(map(known.__getitem__, chain.from_iterable(chunks)), dtype=np.int64, count=size)
        if len(known) > old:
            new = Lattice(list(islice(known, old, None)), self.voc)
            if self.lattice is None:
                self.lattice = new
            else:
                self.lattice.add(new)
        return kind


def segmentations(texts: list[str | None], seeds: np.ndarray, voc: Pieces, k: int = SAMPLES, seen: Chunks | None = None) -> list[list[tuple[list[int], float, float, float]]]:
    """Per text up to k distinct segmentations, in falling order: ids, log p, perturbed log p, log inclusion."""
    chunks = [CHUNK.findall(" " + (t or "")) for t in texts]
    size = np.array([len(c) for c in chunks], dtype=np.int64)
    seen = seen or Chunks(voc)
    kind = seen.kinds(chunks, int(size.sum()))
    lat = seen.lattice
    docs = len(texts)
    owner = np.repeat(np.arange(docs), size)
    begin = np.cumsum(size) - size
    word = np.arange(len(kind)) - begin[owner]
    seed = mix(seeds.astype(np.uint64))
    pool, pooled = [], 0
    count, log_p, out = lat.sample(kind, seed[owner], word, 0)
    pool.append(out)
    pooled = len(out)
    starts, counts, logs = [np.cumsum(count) - count], [count], [log_p]
    value = [-np.log(-np.log(uniform(seed, 1, 1)))]
    parent, leave = [np.full(docs, -1)], [np.full(docs, -1)]
    alive = [np.ones(docs, dtype=bool)]
    taken = [np.exp(log_p)]  # mass of a chunk's segmentations that a branch leaves out

    def flat(s: int, j: int) -> list[int]:
        """The pieces of chunk j in sample s."""
        a = int(starts[s][j])
        for part in pool:
            if a < len(part):
                return part[a : a + int(counts[s][j])].tolist()
            a -= len(part)
        return []

    def branches(s: int, since: np.ndarray) -> np.ndarray:
        before = np.cumsum(logs[s]) - logs[s]
        before = before - before[begin][owner]
        rest = np.where(taken[s] == np.exp(logs[s]), -np.expm1(logs[s]), 1 - taken[s])  # both exact to rounding
        with np.errstate(divide="ignore", over="ignore"):
            phi = np.where((rest > LEAST_MASS) & (word >= since[owner]) & alive[s][owner], before + np.log(np.maximum(rest, LEAST_MASS)), -np.inf)
            e = -np.log(uniform(seed[owner], word, s, 77))
            return np.where(phi > -np.inf, -np.logaddexp(-value[s][owner], np.log(e) - phi), -np.inf)

    open_ = [branches(0, np.zeros(docs, dtype=np.int64))]
    for s in range(1, k):
        best = np.stack([np.maximum.reduceat(h, begin) for h in open_])
        who = best.argmax(axis=0)
        top = best.max(axis=0)
        ok = top > -np.inf
        from_h = np.stack(open_)[who[owner], np.arange(len(kind))]
        at = np.full(docs, -1)
        place = first_at(from_h, begin, np.where(ok, top, np.nan), owner)
        at[owner[place]] = place
        turn = np.flatnonzero(ok)
        j = at[turn]
        redo = np.flatnonzero(ok[owner] & (np.arange(len(kind)) >= at[owner]))
        c, lp, out = lat.sample(kind[redo], seed[owner[redo]], word[redo], s * 1000)
        new_start = np.cumsum(c) - c + pooled
        pool.append(out)
        pooled += len(out)
        pick = who[owner], np.arange(len(kind))
        st, ct, lg = (np.stack(x)[pick] for x in (starts, counts, logs))
        st[redo], ct[redo], lg[redo] = new_start, c, lp
        extra = []
        for d in turn.tolist():  # the chunk at which the branch leaves must differ from all that were taken there
            j, q, before = int(at[d]), int(who[d]), []
            while True:
                before.append(flat(q, j))
                if leave[q][d] != j:
                    break
                q = int(parent[q][d])
            drawn = lat.other(int(kind[j]), before, int(seed[d]), int(word[j]), s * 1000 + 1)
            if drawn is None:
                ok[d] = False
                continue
            st[j], ct[j], lg[j] = pooled + len(extra), len(drawn[0]), drawn[1]
            extra += drawn[0]
        turn = turn[ok[turn]]
        pool.append(np.array(extra, dtype=np.int64))
        pooled += len(extra)
        starts.append(st)
        counts.append(ct)
        logs.append(lg)
        value.append(np.where(ok, top, -np.inf))
        parent.append(who)
        leave.append(at)
        alive.append(ok)
        mass = np.exp(lg)
        j = at[turn]
        mass[j] += np.stack(taken)[who[turn], j]
        taken.append(mass)
        for q in range(s):
            open_[q][j[who[turn] == q]] = -np.inf
        open_.append(branches(s, np.where(ok, word[np.maximum(at, 0)], 1 << 40)))
    limit = np.max(np.stack([np.maximum.reduceat(h, begin) for h in open_]), axis=0)
    whole = np.concatenate(pool)
    result: list[list] = [[] for _ in texts]
    for s in range(k):
        total = np.add.reduceat(logs[s], begin)
        ids = whole[ragged(starts[s], counts[s])]
        cut = np.concatenate(([0], np.cumsum(np.add.reduceat(counts[s], begin))))
        with np.errstate(over="ignore", divide="ignore"):
            x = np.exp(np.minimum(total - limit, 700))
            inclusion = np.where(total - limit < -30, total - limit, np.log(-np.expm1(-x)))
        for d in np.flatnonzero(alive[s]).tolist():
            own = ids[cut[d] : cut[d + 1]]
            if len(own) and own.min() < 0:
                own = np.concatenate([[p] if p >= 0 else voc.bytes[list(chr(-p).encode("utf-8", errors="surrogatepass"))] for p in own.tolist()])
            result[d].append((own, float(total[d]), float(value[s][d]), float(inclusion[d])))
    return result


SCHEMA = "_id {kind}, sample int, ids array<int>, log_p double, perturbed double, log_inclusion double, decoded boolean"


def encode(docs: DataFrame, k: int = SAMPLES, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to k rows a text: the id, sample (0 first), ids, log_p, perturbed, log_inclusion, decoded (ids give back the text)."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"), F.xxhash64(F.col(f"`{id_col}`")).alias("_seed"))

    def go(batches):
        import pyarrow as pa

        voc = pieces(model)
        seen = Chunks(voc)

        def made(kind, ids, texts, seeds):
            got = segmentations(texts, np.array(seeds, dtype=np.int64), voc, k, seen)
            rows = [(i, s, *x, t) for i, t, g in zip(ids, texts, got) for s, x in enumerate(g)]
            flat = np.concatenate([r[2] for r in rows]).astype(np.int32)
            at = np.cumsum([0] + [len(r[2]) for r in rows]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], type=kind),
                    pa.array([r[1] for r in rows], type=pa.int32()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
                    *(pa.array([r[c] for r in rows], type=pa.float64()) for c in (3, 4, 5)),
                    pa.array(voc.gives(flat, at, [(r[6] or "").encode("utf-8", "surrogatepass") for r in rows])),
                ],
                names=["_id", "sample", "ids", "log_p", "perturbed", "log_inclusion", "decoded"],
            )

        ids, texts, seeds, size, kind = [], [], [], 0, None
        for b in batches:
            kind = b.column(0).type
            for i, t, s in zip(*(b.column(c).to_pylist() for c in range(3))):
                ids.append(i)
                texts.append(t)
                seeds.append(s)
                size += len(t or "")
                if size > UNIT:
                    yield made(kind, ids, texts, seeds)
                    ids, texts, seeds, size = [], [], [], 0
        if ids:
            yield made(kind, ids, texts, seeds)

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(go, SCHEMA.format(kind=kind)).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "text", model: str = MODEL) -> DataFrame:
    """encoded with the text of each id list appended; a null list gives null."""

    @F.pandas_udf("string")
    def text(ids):
        voc = pieces(model)
        return ids.map(lambda x: None if x is None else voc.decode(x.tolist()))

    return encoded.withColumn(out_col, text(F.col(ids_col)))


def op3_sentencepiece_sampling(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"))
