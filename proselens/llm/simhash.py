"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into so few segments that, of two fingerprints within the bit limit, some
segment differs by at most one bit. Every fingerprint is indexed under each segment with each one
of its bits as a wildcard; fingerprints that meet under a key are verified by their whole
distance. Links between different fingerprints are closed by connected components.

Copies share a fingerprint and enter the index once. Within a bucket, pairs are compared, but only
a spanning forest of the verified links leaves it. A bucket of more than HOT fingerprints is dealt
out again, so groups of any size stay distributed: of two segments and a limit of two bits by a second wildcard over the other segment, which
is exact, since any two that meet again are within two bits; of more segments by blocks of HOT / 2, each of which meets each other one, so that every
pair of the bucket is compared. Members within SURE bits of one of the bucket's hubs link to that hub and count as together with its others.

Defined results: null or empty text has fingerprint zero; fewer words than a shingle make one
shingle of all; ids may be of any type that sorts; a component has the smallest id of its rows, a null id takes part and shows null
where no other id is in its component; rows that share an id stand each for themselves, so their texts link only if they are close;
repeated rows have equal results; very long texts are read whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.llm.common import LOWER, arrow_batches, skewed_join, stash, table
from proselens.llm.components import components

LANE = 64
#: Fingerprints under one key that one task compares; beyond it, two segments are indexed at once or blocks of half as many compared.
HOT = 4096
#: Runs of up to so many are compared at fixed offsets, all of a batch at once.
SMALL = 12
#: Bits between the forests of one bucket.
LAYER = 4
#: Of 128 bits, within which members of a bucket link to its hub; a similarity of 0.8 differs in 19 on average.
SURE = 12
#: Hubs that a hot bucket has.
HUBS = 16


def shingles(text: bytes | None, size: int) -> list[bytes]:
    w = text.translate(LOWER).split() if text else []
    if len(w) <= size:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(size)))))


def hashes(found: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(s, 42) for s in found], dtype=np.uint64)


def mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself; the others are splitmix64 of it, one hash of a shingle serving all lanes."""
    if not lane:
        return h
    h = h + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: bytes | None, size: int = 3, lanes: int = 1, repeats: bool = True) -> list[int]:
    """One unsigned 64-bit integer a lane. Without repeats each different shingle has one vote."""
    found = shingles(text, size)
    if not repeats:
        found = list(set(found))
    votes = np.zeros(LANE * lanes, dtype=np.int64)
    for at in range(0, len(found), 1 << 13):
        h = hashes(found[at : at + (1 << 13)])
        h = np.stack([mixed(h, lane) for lane in range(lanes)], axis=1).astype(">u8")
        votes += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(found)).view(">u8").tolist()


def fingerprints(docs: DataFrame, size: int, lanes: int, repeats: bool, id_col: str, text_col: str) -> DataFrame:
    """_id, _t (a hash that tells the texts of one id apart), f0.. of each row."""
    arrow_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_t"), text.cast("binary").alias("_text"))

    def go(batches):
        import pyarrow as pa

        for b in batches:
            got = np.array([fingerprint(t, size, lanes, repeats) for t in b.column(2).to_pylist()], dtype=np.uint64).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(got[:, k]) for k in range(lanes))], names=["_id", "_t", *(f"f{k}" for k in range(lanes))])

    return rows.mapInArrow(go, f"_id {rows.schema['_id'].dataType.simpleString()}, _t long, " + ", ".join(f"f{k} long" for k in range(lanes)))


class Cut:
    """Segments over the lanes: (lane, shift, bits), none across a lane's border. Rows of the index carry the first
    `seen` lanes, on which the limit holds, and, if these are not all, the bit that the wildcard hides."""

    def __init__(self, lanes: int, segments: int, bits: int, seen: int | None = None):
        per = segments // lanes
        self.lanes, self.limit, self.seen = lanes, bits, seen or lanes
        self.width = self.seen + (self.seen < lanes)
        edges = [LANE * k // per for k in range(per + 1)]
        self.parts = [(lane, edges[k], edges[k + 1] - edges[k]) for lane in range(lanes) for k in range(per)]

    def keys(self, f: np.ndarray) -> np.ndarray:
        """(rows, variants): segment number, wildcard bit and the segment's other bits in one integer."""
        out = []
        for s, (lane, shift, width) in enumerate(self.parts):
            v = (f[:, lane] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            for i in range(width):
                out.append((v & ~np.uint64(1 << i)) | np.uint64((s << 48) | (i << 40)))
        return np.stack(out, axis=1)

    def hidden(self, f: np.ndarray) -> np.ndarray:
        """(rows, variants): the bit under each wildcard."""
        return np.stack([(f[:, lane] >> np.uint64(shift + i)) & np.uint64(1) for lane, shift, width in self.parts for i in range(width)], axis=1)

    def new(self, key: np.ndarray, diff: np.ndarray) -> np.ndarray:
        """Whether a pair belongs to this key: equal segments meet under each wildcard, but count under the first."""
        if self.seen < self.lanes:
            return (diff[:, self.seen] != 0) | ((key >> np.uint64(40)) & np.uint64(255) == 0)
        seg, wild = (key >> np.uint64(48)).astype(np.int64), (key >> np.uint64(40)) & np.uint64(255)
        lane, shift, width = (np.array(x)[seg] for x in zip(*self.parts))
        same = (diff[np.arange(len(diff)), lane] >> shift.astype(np.uint64)) & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))
        return (same != 0) | (wild == 0)


def close(diff: np.ndarray, limit: int, seen: int | None = None) -> np.ndarray:
    return np.bitwise_count(diff[:, :seen]).sum(axis=1, dtype=np.int64) <= limit


def hubs(f: np.ndarray, cut: Cut, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of hubs and whose within SURE bits of each: the one nearest to the majority of those left, while it has company.
    What hangs around one text so links to that text in every bucket, whoever else is in it."""
    left = np.arange(len(f))
    while len(left) > 1 and most:
        bits = np.unpackbits(f[left, : cut.seen].astype(">u8").view(np.uint8).reshape(len(left), -1), axis=1)
        middle = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(left)).view(">u8").astype(np.uint64)
        hub = left[np.bitwise_count(f[left, : cut.seen] ^ middle).sum(axis=1, dtype=np.int64).argmin()]
        near = close(f[left] ^ f[hub], SURE, cut.seen)
        if near.sum() < 2:
            return
        yield int(hub), left[near]
        left = left[~near]
        most -= 1


def forests(key: int, f: np.ndarray, cut: Cut, star: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Where links are verified later: first stars of at most SURE bits around hubs, then a forest between what is not yet together, grown
    by LAYER bits up to the limit, the closest links first: what hangs together within so many bits still does so when
    wider links of the bucket fail. star: of a block's members the number of the hub that each has been linked to, or -1."""
    if cut.seen == cut.lanes:
        yield from ((x, y) for x, y, own in forest(key, f, cut, cut.limit) if own)
        return
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    k = np.uint64(key)
    if star is not None:
        _, first, at = np.unique(star, return_index=True, return_inverse=True)
        root = np.where(star < 0, np.arange(len(f)), first[at]).tolist()
    for hub, near in hubs(f, cut, len(f)) if star is None else ():
        new = cut.new(np.full(len(near), k), f[near] ^ f[hub])  # the others meet this hub under the first wildcard too
        for y, own in zip(near.tolist(), new.tolist()):
            if y != hub:
                root[y] = hub
                if own:
                    yield hub, y
    for limit in [*range(SURE + LAYER, cut.limit, LAYER), cut.limit]:
        roots = [find(x) for x in range(len(f))]
        if roots.count(roots[0]) == len(roots):
            return
        for x, y, own in forest(key, f, cut, limit):
            a, b = find(x), find(y)
            if a != b:
                root[b] = a
                if own:
                    yield x, y


def forest(key: int, f: np.ndarray, cut: Cut, limit: int) -> Iterator[tuple[int, int, bool]]:
    """A spanning forest of the pairs of one bucket that are close, breadth first over those not yet reached; and whether a pair belongs
    to this key. The others meet under the segment's first wildcard too, and hang together there."""
    left = np.arange(len(f))
    queue: list[int] = []
    k = np.uint64(key)
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        x = queue.pop()
        diff = f[left] ^ f[x]
        near = close(diff, limit, cut.seen)
        if near.any():
            new = cut.new(np.full(int(near.sum()), k), diff[near])
            for y, own in zip(left[near].tolist(), new.tolist()):
                yield x, y, own
                queue.append(y)
            left = left[~near]


def second(key: np.ndarray, f: np.ndarray, cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers and key pairs of hot members under a second wildcard, that of the other of two segments: this bucket and each
    wildcard of the other; under the first wildcard also this segment as it is and two wildcards of the other."""
    rows, one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for s in np.unique(key >> np.uint64(48)).tolist():
        at = np.flatnonzero(key >> np.uint64(48) == np.uint64(s))
        lane, shift, width = cut.parts[1 - s]
        other = (f[at, lane] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        for j in range(width):
            rows.append(at)
            one.append(key[at])
            two.append((other & ~np.uint64(1 << j)) | np.uint64((1 - s) << 48 | j << 40))
        first = (key[at] >> np.uint64(40)) & np.uint64(255) == 0
        at, other = at[first], other[first]
        lane, shift, width = cut.parts[s]
        own = ((f[at, lane] >> np.uint64(shift)) & np.uint64((1 << width) - 1)) | np.uint64((s << 48) | (255 << 40))
        width = cut.parts[1 - s][2]
        for j in range(width):
            for m in range(j):
                rows.append(at)
                one.append(own)
                two.append((other & ~np.uint64(1 << j | 1 << m)) | np.uint64(j << 40 | m << 48))
    return np.concatenate(rows), np.concatenate(one), np.concatenate(two)


def blocks(key: np.ndarray, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys under which each hot member's block, one of `count` of its bucket, meets each block. Segment and wildcard
    stay in the key; keys that fall together only add pairs."""
    row = np.repeat(np.arange(len(key)), count)
    other = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    own = (mixed(node.view(np.uint64), 3) % count.astype(np.uint64)).astype(np.int64)[row]
    pair = np.minimum(own, other).astype(np.uint64) << np.uint64(32) | np.maximum(own, other).astype(np.uint64)
    low = np.uint64((1 << 40) - 1)
    return row, (key[row] & ~low) | (mixed(key[row] ^ mixed(pair, 1), 2) & low)


def exact(cut: Cut) -> bool:
    return len(cut.parts) == 2 and cut.limit <= 2


def scan(batches, cut: Cut, most: int | None = None, deal: bool = True):
    """Buckets come as runs of equal keys; small runs are compared at once, larger ones each, hot ones are dealt on.

    Yields links (u, v), and members to deal on: (u, key, second key), or (u, key, number of the hub that it is linked to or -1).
    most: members of a bucket that is not hot, else HOT. Without deal, buckets are pairs of blocks, with the hubs' numbers behind the fingerprints."""
    most = most or HOT
    key, node, f = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty((0, cut.width + (not deal)), np.uint64)
    hot, middle, names = None, np.empty((0, cut.width), np.uint64), []
    none = np.zeros(0, np.uint64)

    def links(u, v):
        return u, v, none, none

    def done(key, node, f):
        if not len(key):
            return
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(edge)
        run = np.repeat(size, size)
        found = [np.zeros((0, 3), np.int64)]
        for d in range(1, min(SMALL, int(size.max()))):
            i = np.flatnonzero((key[:-d] == key[d:]) & (run[:-d] <= SMALL))
            bits = np.bitwise_count((f[i] ^ f[i + d])[:, : cut.seen]).sum(axis=1, dtype=np.int64)
            ok = bits <= cut.limit
            found.append(np.stack((bits[ok], i[ok], i[ok] + d), axis=1))
        x = np.concatenate(found)
        x = x[np.argsort(x[:, 0], kind="stable")]
        new = cut.new(key[x[:, 1]], f[x[:, 1]] ^ f[x[:, 2]])
        root: dict[int, int] = {}

        def find(n):
            while (m := root.get(n, n)) != n:
                n = m
            return n

        keep = run[x[:, 1]] == 2
        for r in np.flatnonzero(~keep).tolist():  # the closest first, as in larger buckets
            a, b = find(x[r, 1]), find(x[r, 2])
            if a != b:
                root[b] = a
                keep[r] = True
        x = x[keep & new]
        if len(x):
            yield links(node[x[:, 1]], node[x[:, 2]])
        for k in np.flatnonzero(size > SMALL).tolist():
            a, b = int(edge[k]), int(edge[k + 1])
            order = a + np.argsort(node[a:b], kind="stable")  # the same start in every bucket: fewer different links
            star = None if deal else f[order, -1].view(np.int64)
            if pairs := list(forests(int(key[a]), f[order, : cut.width], cut, star)):
                x = np.array(pairs)
                yield links(node[order[x[:, 0]]], node[order[x[:, 1]]])

    def dealt(key, node, f, middle, names):
        step = 512
        for a in range(0, len(key), step):
            k, n, g = key[a : a + step], node[a : a + step], f[a : a + step]
            if exact(cut):
                r, one, two = second(k, g, cut)
                yield n[r], None, one, two
                continue
            star = np.full(len(k), -1, dtype=np.int64)
            for number, (hub, name) in enumerate(zip(middle, names)):
                diff = g ^ hub
                near = (star < 0) & close(diff, SURE, cut.seen)
                own = near & cut.new(k, diff) & (n != name)
                if own.any():
                    yield links(n[own], np.full(int(own.sum()), name))
                star[near] = number
            yield n, None, k, star.view(np.uint64)

    for b in batches:
        key = np.concatenate((key, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
        node = np.concatenate((node, b.column(1).to_numpy(zero_copy_only=False)))
        f = np.concatenate((f, np.stack([b.column(2 + k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(f.shape[1])], axis=1)))
        while len(key):
            if hot is not None:
                n = int(np.searchsorted(key != hot, True)) if (key != hot).any() else len(key)
                yield from dealt(key[:n], node[:n], f[:n], middle, names)
                key, node, f = key[n:], node[n:], f[n:]
                if not len(key):
                    break
                hot = None
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.concatenate((edge, [len(key)])))
            over = np.flatnonzero(size > most) if deal else []
            n = int(edge[over[0]]) if len(over) else int(edge[-1])
            yield from done(key[:n], node[:n], f[:n])
            key, node, f = key[n:], node[n:], f[n:]
            if not len(over):
                break
            hot = key[0]
            found = [] if exact(cut) else [h for h, _ in hubs(f[:most], cut, HUBS)]
            middle, names = f[found], node[found].tolist()
    if hot is None:
        yield from done(key, node, f)


def fingerprint_links(nodes: DataFrame, cut: Cut) -> DataFrame:
    """nodes: node long and f0.. of different fingerprints. Links u, v that connect all that are close."""
    lanes, most = cut.lanes, HOT
    fcols = [f"f{k}" for k in range(lanes)]
    cols = ["key", "node", *(f"f{k}" for k in range(cut.width))]

    def table(key, node, f, hidden):
        import pyarrow as pa

        rest = [f[:, k].view(np.int64) for k in range(cut.seen)] + ([hidden.view(np.int64)] if cut.seen < lanes else [])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), node, *rest)], names=cols)

    def numbers(b, at):
        return np.stack([b.column(at + k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(lanes)], axis=1)

    def variants(batches):
        for b in batches:
            f = numbers(b, 1)
            keys = cut.keys(f)
            n = keys.shape[1]
            yield table(keys.reshape(-1), np.repeat(b.column(0).to_numpy(zero_copy_only=False), n), np.repeat(f, n, axis=0), cut.hidden(f).reshape(-1))

    def go(batches):
        import pyarrow as pa

        for u, v, one, two in scan(batches, cut, most):
            n = len(u)
            null = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(u), *((null, pa.array(one.view(np.int64)), pa.array(two.view(np.int64))) if v is None else (pa.array(v), null, null))], names=["u", "v", "one", "two"])

    def again(batches):
        """Members of hot buckets with all lanes: their rows under each pair of blocks that has theirs."""
        import pyarrow as pa

        lane, shift = (np.array([x[k] for x in cut.parts]) for k in (0, 1))
        for b in batches:
            node, key, star, count = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            key, f = key.view(np.uint64), numbers(b, 4)
            seg, wild = (key >> np.uint64(48)).astype(np.int64), (key >> np.uint64(40)) & np.uint64(255)
            hidden = (f[np.arange(len(f)), lane[seg]] >> (shift[seg].astype(np.uint64) + wild)) & np.uint64(1)
            edge, step = np.cumsum(count), 1 << 16
            for part in np.split(np.arange(len(key)), np.flatnonzero(np.diff(edge // step)) + 1):
                r, both = blocks(key[part], node[part], count[part])
                r = part[r]
                t = table(both, node[r], f[r], hidden[r])
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(star[r])], names=[*cols, "star"])

    def last(batches):
        import pyarrow as pa

        for u, v, _, _ in scan(batches, cut, most, deal=False):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    index = nodes.select("node", *fcols).mapInArrow(variants, ", ".join(f"{c} long" for c in cols))
    met = stash(index.repartition("key").sortWithinPartitions("key").mapInArrow(go, "u long, v long, one long, two long"), "met")
    links = met.filter("v is not null").select("u", "v")
    hot = met.filter("v is null")
    if exact(cut):  # two keys leave two bits open, so at most four fingerprints meet
        met = hot.groupBy("one", "two").agg(F.min("u").alias("v"), F.collect_list("u").alias("us")).filter(F.size("us") > 1)
        return links.unionByName(met.select(F.explode("us").alias("u"), "v"))
    if hot.isEmpty():
        return links
    count = F.broadcast(hot.groupBy("one").agg(F.ceil(F.count(F.lit(1)) * 2 / most).cast("long").alias("count")))
    full = hot.select(F.col("u").alias("node"), "one", "two").join(count, "one").join(nodes, "node").select("node", "one", "two", "count", *fcols)
    more = full.mapInArrow(again, ", ".join(f"{c} long" for c in [*cols, "star"])).repartition("key").sortWithinPartitions("key", "node")
    return links.unionByName(more.mapInArrow(last, "u long, v long"))


def _text_key(id_col, text_hash):
    return F.concat_ws("/", F.col(id_col).cast("string"), F.lit("") if text_hash is None else F.col(text_hash).cast("string"))


def alike(links: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """The links whose texts share `least` of their shingles (Jaccard). Only texts with a link move; nodes name a row by id and text hash."""
    arrow_batches(docs.sparkSession)
    pairs = stash(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "pairs")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    named = nodes.join(ends, "node", "left_semi").select("node", _text_key("rep._id", "rep._t").alias("_k"))
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_t"), text.cast("binary").alias("_text")).select(_text_key("_id", "_t").alias("_k"), "_text")

    def sets(batches):
        import pyarrow as pa

        for b in batches:
            got = [np.unique(hashes(shingles(t, size)).view(np.int64)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, type=pa.list_(pa.int64()))], names=["node", "own"])

    def verify(batches):
        import pyarrow as pa

        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            keep = pa.array(keep, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["u", "v"])

    one_each = rows.join(named, "_k").groupBy("_k", "node").agg(F.first("_text").alias("_text"))  # repeated rows count once
    own = stash(one_each.select("node", "_text").mapInArrow(sets, "node long, own array<long>"), "sets")
    one = pairs.join(own.select(F.col("node").alias("u"), F.col("own").alias("x")), "u")
    two = one.join(own.select(F.col("node").alias("v"), F.col("own").alias("y")), "v")
    return two.select("u", "v", "x", "y").mapInArrow(verify, "u long, v long")


def near_groups(
    docs: DataFrame, shingle: int = 5, bits: int = 30, lanes: int = 8, segments: int = 24, seen: int = 2, least: float | None = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: the id, _t (a hash of the text), f0.. (the fingerprint's lanes as signed integers) and component_id.

    Pairs that meet and are within `bits` in the first `seen` lanes link if `least` of their shingles are shared, and
    fingerprints are then of different shingles; with no `least`, shingles vote as often as they stand and all that are within `bits` link."""
    fcols = [f"f{k}" for k in range(lanes)]
    prints = stash(fingerprints(docs, shingle, lanes, least is None, id_col, text_col), "prints")
    rep = F.min(F.struct(F.col("_id").isNull().alias("no"), "_id", "_t")).alias("rep")
    nodes = stash(prints.groupBy(*fcols).agg(rep, F.count(F.lit(1)).alias("rows")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = fingerprint_links(nodes.select("node", *fcols), Cut(lanes, segments, bits, seen))
    comp = components(links if least is None else alike(links, nodes, docs, shingle, least, id_col, text_col))
    rooted = stash(nodes.join(comp, "node", "left").select("node", *fcols, F.col("rep._id").alias("_id"), "rows", F.coalesce("root", "node").alias("root")), "rooted")
    first = rooted.groupBy("root").agg(F.min("_id").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    known = stash(skewed_join(rooted.select("node", "root", *fcols, "rows"), first, ["root"], "nodes", "node").select(*fcols, "component_id", "rows"), "known")
    return skewed_join(prints, known, fcols, "rows", "_id").select(F.col("_id").alias(id_col), "_t", *fcols, "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that have their component's smallest id, with all their columns; rows with a null id stay. Id and text decide
    together which row goes, so that rows that share an id stand each for themselves."""
    gone = near_groups(docs, id_col=id_col, text_col=text_col, **options).filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone"), "_t")
    rows = docs.select(F.struct("*").alias("_row"), F.col(f"`{id_col}`").alias("_gone"), F.xxhash64(F.col(f"`{text_col}`")).alias("_t"))
    return rows.join(gone.distinct(), ["_gone", "_t"], "left_anti").select("_row.*")


def op5_simhash_near_dedup(spark, sf_dir):
    found = near_groups(table(spark, sf_dir, "documents"), shingle=3, bits=2, lanes=1, segments=2, seen=1, least=None)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
