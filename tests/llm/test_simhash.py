import random

import numpy as np
import pytest

from proselens.llm import simhash as S
from proselens.llm.components import components


def brute(prints, limit):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sum((x ^ y).bit_count() for x, y in zip(prints[a], prints[b])) <= limit:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def test_fingerprint_rules():
    assert S.fingerprint(None) == S.fingerprint(b" \t") == [0]
    assert S.fingerprint(b"One TWO") == S.fingerprint(b"one\x0btwo")
    assert S.shingles("a b c d e".encode(), 3) == ["a b c d".encode(), "b c d e".encode()]


@pytest.mark.parametrize("hot", [4096, 13])
def test_links_are_those_of_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rng = random.Random(7)
    prints, n = {}, 0
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            f = base
            for b in rng.sample(range(64), rng.randint(0, 3)):
                f ^= 1 << b
            if rng.random() < 0.5:  # many that share a half
                f = (base >> 32 << 32) | (f & 0xFFFFFFFF)
            n += 1
            prints[n] = [f]
    distinct = {}
    for i, f in prints.items():
        distinct.setdefault(f[0], i)
    nodes = {i: [f] for f, i in distinct.items()}
    cut = S.Cut(1, 2, 2)
    rows = sorted((int(k), i, np.uint64(f[0])) for i, f in nodes.items() for k in cut.keys(np.array([f], dtype=np.uint64))[0])

    class Batch:
        def __init__(self, part):
            self.cols = [np.array([x[j] for x in part], dtype=t) for j, t in ((0, np.uint64), (1, np.int64), (2, np.uint64))]

        def column(self, k):
            col = self.cols[k] if k == 1 else self.cols[k].view(np.int64)
            return type("C", (), {"to_numpy": lambda s, zero_copy_only: col})()

    links, groups = [], {}
    for u, v, one, two in S.scan((Batch(rows[a : a + 37]) for a in range(0, len(rows), 37)), cut):
        if v is None:
            for x, a, b in zip(u.tolist(), one.tolist(), two.tolist()):
                groups.setdefault((a, b), []).append(x)
        else:
            links += zip(u.tolist(), v.tolist())
    assert bool(groups) == (hot == 13)
    assert max(map(len, groups.values()), default=0) <= 4
    links += [(x, min(g)) for g in groups.values() for x in g]
    root = {i: i for i in nodes}
    for _ in range(60):
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    assert root == brute(nodes, 2)


def test_components(spark):
    chain = [(i, i + 1) for i in range(10, 40)] + [(100, k) for k in range(101, 160)] + [(7, 100), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 10 for i in range(11, 41)} | {k: 7 for k in range(100, 160)}


def test_query_on_odd_rows(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "Same text here"), (5, "same  text\nhere"), (5, "same  text\nhere"), (None, "alone text"), (9, "x " * 30000)]
    rows += [(10 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, component_id string").write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op5_simhash_near_dedup(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    prints = {r.doc_id: [int(r.fingerprint, 16)] for r in got if r.doc_id is not None}
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == brute(prints, 2)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert S.op5_simhash_near_dedup(spark, f"{tmp_path}/e").count() == 0


def test_wide_prints_link_edited_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 4000)}" for _ in range(400)]
    other = [f"w{rng.randint(0, 4000)}" for _ in range(400)]
    edited = base[:]
    edited[50] = "changed"
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(other)), (4, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in S.near_dedup(docs).collect()) == [1, 3, 4]


def test_rows_that_share_an_id(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(200)) for _ in range(3))
    rows = [(1, a), (5, a + " end"), (5, b), (7, b + " end"), (7, c), (7, c), (None, c + " end"), (9, "few words"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, a), (5, b), (7, c), (7, c), (None, c + " end"), (9, "few words"), (9, None)]
    assert sorted(map(tuple, S.near_dedup(docs).collect()), key=str) == sorted(want, key=str)
    named = docs.selectExpr("concat('n', doc_id) AS doc_id", "text", "1 AS component_id", "2 AS _t")
    assert S.near_dedup(named).columns == named.columns and S.near_dedup(named).count() == len(want)


@pytest.mark.parametrize("hot", [4096, 40])
def test_large_buckets_link_like_small_ones(spark, monkeypatch, hot):
    """A base and its edits, and texts of their own: one component however the buckets are cut."""
    monkeypatch.setattr(S, "HOT", hot)
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        other = base[:]
        for at in rng.sample(range(5, 295, 10), 3):
            other[at] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(other)))
    rows += [(1000 + i, " ".join(f"y{rng.randint(0, 10**6)}" for _ in range(300))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = S.fingerprints(docs, 5, 8, False, "doc_id", "text")
    nodes = prints.selectExpr("_id AS node", *(f"f{k}" for k in range(8)))
    links = S.fingerprint_links(nodes, S.Cut(8, 24, 30, 2)).distinct().collect()
    assert len(links) < 120 * 119 // 4
    got = {r.doc_id: r.component_id for r in S.near_groups(docs).collect()}
    assert got == {i: 0 if i < 1000 else i for i, _ in rows}


def test_pairs_at_the_stated_similarity_link(spark):
    """Pairs of known Jaccard similarity: nearly all from 0.8 on link, none below links."""
    rng = random.Random(11)
    rows, pairs, i = [], [], 0
    for edits in (1, 3, 5, 6, 9):
        for _ in range(60):
            base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
            other = base[:]
            for at in rng.sample(range(5, 295, 10), edits):
                other[at] = f"x{rng.randint(0, 10**6)}"
            a, b = (set(S.shingles(" ".join(x).encode(), 5)) for x in (base, other))
            rows += [(i, " ".join(base)), (i + 1, " ".join(other))]
            pairs.append((i, len(a & b) / len(a | b)))
            i += 2
    got = {r.doc_id: r.component_id for r in S.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {i: got[i] == got[i + 1] for i, _ in pairs}
    assert not any(linked[i] for i, j in pairs if j < 0.8)
    for low, high, least in ((0.8, 0.83, 0.9), (0.83, 0.87, 0.93), (0.87, 0.93, 0.97), (0.93, 1, 0.99)):
        found = [linked[i] for i, j in pairs if low <= j < high]
        print(low, high, sum(found), len(found))
        assert len(found) >= 60 and sum(found) >= least * len(found)


@pytest.mark.parametrize("hot, count", [(40, 150), (4096, 2200)])
def test_a_hot_bucket_loses_no_pair(spark, monkeypatch, hot, count):
    """Pairs that share one segment only, that of a bucket over the limit, some of them around a hub, link as in a small bucket."""
    monkeypatch.setattr(S, "HOT", hot)
    rng, cut = random.Random(21), S.Cut(8, 24, 30, 2)
    lanes, pairs = [], []
    hub = rng.getrandbits(128 - 21) << 21

    def changed(seen, each):
        for lane, shift, width in cut.parts[1:6]:
            for bit in rng.sample(range(shift, shift + width), each):
                seen ^= 1 << bit + 64 * lane
        return seen

    for k in range(count):
        x = changed(hub, 2) if k % 3 == 0 else rng.getrandbits(128 - 21) << 21  # the first segment is zero in all
        for seen in (x, changed(x, 4)):
            lanes.append([seen & (1 << 64) - 1, seen >> 64, *(rng.getrandbits(64) for _ in range(6))])
        pairs.append((2 * k, 2 * k + 1))
    seen = np.array([x[:2] for x in lanes], dtype=np.uint64)
    near = {(a, b) for b in range(len(seen)) for a in np.flatnonzero(S.close(seen[:b] ^ seen[b], cut.limit)).tolist()}
    assert near >= set(pairs)
    rows = [(k, *(int(np.uint64(y).astype(np.int64)) for y in x)) for k, x in enumerate(lanes)]
    nodes = spark.createDataFrame(rows, "node long, " + ", ".join(f"f{k} long" for k in range(8)))
    root = {r.node: r.root for r in components(S.fingerprint_links(nodes, cut)).collect()}
    lost = [(a, b) for a, b in near if root.get(a, a) != root.get(b, b)]
    assert not lost
