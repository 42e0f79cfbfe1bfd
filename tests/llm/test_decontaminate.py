import hashlib
import random

import numpy as np
import pytest

from proselens.llm import decontaminate as D


def brute(doc, items, window=8):
    ws = D.words(doc)
    hit, held = set(), []
    for name, text in items:
        iw = D.words(text)
        n = min(window, len(iw))
        wins = {tuple(iw[s : s + n]) for s in range(len(iw) - n + 1)} if n else set()
        at = [p for p in range(len(ws) - n + 1) if n and tuple(ws[p : p + n]) in wins]
        hit.update(q for p in at for q in range(p, p + n))
        if at:
            held.append(name)
    return len(ws), sorted(hit), sorted(held)


def made(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(12)]
    items = [(str(k), " ".join(rng.choice(vocab[:6]) for _ in range(rng.choice([0, 3, 7, 8, 9, 25]))).encode()) for k in range(9)]
    docs = []
    for _ in range(60):
        ws = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            iw = rng.choice(items)[1].decode().split()
            p = rng.randint(0, len(ws))
            ws[p:p] = [w.upper() + rng.choice(["", ",", " -"]) for w in iw]
        docs.append(" ".join(ws).encode())
    return docs + [None, b"", docs[5], docs[5]], items


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_what_brute_force_finds(seed):
    docs, items = made(seed)
    found = D.search_shard(docs, D.Phrases([(i, D.words(t)) for i, t in items]))
    for doc, (n, spans, held) in zip(docs, found):
        assert (n, [q for s, e in spans for q in range(s, e)], sorted(held)) == brute(doc, items)


def test_rank_and_locate():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 5, 400)
    seq[-1] = 0
    fm = D.FMIndex(seq, 4)
    lo, hi = fm.search(np.array([[0, 2, 3], [1, 1, 1]]), np.array([2, 3]))
    want = [[p for p in range(399) if list(seq[p : p + 2]) == [2, 3]], [p for p in range(398) if list(seq[p : p + 3]) == [1, 1, 1]]]
    assert [sorted(fm.locate(np.arange(a, b)).tolist()) for a, b in zip(lo, hi)] == want


def write(spark, path, docs, items):
    spark.createDataFrame([(k, None if d is None else d.decode(), "x") for k, d in enumerate(docs)], "doc_id long, text string, items string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(int(k), t.decode()) for k, t in items] + [(99, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


@pytest.mark.parametrize("block", [2_000_000, 20])
def test_query(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    docs, items = made(11)
    write(spark, tmp_path, docs, items)
    got = {r.doc_id: r for r in D.op7_benchmark_decontamination(spark, str(tmp_path)).collect()}
    for k, d in enumerate(docs):
        n, hit, held = brute(d, items)
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(held), len(held) >= 2)
        assert r.items_sha256 == hashlib.sha256(",".join(held).encode()).hexdigest()


def test_clean(spark):
    item = "one two three four five six seven eight nine"
    rows = [(1, f"Before. {item.upper()}, after", 5), (2, "clean text", None), (3, item, 1), (4, None, 0), (5, "one two three four five one two three four five six seven eight six seven eight", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in D.clean(docs, bench).collect()}
    assert got == {1: ("Before. , after", 15), 2: ("clean text", None), 4: (None, 0)}
    assert D.clean(docs.limit(0), bench).count() == 0
    assert D.clean(docs, bench.limit(0)).count() == 5


def test_blocks_keep_every_row_and_count_each_item(spark, monkeypatch):
    a, b = " ".join(f"a{k}" for k in range(9)), " ".join(f"b{k}" for k in range(9))
    docs = spark.createDataFrame([(1, f"{a} x"), (1, f"y {b}"), (2, f"{a} {b}"), (2, f"{a} {b}"), (None, a), (None, "none"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, a), (7, b), (7, a), (8, b)], "item_id long, text string").coalesce(1)

    def rows():
        return sorted((str(r.doc_id), r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in D.contamination(docs, bench).collect())

    whole = rows()
    monkeypatch.setattr(D, "BLOCK_WORDS", 9)
    assert len(whole) == 7 and ("2", 18, [(0, 18)], ["7", "7", "7", "8"]) in whole
    assert rows() == whole


def test_clean_goes_back_to_earlier_blocks(spark, monkeypatch):
    a, b = [f"a{k}" for k in range(8)], [f"b{k}" for k in range(8)]
    docs = spark.createDataFrame([(1, " ".join([*a[:4], *b, *a[4:], "rest"]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "item_id long, text string").coalesce(1)
    monkeypatch.setattr(D, "BLOCK_WORDS", 8)
    assert [r.text.split() for r in D.clean(docs, bench).collect()] == [["rest"]]
