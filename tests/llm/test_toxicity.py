import random

import numpy as np
import pytest

from proselens.llm import toxicity as X


def test_kneser_ney_adds_up():
    ws, counts = [b"abc", b"abd", b"xyz"], np.array([[3.0, 0], [1, 2], [0, 4]])
    key, _ = X.grams(ws)
    gram = np.unique(key)
    shared = X._shared(gram, np.ones(len(gram)))
    hist = gram >> np.uint64(8)
    for h in np.unique(hist):
        assert 0 < shared[hist == h].sum() <= 1 + 1e-9
    m = X.KneserNey.fit(ws, counts)
    assert m.words([b"xyz"])[0] > 1 > m.words([b"abc"])[0]
    assert m.words([b"qqqq"]).shape == (1,)


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(5)
    plain = [f"{a}{b}" for a in ("an", "be", "co", "da") for b in ("ter", "lin", "sor", "mu", "ka")]
    rows, labels = [], []
    for k in range(900):
        ws = rng.choices(plain, k=rng.randint(5, 80))
        toxic = k % 6 == 0
        if toxic:
            for _ in range(2):
                ws.insert(rng.randint(0, len(ws)), "grotz" + rng.choice(["", "en", "ling", "er", "ungen"]))
        rows.append((k, " ".join(ws), 0.5))
        if k % 3 != 1:
            labels.append((k, int(toxic)))
    rows += [(2000, None, 0.0), (2001, "", 0.0), (None, "anter belin", 0.0), (5, rows[5][1], 0.5), (2002, "anter " * 30000, 0.0), (2003, "z" * 5000, 0.0)]
    spark.createDataFrame(rows, "doc_id long, text string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def test_query(spark, tables):
    path, rows = tables
    got = X.op2_toxicity(spark, path).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    own = [r for r in got if r.doc_id is not None and r.doc_id < 900]
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in own) > 0.97 * len(own)
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    clean = X.drop_toxic(docs, labels)
    assert clean.columns == docs.columns and clean.filter("doc_id % 6 = 0 and doc_id < 900").count() <= 8


def test_without_labels(spark, tables):
    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in X.score(docs, X.train(docs, none)).collect()} == {0.0}
    assert X.drop_toxic(docs.limit(0), none).count() == 0


def plain_kneser_ney(words, counts):
    """Interpolated Kneser-Ney with dictionaries over strings: the log ratio of a word, toxic to ordinary."""
    pad = lambda w: [(b"\x01" * 7 + w + b"\x02")[k : k + 8] for k in range(len(w) + 1)]
    own, both = [{}, {}], {}
    for w, pair in zip(words, counts):
        for g in pad(w):
            for k in (0, 1):
                own[k][g] = own[k].get(g, 0) + pair[k]
            both[g] = both.get(g, 0) + sum(pair)
    levels = [both]
    while len(next(iter(levels[-1]))) > 1:
        lower = {}
        for g in levels[-1]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        levels.append(lower)
    levels = {len(next(iter(lv))): lv for lv in levels}

    def shared(g):
        if not g:
            return 1 / 256
        lv = levels[len(g)]
        after = [n for x, n in lv.items() if x[:-1] == g[:-1]]
        if not after:
            return shared(g[1:])
        return max(lv.get(g, 0) - 0.75, 0) / sum(after) + 0.75 * len(after) / sum(after) * shared(g[1:])

    def p(g, k):
        after = [n for x, n in own[k].items() if x[:-1] == g[:-1] and n > 0]
        return max(own[k].get(g, 0) - 0.75, 0) / sum(after) + 0.75 * len(after) / sum(after) * shared(g) if after else shared(g)

    return lambda w: sum(np.log(p(g, 1)) - np.log(p(g, 0)) for g in pad(w))


def test_models_are_those_of_plain_kneser_ney():
    rng = random.Random(1)
    ws = sorted({bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    counts = np.array([[rng.choice([0, 0, 1, 3, 9]), rng.choice([0, 0, 1, 4])] for _ in ws], dtype=float)
    ws, counts = [w for w, c in zip(ws, counts) if c.sum()], counts[counts.sum(axis=1) > 0]
    m, plain = X.KneserNey.fit(ws, counts), plain_kneser_ney(ws, counts)
    new = [bytes(rng.choice(b"abcde") for _ in range(rng.randint(1, 12))) for _ in range(40)]
    assert m.words(ws + new) == pytest.approx([plain(w) for w in ws + new], abs=1e-4)


def test_window_features_are_those_of_loops():
    m = X.KneserNey.fit([b"aa", b"bb", b"cc"], np.array([[5.0, 0], [0, 5], [2, 2]]))
    text = b"aa bb CC bb! aa-aa cc bb " * 5
    one = {w: float(m.words([w])[0]) for w in (b"aa", b"bb", b"cc")}
    x = [one[w] for w in X.words(text)]
    want = [sum(x) / len(x), np.log(len(x))] + [max(sum(x[k : k + w]) / w for k in range(len(x) - w + 1)) for w in X.WINDOWS]
    assert m.features([text, None], {})[0] == pytest.approx(want) and not m.features([text, None], {})[1].any()
