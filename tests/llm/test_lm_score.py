import copy
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from proselens.llm import lm_score as L
from proselens.llm.attention import EXPERTS, LENGTH, SPAN, Attention


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    vocab = ["the", "of", "tion", "sand", "Berg", "naïve", "x-ray", "reading", "writes"] + [f"word{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(vocab, [1 / (j + 1) for j in range(len(vocab))], k=rng.randint(1, 90)))) for k in range(160)]
    return rows + [(900, None), (901, ""), (902, " \x0b"), (None, "the tail"), (903, "the " * 4000), (904, "unseen" * 30), (5, rows[5][1])]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


@pytest.mark.parametrize("unit, part", [(4_000_000, 1_000_000), (3000, 700)])
def test_query(spark, docs, tmp_path, monkeypatch, unit, part):
    monkeypatch.setattr(L, "FREQUENT", 20)
    monkeypatch.setattr(L, "UNIT", unit)
    monkeypatch.setattr(L, "PART", part)
    monkeypatch.setattr(L, "SHARD", 9000)
    spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, score string, no int").write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op1_lm_scoring(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    count, texts = Counter(), {}
    for i, t in docs:
        ws = [*L.words((t or "").encode()), L.END]
        texts[i] = ws
        if not held(i):
            count.update(ws)
    n, v = sum(count.values()), len(count)
    for r in got:
        ws = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0 and math.isfinite(r.score) and math.isfinite(r.score_without_own)
        assert not r.held_out or r.score == r.score_without_own


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert L.op1_lm_scoring(spark, str(tmp_path)).count() == 0


def test_string_ids(spark):
    rows = spark.createDataFrame([(f"n{k}", f"text number {k}") for k in range(20)], "name string, body string")
    got = L.lm_scores(rows, "name", "body").collect()
    assert {r.name for r in got} == {f"n{k}" for k in range(20)} and all(r.n_tokens == 4 for r in got)


def test_counts_are_those_of_brute_force(spark, monkeypatch):
    """Units and shards of any size answer with the counts of all training texts."""
    monkeypatch.setattr(L, "UNIT", 1500)
    rng = random.Random(9)
    rows = [(k, k, k % 5 != 0, " ".join(rng.choice(["the", "of", "sea", "salt", "wind", "uncommonness", f"w{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 40))).encode()) for k in range(150)]
    table = spark.createDataFrame(rows, "no long, _id long, _train boolean, _text binary")
    row, share, prior = L.experts([L.words(t) or [L.END] for _, _, _, t in rows], L.MODEL)
    every = L.stash(L.units(table, row, share, prior, L.MODEL), "units")
    common, shards = {b"the", b"of"}, 7
    replies = L.answers(every, common, shards, 5).collect()
    word, triple, after = Counter(), Counter(), defaultdict(Counter)
    for _, _, train, t in rows:
        ws = [None, None, *L.words(t), L.END]
        if train:
            word.update(ws[2:])
            for a, b, c in zip(ws, ws[1:], ws[2:]):
                triple[a, b, c] += 1
                after[a, b][c] += 1
    assert every.count() > 3
    for r in every.collect():
        u = L.Unit.load(*(bytes(r[k]) for k in L.UNIT_COLUMNS))
        hashes, is_common = L.hashed(u.names), np.array([w in common for w in u.names])
        mine = {(x.shard, x["sort"]): tuple(bytes(y) for y in (x.a, x.b, x.c) if y is not None) for x in replies if x.unit == r.unit}
        n, _, (i, c, total, kinds, own) = L.gathered(u, hashes, is_common, shards, mine)
        assert n.tolist() == [word[w] for w in u.names] and own.all()
        names, (part, at) = [u.names[k] for k in u.kind], u.places()
        for k, x, y, z in zip(i.tolist(), c.tolist(), total.tolist(), kinds.tolist()):
            a, b = (names[k - 2] if at[k] > 1 else None), (names[k - 1] if at[k] else None)
            assert (x, y, z) == (triple[a, b, names[k]], sum(after[a, b].values()), len(after[a, b]))
        left = {b for k, b in enumerate(zip([None, *names], names)) if k not in set(i.tolist())}
        assert all((a is None or at[0] == 0 or a in common or a == L.END) for a, _ in left)
    stats = [x for x in replies if x.unit is None and x["sort"] == L.WORDS]
    assert sum(x.known[0] for x in stats) == len(word) and sum(map(sum, (x["all"] for x in stats))) == sum(word.values())
    assert sum(map(sum, (x["once"] for x in stats))) == sum(n == 1 for n in word.values())
    assert sorted(h for x in stats for h in x.hash) == sorted(L.hashed([w for w, n in word.items() if n >= 5]).view(np.int64).tolist())


def a_model():
    rng = np.random.default_rng(3)
    names = [f"w{k}".encode() for k in range(40)] + [b"new", "größe".encode(), b""]
    by = rng.integers(0, 9, (43, EXPERTS)) * (rng.random((43, EXPERTS)) < 0.4)
    by[:12] += 20
    by[40:] = 0
    by[39] = 0
    by[39, 2] = 1
    n, cls = by.sum(axis=1), by.argmax(axis=1)
    rare, classes = (n > 0) & (n < 100), np.zeros((EXPERTS, EXPERTS), dtype=np.int64)
    np.add.at(classes, cls[rare], by[rare])
    often = n >= 100
    hashes = L.hashed(names)
    made = L.Model(L.spelled(names[:42]), by.sum(axis=0), by[n == 1].sum(axis=0), classes.ravel(), hashes[often].view(np.int64), by[often].ravel(), np.full(EXPERTS, 1 / EXPERTS))
    return made, names, hashes, n, cls


def test_probabilities_add_up_to_one():
    made, names, hashes, n, cls = a_model()
    share, _ = made.word_shares(names, hashes, n, cls)
    assert share[n > 0].sum(axis=0) + made.unseen == pytest.approx(np.ones(EXPERTS), rel=1e-5)
    one, table = made.spelling([b"ab", b"w1", "ö".encode()]), made.log_spell.reshape(1 << 16, 256).astype(np.float64)
    assert (10.0**table).sum(axis=1) == pytest.approx(np.ones(1 << 16), rel=4e-3)
    want = lambda w: sum(table[x << 8 | y, z] for x, y, z in zip(b"  " + w, b" " + w, w + b" "))
    assert one == pytest.approx([want(b"ab"), want(b"w1"), want("ö".encode())], abs=1e-4)


def test_gradients():
    rng = np.random.default_rng(2)
    net = Attention(50, 1)
    batch = (rng.integers(0, 51, (3, LENGTH)), rng.random((3, SPAN)) < 0.9, rng.random((3, SPAN, EXPERTS)))
    batch[0][:, SPAN:] = rng.integers(0, 50, (3, SPAN))
    for k in Attention.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    rows = batch[0].reshape(6, SPAN)
    place = np.concatenate([np.flatnonzero(v) + (2 * b + 1) * SPAN for b, v in enumerate(batch[1])])

    def loss():
        g = net.weights(rows, place, net.tables()).astype(float)
        return -np.log((g * batch[2][batch[1]]).sum(axis=1)).mean()

    for k, g in net.gradients(*batch).items():
        x = getattr(net, k)
        for at in list(np.ndindex(x.shape))[:: max(1, x.size // 7)]:
            old = x[at]
            x[at] = old + 1e-3
            up = loss()
            x[at] = old - 1e-3
            down = loss()
            x[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-3, abs=3e-4)


def test_each_word_once_whatever_the_unit():
    """A unit of many texts against one word at a time with its own context only."""
    made, names, hashes, n, cls = a_model()
    rng = random.Random(6)
    made.net.bias += np.random.default_rng(0).random(LENGTH).astype(np.float32)
    made.net.w2 *= 20
    made.trust = np.random.default_rng(1).random((6, 3))
    made.trust[0] = 0
    row = np.arange(32000, dtype=np.int64) % 4000
    texts = [[rng.choice(names[:42]) for _ in range(k)] + [L.END] for k in (0, 1, 5, 60, 23)]
    seen = L.Words(row.astype(np.uint16), L.MODEL)
    share, prior = np.zeros((EXPERTS, L.ROWS), dtype=np.float32), np.full(EXPERTS, 1 / EXPERTS)
    u = L.build(seen, share, prior, texts, [0] * 5, [True, False, True, True, True])
    h = L.hashed(u.names)
    of = dict(zip(names, zip(n, cls)))
    m, c = (np.array([of.get(w, (0, 0))[j] for w in u.names]) for j in (0, 1))
    i, _, _, own = u.triples(h, np.zeros(len(h), dtype=bool), 4)
    assert len(i) == len(u.kind) - 5  # all but each text's first word, whose context is its beginning
    draw = np.random.default_rng(5)
    total = draw.integers(0, 30, len(i))
    count = draw.integers(0, 1 + total)
    kinds = np.where(count > 0, 1, 0) + np.where(total > count, draw.integers(1, 4, len(i)), 0)
    got, less = made.score(u, h, m, c, (i, count, total, kinds, own))
    shares = made.word_shares(u.names, h, m, c)
    place, net, before = dict(zip(i.tolist(), range(len(i)))), made.net, 0
    for number, t in enumerate(texts):
        rows, state = [L.BEGIN], [0, 0]
        for w in t:
            k = len(rows) - 1
            x = net.e[rows[max(0, SPAN * (k // SPAN - 1)) :]].astype(float)
            s = np.array([x[-1] @ net.wq @ (y @ net.wk) for y in x]) / math.sqrt(net.wq.shape[1]) + np.array([net.bias[len(x) - 1 - j] for j in range(len(x))])
            a = np.exp(s - s.max())
            z = x[-1] @ net.w1 + (a / a.sum()) @ (x @ net.wv) @ net.w2 + net.c
            g = np.exp(z - z.max())
            found = []
            for own in (0, 1):
                p = q = g @ shares[own][u.kind[before]] / g.sum()
                now = 0
                if before in place and total[place[before]] > own:
                    j = place[before]
                    n3, n2, n1 = count[j] - own, total[j] - own, kinds[j] - (own and count[j] == 1)
                    repeated = max(n3 - L.DISCOUNT, 0) / n2
                    trust = made.trust[min(5, 1 + math.ceil(math.log2(n2))), state[own]]
                    p = trust * (repeated + min(1, L.DISCOUNT * n1 / n2) * q) + (1 - trust) * q
                    now = 2 if repeated else 1
                found.append(math.log10(p))
                state[own] = now
            assert got[before] == pytest.approx(found[0], rel=1e-3)
            assert less[before] == pytest.approx(found[number != 1], rel=1e-3)  # text 1 teaches nothing
            before += 1
            rows += row[L.pieces([w], L.MODEL)[0]].tolist()


def test_parts_of_a_long_text(monkeypatch):
    monkeypatch.setattr(L, "PART", 50)
    text = b" ".join(f"word{k}".encode() for k in range(200))
    found = list(L.parts(text))
    assert len(found) > 10 and [w for ws, hist, _ in found for w in ws[hist:]] == [*text.split(), L.END]
    assert all(ws[:hist] == prev[-hist:] for (prev, _, _), (ws, hist, _) in zip(found, found[1:])) and [e for _, _, e in found].count(True) == 1
    assert list(L.parts(b"x" * 120)) == [([b"x" * 120, L.END], 0, True)]


def test_beats_its_base_and_knows_copies(spark):
    rng = random.Random(8)
    a, b = [f"al{k}" for k in range(300)], [f"be{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choices(a if k % 2 else b, [1 / (j + 2) for j in range(300)], k=120))) for k in range(900)]
    rows += [(1000 + k, rows[k][1]) for k in range(0, 60)]
    got = L.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)
    twice = {k for k in range(60)} | {1000 + k for k in range(60)}
    taught = {k for k in twice if not held((k + 1000) if k < 1000 else k - 1000)}  # the other copy is a training text
    copies = [r.score_without_own / r.n_tokens for r in got if r.doc_id in taught]
    alone = [r.score_without_own / r.n_tokens for r in got if r.doc_id not in twice]
    assert sorted(copies)[len(copies) // 10] > max(alone)


def test_experts_are_those_of_all_training_texts(spark, monkeypatch):
    """A turn of EM over units against all texts at once, and the counts of the asked words."""
    monkeypatch.setattr(L, "UNIT", 1500)
    rng = random.Random(10)
    rows = [(k, k, k % 4 != 0, " ".join(rng.choice(["the", "of", "sea", "salt", f"w{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 40))).encode()) for k in range(120)]
    ids = np.arange(L.encoder(L.MODEL).get_piece_size(), dtype=np.uint16)
    every = L.stash(L.units(spark.createDataFrame(rows, "no long, _id long, _train boolean, _text binary"), ids, None, None, L.MODEL), "units")
    assert every.count() > 3
    taught = [[*L.words(t), L.END] for _, _, train, t in rows if train]
    got = [L.pieces(ws, L.MODEL)[0] for ws in taught]
    n = np.bincount(np.concatenate(got), minlength=len(ids))
    assert L.piece_counts(every, len(ids)).tolist() == n.tolist()
    row = L.by_frequency(n)
    rng = np.random.default_rng(1)
    share = np.log(rng.dirichlet(np.ones(L.ROWS), EXPERTS)).astype(np.float32)
    prior = rng.dirichlet(np.ones(EXPERTS))
    new, new_prior, asked = L.turn(every, row, share, prior, [b"sea", b"w3", b"absent"])
    x = np.stack([np.bincount(row[g], minlength=L.ROWS) for g in got])
    z = x @ share.T.astype(float) + np.log(prior)
    r = np.exp(z - z.max(axis=1, keepdims=True))
    r /= r.sum(axis=1, keepdims=True)
    c = r.T @ x
    total = c.sum(axis=0) + 0.1
    c += 20 * total / total.sum()
    assert new == pytest.approx(np.log(c / c.sum(axis=1, keepdims=True)), abs=1e-3)
    assert new_prior == pytest.approx((r.sum(axis=0) + 1) / (len(r) + EXPERTS), abs=1e-4)
    assert asked.tolist() == [sum(ws.count(w) for ws in taught) for w in (b"sea", b"w3", b"absent")]


def test_every_training_word_fits_the_model(spark, monkeypatch):
    """Whatever the sample that starts it, attention and trust are those of all training words."""
    monkeypatch.setattr(L, "FIT_TEXTS", 2)
    monkeypatch.setattr(L, "UNIT", 4000)
    monkeypatch.setattr(L, "COMMON", 3)
    rng, met = random.Random(13), []
    rows = [(k, " ".join(rng.choice([f"a{k % 7}", "of", f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(1, 60)))) for k in range(300)]
    merged = L.Learner.merged

    def watched(self, told):
        start = copy.deepcopy(self.net)
        met.append((told, start, *merged(self, told)))
        return met[0][2:]

    monkeypatch.setattr(L.Learner, "merged", watched)
    got = L.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    told, start, net, trust = met[0]
    assert told[L.ROWS][0] == got[0].train_tokens > 5000
    texts = [L.words(t.encode()) for i, t in rows if not held(i)]
    pieces = {p for ws in texts for p in L.pieces([*ws, L.END], L.MODEL)[0].tolist()}
    assert len([r for r in told if r < L.ROWS]) == len(pieces) + 1  # and a text's beginning
    assert abs(net.w2 - start.w2).max() > 0 and told[L.ROWS + 1].sum() > 100 and (trust[1:] != 0.5).any()


def test_scoring_takes_stretches_of_a_unit(monkeypatch):
    """Memory beside the unit and its answers is that of a stretch; the scores and ratios are those of the whole."""
    made, names, hashes, n, cls = a_model()
    rng = random.Random(12)
    seen = L.Words(np.arange(32000, dtype=np.uint16) % 4000, L.MODEL)
    texts = [[rng.choice(names[:42]) for _ in range(rng.randint(0, 800))] + [L.END] for _ in range(600)]
    u = L.build(seen, np.zeros((EXPERTS, L.ROWS), dtype=np.float32), np.full(EXPERTS, 1 / EXPERTS), texts, [0] * 600, [k % 3 > 0 for k in range(600)])
    h, of = L.hashed(u.names), dict(zip(names, zip(n, cls)))
    m, c = (np.array([of.get(w, (0, 0))[j] for w in u.names]) for j in (0, 1))
    i, _, _, own = u.triples(h, np.arange(len(h)) % 2 > 0, 4)
    draw = np.random.default_rng(5)
    total = draw.integers(1, 30, len(i))
    count = draw.integers(1, 1 + total)
    triples = (i, count, total, 1 + (total > count), own)
    made.spelling(names)
    made.tables = made.net.tables()
    tracemalloc.start()
    got = made.score(u, h, m, c, triples)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(u.kind) > 200_000 and most < 90 * len(u.kind)
    learner = L.Learner(made)
    learner.over([(u, h, m, c, triples)])
    monkeypatch.setattr(L, "STRETCH", 1 << 40)
    whole = L.Learner(made)
    whole.over([(u, h, m, c, triples)])
    assert all(x.tolist() == y.tolist() for x, y in zip(got, made.score(u, h, m, c, triples)))
    assert whole.ratio.tolist() == learner.ratio.tolist() and learner.ratio.sum() > 10_000


def test_no_workers_for_the_sample(spark, monkeypatch):
    """Rows dealt out by parallelize would pass through Python workers of their own, which stay beside those of the next stages."""
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: pytest.fail("parallelize"))
    assert L.lm_scores(spark.range(9).selectExpr("id doc_id", "'a b c' text")).count() == 9


def test_only_places_that_ask_are_computed(monkeypatch):
    """Windows' places before which no word ends take no part, and words counted more than once are not spelled."""
    rng = np.random.default_rng(7)
    net, rows, met = Attention(50, 1), rng.integers(0, 50, (40, SPAN)).astype(np.int32), []
    place = np.sort(rng.choice(np.arange(SPAN, rows.size), 150, replace=False))
    exp = np.exp
    monkeypatch.setattr(np, "exp", lambda x, *a, **b: met.append(x.size) or exp(x, *a, **b))
    net.weights(rows, place, net.tables())
    assert sum(met) == 150 * (LENGTH + EXPERTS)
    ids, valid, like = rng.integers(0, 50, (9, LENGTH)), rng.random((9, SPAN)) < 0.4, rng.random((9, SPAN, EXPERTS)).astype(np.float32)
    met.clear()
    whole = net.gradients(ids, valid, like)
    assert sum(met) == valid.sum() * (LENGTH + EXPERTS)
    assert all((g == whole[k]).all() for k, g in net.gradients(ids, valid, like[valid]).items())
    made, names, hashes, n, cls = a_model()
    monkeypatch.setattr(made, "spelling", lambda ws: met.append(ws) or np.zeros(len(ws)))
    made.word_shares(names, hashes, n, cls)
    assert met[-1] == [w for w, k in zip(names, n) if k < 2]
