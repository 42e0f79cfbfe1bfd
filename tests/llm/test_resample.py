import random

import pytest

from proselens.llm import resample as Q


def test_threshold_keeps_the_largest_keys(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 7)
    rng = random.Random(2)
    rows = [(k, rng.choice([rng.random(), 0.5, -3.0])) for k in range(400)] + [(None, 0.5)]
    df = spark.createDataFrame(rows, "_id long, key double")
    order = sorted(rows, key=lambda r: (-r[1], r[0] is not None, r[0] or 0))
    for k in (0, 1, 37, 200, 399, 401):
        got = {r["_id"] for r in df.filter(Q.threshold(df, k)).collect()}
        assert got == {r[0] for r in order[:k]}, k


def test_good_text_is_preferred(spark, tmp_path):
    rng = random.Random(3)
    good, junk = [f"good{k}" for k in range(200)], [f"%%{k}|" for k in range(200)]
    rows = [(k, " ".join(rng.choices(junk if k % 5 == 0 else good, k=rng.randint(1, 80)))) for k in range(600)] + [(1000, None), (1001, ""), (None, "good1"), (3, "good1 good2"), (3, "good1 good2")]
    spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, key double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(0, 600, 3)] + [(3, None), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Q.op6_importance_resampling(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    kept = [r.doc_id for r in got if r.kept]
    assert abs(len(kept) - round(0.8 * len(rows))) <= 1
    bad = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 5 == 0]
    assert sum(r.kept for r in bad) <= 0.2 * len(bad)
    assert [(r.n_grams, r.log_ratio) for r in got if r.doc_id in (1000, 1001)] == [(0, 0.0)] * 2


def test_no_labels_and_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([(k, "x y") for k in range(50)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    got = Q.resample(docs, none).collect()
    assert sum(r.kept for r in got) == 40 and {r.log_ratio for r in got} == {0.0}
    assert Q.resample(docs.limit(0), none).count() == 0


def test_weights_and_draws_are_those_of_brute_force(spark):
    """Models, mean log ratios, Gumbel values and the sample, by dictionaries and sorting."""
    import math
    import struct
    import zlib
    from collections import Counter

    from xxhash import xxh64_intdigest

    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice(["the", "Sea", "salt", "wind", f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 30)))) for k in range(150)] + [(500, None), (501, "long " * 50_000)]
    good = [k for k in range(0, 150, 4)]

    def grams(t):
        ws = (t or "").lower().encode().split()
        h = [zlib.crc32(w) for w in ws]
        return [x % 32768 for x in h] + [32768 + ((a * 0x9E3779B1 + b) * 0x85EBCA77C2B2AE63 % 2**64 >> 40) % 32768 for a, b in zip(h, h[1:])]

    every, target = Counter(g for _, t in rows for g in grams(t)), Counter(g for k, t in rows if k in set(good) for g in grams(t))
    part = lambda c, g: (c[g] + 1) / (sum(n for x, n in c.items() if (x < 32768) == (g < 32768)) + 32768)
    ratio = {g: math.log(part(target, g) / part(every, g)) for g in every}
    want = {}
    for k, t in rows:
        gs = grams(t)
        mean = sum(ratio[g] for g in gs) / len(gs) if gs else 0.0
        u = ((xxh64_intdigest(struct.pack("<i", 17), xxh64_intdigest(struct.pack("<q", k), 42)) >> 11) + 0.5) * 2.0**-53
        want[k] = len(gs), mean, mean * Q.SHARPNESS - math.log(-math.log(u))
    got = {r.doc_id: r for r in Q.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k,) for k in good], "doc_id long")).collect()}
    for k, (n, mean, key) in want.items():
        assert (got[k].n_grams, got[k].log_ratio, got[k].key) == (n, pytest.approx(mean, abs=1e-9), pytest.approx(key, abs=1e-7))
    top = sorted(want, key=lambda k: -want[k][2])[: round(0.8 * len(rows))]
    assert {k for k, r in got.items() if r.kept} == set(top)
