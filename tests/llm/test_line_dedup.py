import random

import pytest

from proselens.llm import line_dedup as D


def brute(rows):
    """Every pair of places, line by line: (kept text, n_lines, n_deleted, runs) of each row."""
    docs = sorted({(i is None, i, t) for i, t in rows if t is not None}, key=lambda x: (x[0], -1 if x[1] is None else x[1], x[2]))
    lines = [t.split("\n") for _, _, t in docs]
    longest = {}
    for b, own in enumerate(lines):
        for p in range(len(own)):
            best = 0
            for a in range(b + 1):
                for q in range(len(lines[a]) if a < b else p):
                    n = 0
                    while p + n < len(own) and q + n < len(lines[a]) and own[p + n] == lines[a][q + n]:
                        n += 1
                    best = max(best, n)
            longest[b, p] = best
    out = {}
    for b, (_, i, t) in enumerate(docs):
        runs = [(p, longest[b, p]) for p in range(len(lines[b])) if longest[b, p] and longest.get((b, p - 1), 0) != longest[b, p] + 1]
        runs = [(p, n) for p, n in runs if len([w for x in lines[b][p : p + n] for w in x.split(" ") if w]) >= 5]
        gone = {k for p, n in runs for k in range(p, p + n)}
        out[i, t] = "\n".join(x for k, x in enumerate(lines[b]) if k not in gone), len(lines[b]), len(gone), runs
    return out


def check(got, rows):
    want = brute(rows)
    assert sorted((str(r.doc_id), str(r.text), r.n_lines, r.n_deleted, [tuple(x) for x in r.runs], r.deepest_copy) for r in got) == sorted(
        (str(i), str(None if t is None else want[i, t][0]), *((0, 0, [], 0) if t is None else (*want[i, t][1:], max((n for _, n in want[i, t][3]), default=0)))) for i, t in rows
    )




@pytest.mark.parametrize("seed", range(2))
def test_runs_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    bank = [f"line {k} " + " ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 5))) for k in range(12)] + ["", "", "one", "a b"]
    rows = []
    for i in range(16):
        ls = [rng.choice(bank) if rng.random() < 0.7 else f"own {i} {k} of its own" for k in range(rng.randint(1, 14))]
        if rows and rng.random() < 0.6:  # a passage of another document, of any length
            other = rng.choice(rows)[1].split("\n")
            a = rng.randint(0, len(other) - 1)
            at = rng.randint(0, len(ls))
            ls[at:at] = other[a : a + rng.randint(1, 11)]
        rows.append((i * 3, "\n".join(ls)))
    check(D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_odd_rows(spark):
    long = "\n".join(f"numbered line {k} of a very long text" for k in range(3000))
    rows = [(5, None), (7, ""), (8, "a b c d e"), (9, "a b c d e\nx"), (9, "a b c d e\nx"), (None, "x\na b c d e"), (3, "same\nsame\nsame same same"), (4, "\n\n\n"), (6, "\n\nq"), (12, "w " * 30000 + "\nx"), (2**63 - 1, "w " * 30000)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, runs string, p int, d int")
    check(D.dedup_lines(docs).collect(), rows)
    got = D.dedup_lines(spark.createDataFrame([("b", long), ("a", "first\n" + long), (None, None)], "name string, body string"), "name", "body").collect()
    found = {r.name: (r.n_deleted, r.deepest_copy, [tuple(x) for x in r.runs], r.body) for r in got}
    assert found == {"a": (0, 0, [], "first\n" + long), "b": (3000, 3000, [(0, 3000)], ""), None: (0, 0, [], None)}


def test_empty_and_unrepeated(spark):
    assert D.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = D.dedup_lines(spark.createDataFrame([(1, "one\ntwo"), (2, "three")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_deleted) for r in got) == [(1, 0), (2, 0)]
