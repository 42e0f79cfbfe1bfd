from collections import Counter
from math import exp, log

import numpy as np
import pytest

from proselens.llm import subwords as S


@pytest.fixture(scope="module")
def voc():
    return S.Pieces(S.MODEL)


def every(text, voc):
    """All segmentations of a chunk with their probabilities, by recursion over the vocabulary."""
    log_p = {}
    rank = 0
    real = [i for i in range(len(voc.text)) if i not in voc.byte_of and i > 2]
    weight = [1 / (r + S.RANK_SHIFT) for r in range(len(real))]
    total = sum(weight) + 256 * weight[-1]
    for i, w in zip(real, weight):
        log_p[voc.text[i]] = (i, log(w / total))

    def go(rest):
        if not rest:
            return [((), 0.0)]
        out = []
        for n in range(1, len(rest) + 1):
            if rest[:n] in log_p:
                i, lp = log_p[rest[:n]]
                out += [((i, *ids), lp + q) for ids, q in go(rest[n:])]
        if rest[0] not in log_p:
            own = tuple(int(voc.bytes[b]) for b in rest[0].encode())
            out += [(own + ids, len(own) * log(weight[-1] / total) + q) for ids, q in go(rest[1:])]
        return out

    found = go(text.replace(" ", "▁"))
    z = sum(exp(q) for _, q in found)
    return {ids: exp(q) / z for ids, q in found}


def test_samples_follow_the_lattice_without_replacement(voc):
    n = 3000
    p = every(" this", voc)
    q = every(" to", voc)
    both = {a + b: x * y for a, x in p.items() for b, y in q.items()}
    got = S.segmentations(["this to"] * n, np.arange(n) * 7919, voc, 3)
    first, second = Counter(), Counter()
    for g in got:
        ids = [tuple(x[0].tolist()) for x in g]
        assert len(set(ids)) == 3
        assert g[0][2] >= g[1][2] >= g[2][2]
        for i, x in zip(ids, g):
            assert x[1] == pytest.approx(log(both[i]), abs=1e-9)
            assert x[3] <= 0
        first[ids[0]] += 1
        second[ids[1]] += 1
    expect = Counter()
    for a, x in both.items():
        for b, y in both.items():
            if a != b:
                expect[b] += x * y / (1 - x)
    for ids in sorted(both, key=both.get)[-4:]:
        assert first[ids] / n == pytest.approx(both[ids], abs=0.03)
        assert second[ids] / n == pytest.approx(expect[ids], abs=0.03)


def test_all_segmentations_when_there_are_few(voc):
    p = every(" to", voc)
    got = S.segmentations(["to"], np.array([5]), voc, len(p) + 3)[0]
    assert {tuple(x[0].tolist()) for x in got} == {i for i, x in p.items() if x > S.LEAST_MASS}
    assert got[-1][3] == 0.0


@pytest.mark.parametrize("text", [None, "", " ", "  two  spaces ", "line\n\nline", "▁ literal ▁", "naïve Größe 漢字 \U0001f600\x00", "x" * 3000, "\t tab \r\n"])
def test_round_trip(voc, text):
    for ids, lp, g, inc in S.segmentations([text], np.array([1]), voc, 3)[0]:
        assert voc.decode(ids.tolist()) == (text or "")


def test_batches_do_not_matter(voc):
    texts = ["some words here", "and others there", "third"]
    seeds = np.array([1, 2, 3])
    together = S.segmentations(texts, seeds, voc, 2)
    alone = [S.segmentations([t], seeds[k : k + 1], voc, 2)[0] for k, t in enumerate(texts)]
    for a, b in zip(together, alone):
        assert [x[0].tolist() for x in a] == [x[0].tolist() for x in b]
        assert [x[2] for x in a] == pytest.approx([x[2] for x in b])


def test_frame(spark):
    docs = spark.createDataFrame([(1, "the cat sat", "a"), (2, None, "b"), (1, "the cat sat", "c"), (None, "x y", "d")], "doc_id long, text string, ids string")
    rows = S.encode(docs, k=2).collect()
    assert all(r.decoded for r in rows)
    assert sorted({r.doc_id for r in rows if r.doc_id}) == [1, 2]
    assert [r.ids for r in rows if r.doc_id == 2][0] == [S.pieces(S.MODEL).text.index("▁")]
    back = S.decode(S.encode(docs, k=1)).collect()
    assert sorted(r.text for r in back) == ["", "the cat sat", "the cat sat", "x y"]
    assert S.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
