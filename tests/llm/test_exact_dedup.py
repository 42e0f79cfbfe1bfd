import hashlib
import re

from proselens.llm import exact_dedup as X


def test_query(spark, tmp_path):
    rows = [(5, "a  b"), (3, "a\t\nb"), (9, " a b"), (7, None), (8, ""), (2, "é\x0bé"), (4, "é é"), (4, "é é"), (None, "a b"), (11, "long " * 40000), (10, "long  " * 40000), (12, "\xa0")]
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, keep_id int").write.parquet(f"{tmp_path}/documents.parquet")
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = sorted((str(i), min(x for x in groups[norm(t)] if x is not None), len(groups[norm(t)]), i == min(x for x in groups[norm(t)] if x is not None), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept, r.text_sha256) for r in X.op4_exact_dedup(spark, str(tmp_path)).collect())
    assert got == want
    kept = X.exact_dedup(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert kept.columns == ["doc_id", "text", "keep_id"] and sorted({r.doc_id for r in kept.collect()}) == [2, 3, 7, 9, 10, 12]


def test_content_decides_when_digests_clash(spark, monkeypatch):
    monkeypatch.setattr(X.F, "sha2", lambda c, n: X.F.lit("same"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in X.exact_groups(docs).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2)}


def test_empty(spark):
    assert X.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a"), (3, "b"), (3, "c"), (3, "c"), (None, "d"), (None, "a"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, X.exact_dedup(docs).collect()), key=str)
    assert got == sorted([(1, "a"), (2, "b"), (3, "c"), (3, "c"), (None, "d"), (None, None)], key=str)
    clash = docs.selectExpr("doc_id", "text", "text as _digest", "1 as _id", "2 as _content")
    assert X.exact_dedup(clash).columns == clash.columns and X.exact_dedup(clash).count() == len(got)


def test_hot_text_is_dealt_out(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    got = X.exact_groups(docs).collect()
    assert len(got) == 3000 and {(r.keep_id, r.group_size) for r in got if r.doc_id % 3 == 0} == {(0, 1000)}
    assert all((r.keep_id, r.group_size, r.kept) == (r.doc_id, 1, True) for r in got if r.doc_id % 3)
