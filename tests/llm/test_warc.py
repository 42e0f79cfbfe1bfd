import base64
import gzip
import hashlib
import io
from pathlib import Path

import pytest

from proselens.llm import warc as W


@pytest.fixture
def pages(spark):
    body = "<p>same</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(7, "http://a.example/x?q=1", body), (3, "https://b.example/", body), (9, None, None), (4, "http://c.example/\r\nX: y é", ""), (5, "u", "Größe 漢\n"), (None, "n", body), (5, "u", "Größe 漢\n"), (8, "v", "long " * 60000)]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, refers_to string")


def test_query(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    rows = pages.collect()
    first = {}
    for r in rows:
        if r.page_id is not None:
            first[r.html or ""] = min(r.page_id, first.get(r.html or "", r.page_id))
    want = sorted(
        (str(r.page_id), len((r.html or "").encode()), base64.b32encode(hashlib.sha1((r.html or "").encode()).digest()).decode(), "response" if r.page_id == first[r.html or ""] else "revisit", None if r.page_id == first[r.html or ""] else first[r.html or ""])
        for r in rows
    )
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.op10_warc(spark, str(tmp_path)).collect())
    assert got == want


def test_files_hold_whole_captures(spark, pages, tmp_path):
    W.write_warc(pages, str(tmp_path / "w"), min_bytes=1)
    kinds = []
    for p in Path(tmp_path / "w").glob("*.gz"):
        kinds += [h["warc-type"] for h, _ in W.parse(gzip.open(p))]
    assert sorted(kinds) == ["metadata"] * 8 + ["request"] * 8 + ["response"] * 6 + ["revisit"] * 2
    got = W.captures(W.read_warc(spark, str(tmp_path / "w"), payloads=True)).collect()
    assert {(r.page_id, r.url) for r in got} == {(r.page_id, r.url or "") for r in pages.collect()}
    assert all(r.request.target_uri == r.response.target_uri for r in got)
    for r in got:
        if r.response.type == "response":
            assert r.response.payload.decode() in {p.html or "" for p in pages.collect() if p.page_id == r.page_id}


def test_no_pages(spark, pages, tmp_path):
    pages.limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert W.op10_warc(spark, str(tmp_path)).count() == 0


def record(kind, block, extra="", size=None):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{extra}Content-Length: {len(block) if size is None else size}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_broken_records_cost_no_others(spark, tmp_path):
    body = b"x" * 200_000
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    good = record("response", b"HTTP/1.1 200 OK\r\n\r\n" + body, f"WARC-Record-ID: <a>\r\nWARC-Payload-Digest: sha1:{digest}\r\n")
    bad = record("response", b"HTTP/1.1 200 OK\r\n\r\nother", f"WARC-Record-ID: <b>\r\nWARC-Payload-Digest: sha1:{digest}\r\n")
    meta = record("metadata", b"page-id: 7\r\npayload-length: x\r\n", "WARC-Concurrent-To: <a>\r\n")
    data = b"junk\nno record" * 9000 + b"\n" + good + record("request", b"abc", size=5) + record("request", b"abc", size="x") + bad + meta + record("request", b"cut")[:-5]
    kinds = [h["warc-type"] for h, _ in W.parse(io.BytesIO(data))]
    assert kinds == ["broken", "response", "broken", "broken", "response", "metadata", "broken"]
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(good))
    (tmp_path / "c.warc").write_bytes(b"")
    got = W.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.type for r in got) == ["broken"] * 5 + ["metadata"] + ["response"] * 2
    assert [(r.page_id, r.payload_bytes) for r in got if r.type == "metadata"] == [(7, None)]
