import hashlib

import pytest
from pyspark.errors import PySparkException

from trueframe.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, payload string"


def make(work, rows):
    return work.createDataFrame([(*r, "other", "other") for r in rows], SCHEMA).repartition(3)


LONG = "<p>é</p>" * 20
ROWS = [(1, "http://a/", LONG), (2, "http://b/", LONG), (3, None, LONG), (4, "http://c/\r\nWARC-Type: x", "short"), (5, "http://d/", "short"),
        (6, "", None), (7, "http://e/", ""), (8, "http://f/ü", "<p>" + "x" * 200_000), (None, "http://g/", LONG), (9, "u", LONG + "1"), (9, "u", LONG + "1"),
        (10, "v", LONG + "1"), (-3, "w", "y" * 99), (-4, "w", "y" * 99), (-5, "w", "y" * 100), (-6, "w", "y" * 100)]


def test_catalogue_follows_the_rule(work):
    folder = warc.write_archive(make(work, ROWS))
    got = sorted((tuple(r) for r in warc.read_catalogue(work, folder).collect()), key=str)
    want = []
    for page, _, html in ROWS:
        body = (html or "").encode()
        same = [p for p, _, h in ROWS if (h or "").encode() == body and p is not None]
        revisit = len(body) >= 100 and page != min(same)
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    assert got == sorted(want, key=str)


def test_payloads_once_and_records_exact(work):
    folder = warc.write_archive(make(work, ROWS))
    stored = work.read.parquet(f"{folder}/payloads").collect()
    assert sorted(bytes(r.payload) for r in stored) == sorted({(h or "").encode() for _, _, h in ROWS})
    rows = warc.read_records(work, folder).collect()
    assert sorted(((r.page_id, r.url, bytes(r.payload).decode()) for r in rows), key=str) == sorted(((p, u, h or "") for p, u, h in ROWS), key=str)
    for r in rows:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        assert head.count(b"WARC-Type:") == 1
        assert body[:-4] == (bytes(r.payload) if r.record_type == "response" else b"")
        assert f"Content-Length: {len(body) - 4}".encode() in head


def test_wrong_bytes_stop_the_reader(work):
    folder = warc.write_archive(make(work, ROWS))
    work.read.parquet(f"{folder}/payloads").selectExpr("digest", "concat(payload, X'00') AS payload").write.parquet(f"{folder}/bad/payloads")
    work.read.parquet(f"{folder}/headers").write.parquet(f"{folder}/bad/headers")
    with pytest.raises(PySparkException, match="digest"):
        warc.read_catalogue(work, f"{folder}/bad").collect()


def test_empty_table(work):
    assert warc.read_catalogue(work, warc.write_archive(make(work, []))).count() == 0


def test_hot_payload_is_rebuilt_in_shares(work):
    rows = [(i, f"http://{i % 3}/", LONG) for i in range(2000)] + [(5, "http://2/", LONG)] * 300 + [(9000, "x", "other")]
    folder = warc.write_archive(make(work, rows))
    assert work.read.parquet(f"{folder}/payloads").count() == 2
    got = warc.read_catalogue(work, folder)
    assert sorted((r.page_id, r.payload_bytes) for r in got.collect()) == sorted((p, len(h.encode())) for p, _, h in rows)
    assert got.filter("record_type = 'response'").count() == 2


def test_wrong_length_stops_the_reader(work):
    folder = warc.write_archive(make(work, ROWS))
    work.read.parquet(f"{folder}/headers").selectExpr(
        "page_id", "digest", "uses", "replace(header, 'Content-Length: 5', 'Content-Length: 6') AS header").write.parquet(f"{folder}/bad/headers")
    work.read.parquet(f"{folder}/payloads").write.parquet(f"{folder}/bad/payloads")
    with pytest.raises(PySparkException, match="length and digest"):
        warc.read_catalogue(work, f"{folder}/bad").collect()
