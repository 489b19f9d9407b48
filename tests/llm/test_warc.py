"""WARC archives: exact round trip, revisits, ranges."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import files, warc


def brute(rows, least=0):
    whole, count = {}, {}
    for p, _, h in rows:
        data = (h or "").encode()
        count[data] = count.get(data, 0) + 1
        if p is not None:
            whole[data] = max(p, whole.get(data, p))
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        to = whole.get(data) if len(data) >= least and count[data] > 1 else None
        to = None if to == p else to
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((p, len(data), digest, "response" if to is None else "revisit", to, bytes(data) if to is None else None))
    return out


KEY = lambda r: tuple((x is None, x) for x in r)

ROWS = [
    (1, "http://a/", "<p>one</p>"), (5, None, "<p>one</p>"), (3, "http://b/ x\r\nX: y", "<p>one</p>"), (7, "u", None), (8, "u", ""), (9, "u", "é\r\n\r\nWARC/1.1\r\n"),
    (None, "n", "<p>one</p>"), (None, "n", "lonely"), (None, "n", "pair"), (None, "n", "pair"), (4, "t", "tie"), (4, "t", "tie"), (2, "t", "tie"), (10, "l", "x" * 300_000),
]


@pytest.mark.parametrize(("file_bytes", "gap", "most", "least"), [(1 << 27, 65536, 8 << 20, 0), (900, 0, 1, 0), (2000, 0, 1000, 4)])
def test_round_trip(spark, monkeypatch, tmp_path, file_bytes, gap, most, least):
    monkeypatch.setattr(warc, "FILE_BYTES", file_bytes)
    pages = spark.createDataFrame([(*r, "c", 1) for r in ROWS], "page_id bigint, url string, html string, digest string, refers_to int")
    index = warc.write_archives(pages.repartition(2), str(tmp_path / "w"), least)
    found = [tuple(None if x is None else bytes(x) if i == 5 else x for i, x in enumerate(r)) for r in warc.read_records(index, gap=gap, most=most).collect()]
    assert sorted(found, key=KEY) == sorted(brute(ROWS, least), key=KEY)
    # each record is a member of its own, and the index says where
    for r in index.collect():
        with files.open_input(r.file) as held:
            held.seek(r.offset)
            own = warc.parse(gzip.decompress(held.read(r.length)))
        assert (own["page_id"], own["payload_digest"], own["record_type"]) == (r.page_id, r.digest, r.record_type)


def test_a_selection_reads_only_its_ranges(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i} " * 50) for i in range(200)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), str(tmp_path / "w"))
    some = index.where(F.col("page_id").isin(3, 4, 5, 90, 199))
    spans = warc.ranges(some, gap=0).collect()
    assert sorted(len(r.records) for r in spans) == [1, 1, 3]
    assert sorted(r.page_id for r in warc.read_records(some, gap=0).collect()) == [3, 4, 5, 90, 199]
    assert len(warc.ranges(some).collect()) == 1


def test_a_damaged_record_is_noticed():
    data, _ = warc.record(1, "u", b"payload", None)
    assert warc.parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload", b"paylaod"))
    with pytest.raises(ValueError):
        warc.parse(data[:-1])


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    index = warc.write_archives(pages)
    assert index.count() == 0 and warc.read_records(index).count() == 0
