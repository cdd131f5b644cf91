"""op2: archives against brute force, with magic inside payloads and ranges far smaller than records."""
import pytest
from llm_helpers import sha1

from jobledger.llm import warc
from jobledger.llm.common import shared_path

MAGIC = "WARC/1.0\r\n"
FAKE = f"{MAGIC}WARC-Type: response\r\nX-Record-Number: 99\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.fixture(scope="module")
def pages(spark):
    copy = "é" * 700
    rows = [(1, "http://a", "<p>hi</p>", "x"), (2, "http://b\r\nX: y", copy, "x"), (3, None, copy, "x"), (4, "u", copy, None),
            (5, "u", None, "x"), (6, "u", "", "x"), (7, "u", FAKE, "x"), (8, "u", "a" + FAKE * 50 + "b", "x"),
            (9, "u", MAGIC * 300, "x"), (10, "u", "WARC/1.0", "x"), (11, "u", "WARC/WARC/1.0\r\n\r\n", "x"),
            (12, "u", f"{MAGIC}Content-Length: 99999\r\n\r\n", "x"), (None, "u", copy, "x"), (13, "u", "z" * 20_000, "x"),
            (4, "u", copy, "x"), (14, "u", "q" * 999, "x"), (15, "u", "q" * 999, "x"), (-3, "u", "w" * 1000, "x"), (-2, "u", "w" * 1000, "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes string")


def expected(rows):
    data = [(r["page_id"], (r["html"] or "").encode()) for r in rows]
    kept = {}
    for i, p in data:
        if len(p) >= 1000 and i is not None:
            kept[p] = max(kept.get(p, i), i)
    out = []
    for i, p in data:
        revisit = i is not None and p in kept and i < kept[p]
        out.append((i, len(p), sha1(p), "revisit" if revisit else "response", kept[p] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("range_bytes", [2000, 1 << 24])
def test_round_trip(spark, pages, range_bytes):
    path = shared_path(spark, "warc-test")
    warc.write(warc.records(pages.repartition(2), "page_id", "url", "html"), path)
    got = warc.read(spark, path, range_bytes).select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(pages.collect())


def test_candidates_hold_false_records_and_chain_rejects_them(spark, pages):
    path = shared_path(spark, "warc-test")
    warc.write(warc.records(pages.coalesce(1), "page_id", "url", "html"), path)
    found = warc.candidates(warc.archive_ranges(spark, path, 4000))
    assert found.count() > pages.count() + 40
    assert warc.read(spark, path, 4000).count() == pages.count()


def test_empty(spark, pages):
    assert warc.round_trip(pages.filter("false"), "page_id", "url", "html").count() == 0


def test_archive_that_starts_with_no_record(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"junk" + FAKE.encode())
    assert warc.read(spark, f"file://{tmp_path}").count() == 0


def test_headers_are_read_row_by_row():
    import time

    from jobledger.llm.warc import MAGIC, _header
    first = MAGIC
    good = first + b"WARC-Type: response\r\nContent-Length: 3\r\n folded\r\nA:b:c\r\n\r\nabc"
    assert _header(good, 0) == ({b"warc-type": b"response", b"content-length": b"3 folded", b"a": b"b:c"}, len(good) - 3)
    for cut in range(len(good) - 3):
        assert _header(good[:cut], 0) is None, cut  # not ended here, but no fault so far
    assert _header(first + b"no field\r\n\r\n", 0) is False
    assert _header(first + b"a: 1\r\nA: 2\r\n\r\n", 0) is False
    assert _header(first + b"WARC-Concurrent-To: 1\r\nwarc-concurrent-to: 2\r\n\r\n", 0)
    page = first * 120_000  # over a megabyte of magic
    began = time.time()
    at, n = 0, 0
    while at >= 0:
        n += 1
        assert not _header(page, at)
        at = page.find(MAGIC, at + 1)
    assert n == 120_000 and time.time() - began < 10
