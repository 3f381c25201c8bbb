import gzip
import hashlib

import pytest

from reviewgate.llm import warc
from reviewgate.session import scratch_path

BIG = "<p>ä</p>" * 200


def rows():
    return [
        (1, "http://a/1", BIG),
        (2, "http://a/2", BIG),
        (9, "http://a/9", BIG),
        (3, None, "small"),
        (4, "http://a/4", "small"),
        (5, "http://a/\r\nX: y", None),
        (6, "", ""),
        (7, "http://a/7", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 60),
        (8, "http://a/8", "x" * 6_000_000),
    ]


def test_round_trip(spark, pages):
    path = scratch_path(spark, "warc-test")
    frame = pages(rows(), clashing=True)
    index = warc.write_archives(frame, path, archive_bytes=400)
    assert index.count() == 9
    back = {int(r.id): r for r in warc.read_records(index).collect()}
    assert set(back) == {r[0] for r in rows()}
    for key, url, html in rows():
        data = (html or "").encode()
        r = back[key]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        if key in (1, 2):
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", "9", None)
        else:
            assert (r.record_type, r.refers_to) == ("response", None)
            assert bytes(r.payload) == data
    assert back[3].url is None and back[5].url == "http://a/%0D%0AX: y"
    some = index.filter("id in ('4', '8', '2')")
    assert sorted(int(r.id) for r in warc.read_records(some, False).collect()) == [2, 4, 8]
    # Offsets and lengths of an archive cover its file without a gap.
    sizes = {}
    for r in index.orderBy("file", "offset").collect():
        assert r.offset == sizes.get(r.file, 0)
        sizes[r.file] = r.offset + r.length
    files = spark.read.format("binaryFile").load(f"{path}/archives").collect()
    assert {r.path.split("/")[-1]: r.length for r in files} == {
        x.split("/")[-1]: n for x, n in sizes.items()
    }
    assert len(files) > 3
    # Any reader of the format finds the records by unpacking an archive from its start.
    whole = b"".join(gzip.decompress(r.content) for r in files)
    assert whole.count(b"WARC-Record-ID: ") == 9


def test_archives_nothing_refers_to_are_not_read(spark, pages):
    path = scratch_path(spark, "warc-test")
    index = warc.write_archives(pages(rows()), path)
    before = index.count()
    warc.write_archives(pages(rows()), f"{path}/archives/lost")
    assert warc.read_records(index, False).count() == before


def test_reading_is_dealt_by_archive_bytes(spark, pages, monkeypatch):
    """As many tasks as there are shares of the archives, however small the index is."""
    import os

    monkeypatch.setattr(warc, "TASK_BYTES", 4000)
    many = [(i, f"http://h/{i}", os.urandom(300).hex() + "x" * 900) for i in range(120)]
    index = warc.write_archives(pages(many), scratch_path(spark, "warc-tasks"))
    total = index.groupBy().sum("length").first()[0]
    back = warc.read_records(index, False)
    tasks = [n for n in back.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(tasks) == 120 and len(tasks) >= total // 4000 // 2 > 3
    assert max(tasks) < 60


def test_ranges_are_coalesced_and_bounded():
    near = [(0, 10), (10, 10), (25, 5)]
    assert list(warc.ranges(near)) == [near]
    far = [(0, 10), (10 + warc.GAP_BYTES + 1, 5)]
    assert list(warc.ranges(far)) == [far[:1], far[1:]]
    long = [(0, warc.RANGE_BYTES), (warc.RANGE_BYTES, 1)]
    assert list(warc.ranges(long)) == [long[:1], long[1:]]


def test_equal_ids_and_no_ids(pages):
    frame = pages([(2, "u", BIG), (2, "u", BIG), (1, "u", BIG), (None, "v", BIG), (None, "w", BIG + "x")])
    found = warc.archived(frame).collect()
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in found)
    assert got == [
        (0, "response", 0), (0, "revisit", 2), (1, "revisit", 2), (2, "response", 0), (2, "response", 0)
    ]


def test_damaged_archives_are_noticed():
    good = (
        b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: "
        b"sha1:" + hashlib.sha1(b"abc").hexdigest().encode() + b"\r\nContent-Length: 42\r\n\r\n"
        b"HTTP/1.1 200 OK\r\nContent-Length: 3     \r\n\r\nabc\r\n\r\n"
    )
    block = good.split(b"\r\n\r\n", 1)[1][:-4]
    good = good.replace(b"Content-Length: 42", b"Content-Length: %d" % len(block))
    assert warc.parse_record(good)["payload"] == b"abc"
    for bad in (good.replace(b"abc\r", b"abd\r"), good[:-1], b"x" + good):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_empty_table(pages):
    assert warc.archived(pages([])).count() == 0
