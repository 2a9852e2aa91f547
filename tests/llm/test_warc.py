"""Archives of other hands, damaged ones, several members, several archives, and the sidecar."""

import gzip
import io
import zlib

import pytest

from corpusloom.llm import warc
from corpusloom.llm.common import scratch_path


def rows(n):
    return [(i, f"http://a.b/{i}", f"<p>{i} " + "x" * (50 + i % 90)) for i in range(n)]


def made(spark, n, **how):
    pages = spark.createDataFrame(rows(n), "page_id long, url string, html string").coalesce(1)
    folder = scratch_path(spark, "warc-test")
    return warc.write_monolithic(warc.plan(pages), folder, **how), folder


def test_many_archives_are_normalised_one_to_a_task(spark):
    written, raw = made(spark, 120, archive_bytes=4000)
    written = spark.createDataFrame(written.collect(), written.schema)
    out = scratch_path(spark, "warc-out")
    done = warc.normalise(written, raw, out)
    assert done.rdd.getNumPartitions() == written.count() > 5
    done = spark.createDataFrame(done.collect(), done.schema)
    index = warc.sidecars(done, out)
    assert index.count() == 120 and {r.type for r in index.collect()} <= {"response", "revisit"}
    assert sorted(r.page_id for r in warc.read_records(index, out).collect()) == list(range(120))
    some = index.where("record_id in ('<urn:page:id:7>', '<urn:page:id:99>')")
    assert {(r.page_id, r.payload) for r in warc.read_records(some, out).collect()} == {(i, rows(120)[i][2].encode()) for i in (7, 99)}


def test_damaged_streams_are_errors():
    raw = [warc.record(str(i), "u", b"y" * 200, "0", "response", None) for i in range(40)]
    whole = gzip.compress(b"".join(raw))
    read = lambda data: list(warc.records(warc.inflated(io.BytesIO(data))))
    assert read(whole) == raw and read(b"") == []
    assert read(gzip.compress(b"".join(raw[:20])) + gzip.compress(b"".join(raw[20:]))) == raw
    with pytest.raises(ValueError, match="cut off"):
        read(whole[:-9])
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    between = z.compress(b"".join(raw[:20])) + z.flush(zlib.Z_SYNC_FLUSH)  # cut between two records
    with pytest.raises(ValueError, match="cut off"):
        read(between)
    with pytest.raises(ValueError, match="within a record"):
        read(gzip.compress(b"".join(raw)[:-300]))
    with pytest.raises(ValueError, match="no length"):
        read(gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\n\r\n"))
    with pytest.raises((ValueError, zlib.error)):
        read(whole[:200] + b"\0\0\0" + whole[203:])


def test_archives_of_other_hands(spark, tmp_path):
    http = b"HTTP/1.0 200 OK\r\nserver:x\r\n\r\n<p>hello</p>"
    foreign = b"WARC/1.0\r\nwarc-type:warcinfo\r\ncontent-length:4\r\n\r\nab\r\n\r\n\r\n\r\n" + b"WARC/1.0\r\nwarc-type:response\r\nwarc-record-id:<urn:uuid:1>\r\nWARC-Payload-Digest:sha1:ABC\r\ncontent-length:%d\r\n\r\n" % len(http) + http + b"\r\n\r\n"
    foreign += b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "other.warc.gz").write_bytes(gzip.compress(foreign))
    done = warc.normalise(spark.createDataFrame([("other.warc.gz",)], "archive string"), str(tmp_path / "in"), str(tmp_path / "out"))
    done = spark.createDataFrame(done.collect(), done.schema)
    index = warc.sidecars(done, str(tmp_path / "out"))
    assert sorted(r.type for r in index.collect()) == ["request", "response", "warcinfo"]
    (r,) = warc.read_records(index, str(tmp_path / "out")).collect()
    assert (r.page_id, r.payload_bytes, r.record_type, r.payload) == (None, 12, "response", b"<p>hello</p>")


def test_text_ids(spark):
    pages = spark.createDataFrame([("a b\r\n", "u", "z" * 200), ("", "u", "z" * 200), (None, "u", "z" * 200)], "page_id string, url string, html string")
    index, folder = warc.archive_pages(pages)
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.read_records(index, folder, page_id="string").collect()}
    assert got == {("", "response", None), ("a b\r\n", "revisit", ""), (None, "revisit", "")}


def test_archives_of_other_hands():
    given = [warc.record(str(i), "http://a", b"x" * i + b"\n\n\r\n" * i, "d", "response", None) for i in range(5)]
    read = lambda data: list(warc.records(warc.inflated(io.BytesIO(data))))

    def by_lf(raw):
        head, body = raw.split(b"\r\n\r\n", 1)
        return head.replace(b"\r\n", b"\n") + b"\n\n" + body[:-4] + b"\n\n"

    assert read(gzip.compress(b"".join(given)) + bytes(3_000_000)) == given  # padded
    assert read(b"".join(gzip.compress(x) + bytes(7) for x in given)) == given
    assert read(gzip.compress(b"".join(map(by_lf, given)))) == given
    assert read(b"") == []
    for bad in (gzip.compress(b"".join(given))[:-20], gzip.compress(b"".join(given)[:-40])):
        with pytest.raises(ValueError):
            read(bad)
