"""WARC archives: writing, and normalising monolithic gzip into one member per record with an offset index.

Some archives are one gzip stream as a whole, in which no record can be read by itself. The normaliser inflates such
a stream once, piece by piece, finds the record ends by the Content-Length headers, writes every record as a gzip
member of its own and lists offset, length, type and id of each in a sidecar index beside the archive. Readers take the
sidecars by Spark, so they can choose records by type or id before they fetch any, and read each by itself.

Files go to a folder that all executors reach, by their file system's own interface (pyarrow.fs), each task attempt
under names of its own; only files that the returned tables name count, so a lost executor leaves nothing wrong.
Archives are dealt one to a task, reads by ranges of archive and offset, both in a number that follows from their sizes.

Archives may come from elsewhere: header names in any case, with or without a blank after the colon, records of other
types (which the sidecar lists and the reader leaves out), and streams of several members are taken. A stream that is cut
off, even between two records, and a record without a length are errors.

Payloads of at least ``MIN_REVISIT`` bytes that are equal are stored once, under the smallest page_id; the others
are revisit records. Defined cases: a null payload is an empty one; very long payloads are one record, which a task holds
once; a null page_id is written as such, comes last when the smallest is sought, and is read back as null; page_id may be
of any atomic type; of rows that repeat page_id and payload one (the one with the least url) is the response and the others
revisit it; a null url is written as an empty target; empty tables give empty results. Only page_id, url and html are
read, whatever other columns there are."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import delete_path, materialise, scratch_path

MIN_REVISIT = 100
#: Uncompressed bytes after which a new archive begins.
ARCHIVE_BYTES = 64_000_000
#: Compressed bytes that one task reads, about.
READ_BYTES = 32_000_000
#: Tasks of a job at most; beyond it each takes more archives.
MAX_TASKS = 50_000
_PIECE = 1 << 20
_LEVEL = 3
_ID = "urn:page:"
_HTTP = ("response", "revisit")


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, kind (response or revisit) and refers_to of each row of pages (page_id, url, html)."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    ids = p.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest", "page_id").agg(F.count("*").alias("rows"))
    groups = ids.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "rows")).alias("least"), F.sum("rows").alias("n")).where("n > 1")
    groups = materialise(groups.select("digest", F.col("least.page_id").alias("least"), F.col("least.rows").alias("ties")), "equal-payloads")
    p = p.join(groups.withColumn("shared", F.lit(True)), "digest", "left")
    holds = F.col("page_id").eqNullSafe(F.col("least"))
    first = F.lit(True)
    if not groups.where("ties > 1").isEmpty():  # rows that repeat page_id and payload: one of them is the response
        tied = F.col("shared").isNotNull() & holds & (F.col("ties") > 1)
        many = p.where(tied).withColumn("k", F.row_number().over(W.partitionBy("digest").orderBy("url")))
        p = p.where(~tied).withColumn("k", F.lit(1)).unionByName(many)
        first = F.col("k") == 1
    response = F.col("shared").isNull() | (holds & first)
    return p.select("page_id", "url", "payload", "digest", F.when(response, "response").otherwise("revisit").alias("kind"), F.when(~response, F.col("least")).alias("refers_to"))


def _named(page_id: str | None) -> bytes:
    """<urn:page:...> of an id as text; a null one is the bare name."""
    return f"<{_ID}{'' if page_id is None else 'id:' + quote(page_id, safe='')}>".encode()


def _page(name: str | None) -> str | None:
    """The page id of a record id that ``_named`` made, as text."""
    text = (name or "").removeprefix("<").removesuffix(">")
    return unquote(text[len(_ID) + 3 :]) if text.startswith(_ID + "id:") else None


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit holds the headers of the answer only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    target = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), b"WARC-Record-ID: " + _named(page_id), b"WARC-Date: 2024-01-01T00:00:00Z", b"WARC-Target-URI: " + target.encode("utf-8", "replace"), f"WARC-Payload-Digest: sha256:{digest}".encode()]
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + _named(refers_to)]
    head += [b"Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    """Headers after the first line, by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _length(fields: dict[str, str]) -> int:
    if not fields.get("content-length", "").isdigit():
        raise ValueError("a record has no length")
    return int(fields["content-length"])


def parse(raw: bytes) -> dict:
    """page_id (text), payload_bytes, payload_digest, record_type, refers_to and payload (null for a revisit) of a response or
    revisit. A digest that the record does not state in this form is taken from the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: _length(fields)].partition(b"\r\n\r\n")
    kind = fields.get("warc-type", "")
    said = fields.get("warc-payload-digest", "")
    digest = said.removeprefix("sha256:").lower() if said.startswith("sha256:") else None
    size = int(x) if (x := _fields(http).get("content-length", "")).isdigit() else None
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if digest not in (None, found):
            raise ValueError("a payload differs from its digest")
        digest, size = found, len(payload)
    return {"page_id": _page(fields.get("warc-record-id")), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None}


#: The blank line that ends a header; archives of other hands may end lines by LF alone.
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, holding one of them and a piece. Header lines and the end of a record get CRLF, whatever
    they had."""
    have, head, need, seen = bytearray(), b"", -1, 0
    for piece in pieces:
        have += piece
        while True:
            if need < 0:
                have = have.lstrip(b"\r\n")  # the end of the record before, and more blank lines than two
                end = _HEAD_END.search(have, max(0, seen - 3))
                if not end:
                    seen = len(have)
                    break
                head = b"\r\n".join(bytes(have[: end.start()]).splitlines())
                need, seen = _length(_fields(head)), 0
                del have[: end.end()]
            if len(have) < need:
                break
            yield head + b"\r\n\r\n" + bytes(have[:need]) + b"\r\n\r\n"
            del have[:need]
            need = -1
    if need >= 0 or have.strip(b"\r\n"):
        raise ValueError("the archive ends within a record")


def inflated(stream) -> Iterator[bytes]:
    """A gzip stream's content, of one member or several; zero bytes between and behind members are padding."""
    z, begun = zlib.decompressobj(31), False
    while piece := stream.read(_PIECE):
        while piece := piece if begun else piece.lstrip(b"\0"):
            begun = True
            yield z.decompress(piece, 8 * _PIECE)
            while z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, 8 * _PIECE)
            piece = b""
            if z.eof:
                piece, z, begun = z.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError("the archive is cut off")


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _uri(spark: SparkSession, path: str) -> str:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(conf).makeQualified(target).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_monolithic(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of ``plan`` as archives of one gzip stream each; returns (archive, records)."""
    uri = _uri(rows.sparkSession, folder)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        out, done = None, []

        def close():
            nonlocal out
            out[0].write(out[1].flush())
            out[0].close()
            done.append((out[2], out[3]))
            out = None

        for b in batches:
            for row in zip(*b.columns, strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = [fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(_LEVEL, zlib.DEFLATED, 31), name, 0, 0]
                raw = record(*(v.as_py() for v in row))
                out[0].write(out[1].compress(raw))
                out[3] += 1
                out[4] += len(raw)
                if out[4] >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "records"])

    text = [F.col(c).cast("string").alias(c) if c in ("page_id", "refers_to") else F.col(c) for c in ("page_id", "url", "payload", "digest", "kind", "refers_to")]
    return rows.select(*text).mapInArrow(run, "archive string, records long")


def normalise(archives: DataFrame, folder: str, out_folder: str) -> DataFrame:
    """Rewrite each archive (archives: archive, the name of a file in folder) with one member a record and a sidecar beside it;
    returns (archive, records, bytes) of the new ones."""
    spark = archives.sparkSession
    source, target = _uri(spark, folder), _uri(spark, out_folder)

    def run(batches):
        src, src_root = pafs.FileSystem.from_uri(source)
        dst, dst_root = pafs.FileSystem.from_uri(target)
        dst.create_dir(dst_root, recursive=True)
        for b in batches:
            for name in b.column(0).to_pylist():
                new, at, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                with src.open_input_stream(f"{src_root}/{name}", compression=None) as stream, dst.open_output_stream(f"{dst_root}/{new}", compression=None) as out, dst.open_output_stream(f"{dst_root}/{new}.idx", compression=None, buffer_size=_PIECE) as index:
                    for raw in records(inflated(stream)):
                        member = _member(raw)
                        out.write(member)
                        fields = _fields(raw[: raw.index(b"\r\n\r\n")])
                        index.write("\t".join((new, str(at), str(len(member)), quote(fields.get("warc-type", ""), safe=""), quote(fields.get("warc-record-id", ""), safe=""))).encode() + b"\n")
                        at += len(member)
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([n], pa.int64()), pa.array([at], pa.int64())], ["archive", "records", "bytes"])

    names = archives.select("archive")
    n = max(1, min(names.count(), MAX_TASKS))  # dealt by range: one archive to a task
    return names.repartitionByRange(n, "archive").mapInArrow(run, "archive string, records long, bytes long")


def sidecars(written: DataFrame, folder: str) -> DataFrame:
    """archive, offset, length, type and record id of the records in the archives that ``normalise`` returned, from the
    sidecars in folder; sidecars of lost task attempts do not count."""
    spark = written.sparkSession
    kinds = "archive string, offset long, length long, type string, record_id string"
    if written.isEmpty():
        return spark.createDataFrame([], kinds)
    found = spark.read.schema(kinds).option("sep", "\t").option("quote", "").option("pathGlobFilter", "*.idx").csv(folder)
    index = found.join(written.select("archive"), "archive", "left_semi")
    return index.withColumns({c: F.url_decode(F.coalesce(c, F.lit(""))) for c in ("type", "record_id")})


def read_records(index: DataFrame, folder: str, payloads: bool = True, page_id: str = "bigint") -> DataFrame:
    """The responses and revisits that index lists (``sidecars``, or rows chosen of it), each read and inflated by itself.
    page_id: the type of the ids."""
    uri = _uri(index.sparkSession, folder)
    fields = [("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), *([("payload", pa.binary())] if payloads else [])]

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(uri)
        name, file = None, None
        for b in batches:
            found, size = [], 0
            for archive, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive != name:
                    if file:
                        file.close()
                    name, file = archive, fs.open_input_file(f"{root}/{archive}")
                file.seek(offset)
                found.append(parse(zlib.decompress(file.read(length), 31)))
                size += length
                if len(found) == 500 or size > 8 * _PIECE:
                    yield batch(found)
                    found, size = [], 0
            yield batch(found)
        if file:
            file.close()

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in fields], [k for k, _ in fields])

    index = index.where(F.col("type").isin(*_HTTP)).select("archive", "offset", "length")
    size = index.agg(F.sum("length")).first()[0] or 0
    n = max(2 * index.sparkSession.sparkContext.defaultParallelism, min(MAX_TASKS, -(-size // READ_BYTES)))
    near = index.repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
    out = near.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads)
    return out.withColumns({c: F.col(c).cast(page_id) for c in ("page_id", "refers_to")})


def archive_pages(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> tuple[DataFrame, str]:
    """Write pages as monolithic archives, normalise them and drop the former: the index, and the folder of the archives."""
    spark = pages.sparkSession
    raw, folder = scratch_path(spark, "warc-stream"), scratch_path(spark, "warc")
    written = materialise(write_monolithic(plan(pages), raw, archive_bytes), "warc-list")
    done = materialise(normalise(written, raw, folder), "warc-written")
    delete_path(spark, raw)
    return materialise(sidecars(done, folder), "warc-index"), folder


#: DuckDB form of the records read back.
SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to FROM k
"""
