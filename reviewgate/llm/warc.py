"""WARC archives: an index of records, then coalesced byte-range reads (operator 5).

Every task writes its records, each a gzip member of its own, to archives in the given
shared folder and returns offset, length, url and digest of each. These rows are written as
the index before anything is read. An attempt of a task has archives of its own, and the
index names those of the attempts that succeeded: a lost executor leaves a file that nothing
refers to. Nothing is shuffled but the digests that are compared. Reading sorts the
selected index rows by offset, joins neighbours into ranges of bounded size and reads only
those bytes.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the largest
page id is a response and the others are revisits without a payload that refer to it.

Cases: a null page has an empty payload; a null url leaves its header line out; line ends
in a url are percent-encoded in the header; a record longer than a range is read alone;
rows with equal ids are records of their own, and if they hold the same payload and the
largest id, each is a response; rows without an id are revisits if another row with their
payload has one; an empty table gives no archive; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewgate.session import materialise, scratch_path

REVISIT_BYTES = 1000
#: An archive is closed when it has this many bytes.
ARCHIVE_BYTES = 256 << 20
#: Ranges of selected records are joined over gaps up to one bound and up to another in all.
GAP_BYTES = 64 << 10
RANGE_BYTES = 4 << 20
#: Archive bytes that a reading task gets, about.
TASK_BYTES = 16 << 20
MAX_BROADCAST_GROUPS = 100_000
END = b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"
RESPONSE, REVISIT = "response", "revisit"
GZIP = zlib.MAX_WBITS | 16
INDEX = {
    "file": pa.string(),
    "offset": pa.int64(),
    "length": pa.int64(),
    "id": pa.string(),
    "url": pa.string(),
    "payload_digest": pa.string(),
    "record_type": pa.string(),
}


def record(
    key: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None
) -> bytes:
    """A whole record; with ``refers_to`` a revisit, whose block ends with the HTTP header."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {RESPONSE if refers_to is None else REVISIT}",
        f"WARC-Record-ID: <{ID}{'' if key is None else key}>",
    ]
    if url is not None:
        safe = url.replace("\r", "%0D").replace("\n", "%0A")
        lines.append(f"WARC-Target-URI: {safe}")
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, GZIP)
    return packer.compress(data) + packer.flush()


class _Archives:
    """The archives of one attempt of a task, a new one whenever one is full."""

    def __init__(self, folder: str, most: int):
        self.system, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.prefix, self.most = folder, most
        self.stream, self.name, self.offset = None, "", 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.stream is None:
            name = f"{uuid.uuid4().hex}.warc.gz"
            self.name, self.offset = f"{self.prefix}/{name}", 0
            self.stream = self.system.open_output_stream(f"{self.folder}/{name}", compression=None)
        at = self.offset
        self.stream.write(data)
        self.offset += len(data)
        if self.offset >= self.most:
            self.close()
        return self.name, at, len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def write_archives(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    page: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write the archives and then the index below ``path``; returns the written index."""
    payload = F.coalesce(F.col(page), F.lit(""))
    rows = pages.select(
        F.col(key).alias("id"),
        F.col(url).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("n"),
        F.sha1(F.encode(payload, "UTF-8")).alias("digest"),
    )
    keepers = (
        rows.filter(F.col("n") >= REVISIT_BYTES)
        .groupBy("digest", "n")
        .agg(F.max("id").alias("keeper"), F.count("*").alias("rows"))
        .filter("rows > 1 and keeper is not null")
        .drop("rows")
    )
    keepers = materialise(keepers, "warc-repeated")
    if keepers.count() <= MAX_BROADCAST_GROUPS:
        keepers = F.broadcast(keepers)
    revisit = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    described = rows.join(keepers, ["digest", "n"], "left").select(
        F.col("id").cast("string").alias("id"),
        "url",
        "payload",
        "digest",
        F.when(revisit, F.col("keeper")).cast("string").alias("refers_to"),
    )
    folder = f"{_uri(path)}/archives"
    system, inner = pa.fs.FileSystem.from_uri(folder)
    system.create_dir(inner, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Archives(folder, archive_bytes)
        for batch in batches:
            found = []
            for key, url, text, digest, keeper in zip(*(x.to_pylist() for x in batch.columns)):
                data = _member(record(key, url, text.encode(), digest, keeper))
                kind = RESPONSE if keeper is None else REVISIT
                found.append((*archives.add(data), key, url, digest, kind))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[i] for x in found], kind)
                    for i, kind in enumerate(INDEX.values())
                ],
                list(INDEX),
            )
        archives.close()

    schema = ", ".join(f"{x} {'long' if t == pa.int64() else 'string'}" for x, t in INDEX.items())
    return materialise(described.mapInArrow(run, schema), "index", f"{path}/index")


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (x.split(b": ", 1) for x in lines.split(b"\r\n")[1:] if b": " in x)
    return {k.decode().lower(): v.decode() for k, v in pairs}


def parse_record(data: bytes) -> dict:
    """Fields of one record; the payload's digest is compared with the header's."""
    header, _, rest = data.partition(END)
    if not header.startswith(b"WARC/1."):
        raise ValueError(f"no record begins with {data[:20]!r}")
    fields = _fields(header)
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != END:
        raise ValueError(f"record {fields['warc-record-id']} is not as long as it says")
    http, _, payload = block.partition(END)
    revisit = fields["warc-type"] == REVISIT
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
    number = f"<{ID}"
    return {
        "id": fields["warc-record-id"].removeprefix(number).removesuffix(">") or None,
        "url": fields.get("warc-target-uri"),
        "payload_bytes": int(_fields(http)["content-length"]) if revisit else len(payload),
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": fields["warc-refers-to"].removeprefix(number).removesuffix(">")
        if revisit
        else None,
        "payload": None if revisit else payload,
    }


def ranges(rows: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Ascending (offset, length) in groups to be read at once."""
    group: list[tuple[int, int]] = []
    for offset, length in rows:
        if group:
            end = group[-1][0] + group[-1][1]
            if offset - end > GAP_BYTES or offset + length - group[0][0] > RANGE_BYTES:
                yield group
                group = []
        group.append((offset, length))
    if group:
        yield group


def read_records(selected: DataFrame, payload: bool = True) -> DataFrame:
    """Records of the given index rows: id, url, digest, type, and the payload if wanted."""
    fields = [
        T.StructField("id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
    ] + [T.StructField("payload", T.BinaryType())] * payload
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    kinds += [pa.binary()] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for batch in batches:
            names, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            begin = 0
            while begin < len(names):
                end = begin
                while end < len(names) and names[end] == names[begin]:
                    end += 1
                if names[begin] != name:
                    name = names[begin]
                    system, inner = pa.fs.FileSystem.from_uri(name)
                    opened = system.open_input_file(inner)
                for group in ranges(list(zip(offsets[begin:end], lengths[begin:end]))):
                    first = group[0][0]
                    data = opened.read_at(group[-1][0] + group[-1][1] - first, first)
                    members = (data[o - first : o - first + n] for o, n in group)
                    found = [parse_record(zlib.decompress(x, GZIP)) for x in members]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[f.name] for x in found], k) for f, k in zip(fields, kinds)],
                        [f.name for f in fields],
                    )
                begin = end

    rows = selected.select("file", "offset", "length")
    # A task's share follows the bytes behind the index, not those of the index itself.
    total = rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, math.ceil(total / TASK_BYTES))
    part = F.floor(F.col("offset") / TASK_BYTES)
    ordered = rows.repartition(tasks, "file", part).sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, T.StructType(fields))


def archived(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Write all pages, read all records back: the records without their payloads."""
    index = write_archives(pages, scratch_path(pages.sparkSession, "warc"), key)
    back = read_records(index, payload=False)
    kind = pages.schema[key].dataType
    return back.select(
        F.col("id").cast(kind).alias(key),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
        "url",
    )
