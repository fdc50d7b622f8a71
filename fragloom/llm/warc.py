"""WARC archives: written as one gzip stream each, normalised to one gzip member a record.

* :func:`write_archives` writes every row as a ``response`` record.  Each archive is a single
  gzip member from end to end, as crawlers that compress whole files leave them: nothing in it
  can be reached without inflating all that stands before.
* :func:`repeats` finds, over all archives, the records whose payload another record has, too.
  Only digests and places travel; pages are not shuffled.
* :func:`normalise` reads each archive once, as a stream, and writes its records anew, each as
  a gzip member of its own; a record with a repeated payload becomes a ``revisit`` without it.
  Beside the archive it writes its index, one JSON line for each record with its offset and
  length.
* :func:`read_records` takes the offsets from the indexes, deals out stretches of archives and
  inflates the members at their offsets.

Files get names of their own in each attempt of a task.  Those of attempts that failed are in
no manifest, and all steps go by manifests.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_value, looked_up, staged

by_value(__name__)

#: Bytes of records, before compression, after which an archive is closed.
ARCHIVE_BYTES = 1 << 26
#: Bytes of an archive, compressed, that one row of :func:`read_records` takes.
STRETCH = 1 << 23
PIECE = 1 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = 31  # zlib's window bits with a gzip head


def _store(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _field(value: str) -> bytes:
    """A header's value: control characters, which would end the line, as %XX."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value).encode("utf-8", "surrogatepass")


def _head(fields: list[tuple[str, bytes | None]], length: int) -> bytes:
    lines = [b"WARC/1.1", *(name.encode() + b": " + value for name, value in fields if value is not None)]
    return b"\r\n".join([*lines, b"Content-Length: %d" % length, b"", b""])


def payload_digest(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def _response(page_id: int | None, url: str | None, payload: bytes, digest: str, record_id: str, date: str) -> tuple[bytes, bytes]:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        ("WARC-Type", b"response"),
        ("WARC-Record-ID", f"<urn:uuid:{record_id}>".encode()),
        ("WARC-Date", date.encode()),
        ("WARC-Target-URI", None if url is None else _field(url)),
        ("WARC-Payload-Digest", b"sha1:" + digest.encode()),
        ("Page-Id", None if page_id is None else b"%d" % page_id),
        ("Content-Type", b"application/http; msgtype=response"),
    ]
    return _head(fields, len(http) + len(payload)), http


_RECORDS = (
    "archive string, n int, page_id long, url string, payload_bytes long, payload_digest string, content_hash long, record_id string"
)


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write a record for every row to archives under ``path``; returns one narrow row per
    record, with its archive and its number ``n`` in it.

    Payloads are strings in UTF-8 or binary; a null one is empty.  A null id or url leaves its
    header out; control characters of a url are written as %XX.  Repeated rows are records of
    their own.  An empty table writes nothing.  Other columns are not read.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{url_col}`").cast("string"), F.col(f"`{payload_col}`").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        out = gzip = None
        name, size = "", 0
        for batch in batches:
            told: list[tuple] = []
            for page_id, url, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                content = payload.as_py() or b""
                if out is None:
                    name, size, number = f"{part:07d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, gzip = store.open_output_stream(f"{folder}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
                digest = payload_digest(content)
                record_id = str(uuid.UUID(bytes=hashlib.md5(f"{page_id}\n{url}\n{digest}\n{name}\n{number}".encode("utf-8", "surrogatepass")).digest()))
                head, http = _response(page_id, url, content, digest, record_id, date)
                for piece in (head, http, content, b"\r\n\r\n"):
                    out.write(gzip.compress(piece))
                told.append((name, number, page_id, url, len(content), digest, xxhash.xxh64_intdigest(content) - (1 << 63), record_id))
                size, number = size + len(head) + len(http) + len(content), number + 1
                if size >= archive_bytes:
                    out.write(gzip.flush())
                    out.close()
                    out = None
            if told:
                yield _batch(told, [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()])
        if out is not None:
            out.write(gzip.flush())
            out.close()

    return staged(rows.mapInArrow(run, _RECORDS), "warc-records")


def _batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f"c{i}" for i in range(len(kinds))])


def repeats(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``archive, n`` of the records that repeat a payload of at least ``least_bytes``, with
    the record that keeps it: the one of the largest page_id.

    A null id is smaller than every other; of rows that repeat an id the one with the largest
    url keeps the payload, and of wholly equal rows the last one written.  Payloads are equal
    when length, SHA-1 and a second hash are.
    """
    keyed = records.withColumn("payload", F.struct("payload_digest", "payload_bytes", "content_hash"))
    kept = F.max(F.struct("page_id", "url", "archive", "n", "record_id")).alias("kept")
    groups = keyed.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload").agg(kept, F.count(F.lit(1)).alias("copies"))
    found = looked_up(keyed, groups.filter("copies > 1").drop("copies"), "payload", "record_id")
    other = (F.col("archive") != F.col("kept.archive")) | (F.col("n") != F.col("kept.n"))
    return found.filter(other).select("archive", "n", "kept.page_id", "kept.url", "kept.record_id")


class Inflated:
    """The inflated bytes of a gzip file of one or more members, read as a stream."""

    def __init__(self, file: Any):
        self.file, self.held, self.gzip, self.done = file, bytearray(), zlib.decompressobj(_GZIP), False

    def _more(self) -> None:
        data = self.gzip.unconsumed_tail or self.gzip.unused_data or self.file.read(PIECE)
        if self.gzip.eof:
            self.gzip = zlib.decompressobj(_GZIP)
        elif not data:
            raise ValueError("the gzip stream breaks off")
        if not data:
            self.done = True
            return
        self.held += self.gzip.decompress(data, PIECE)

    def line(self) -> bytes | None:
        """Up to the next line end, without it; none at the end of the file."""
        seen = 0
        while (at := self.held.find(b"\r\n", seen)) < 0:
            seen = max(len(self.held) - 1, 0)
            if self.done:
                if self.held:
                    raise ValueError("a line breaks off")
                return None
            self._more()
        found = bytes(self.held[:at])
        del self.held[: at + 2]
        return found

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, some at a time."""
        while n:
            while not self.held:
                if self.done:
                    raise ValueError("a record breaks off")
                self._more()
            piece = bytes(self.held[:n])
            del self.held[: len(piece)]
            n -= len(piece)
            yield piece


def _read_head(stream: Inflated) -> list[tuple[str, bytes]] | None:
    """Header fields of the next record, after its version line."""
    line = stream.line()
    while line == b"":
        line = stream.line()
    if line is None:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record begins with {line[:40]!r}")
    fields: list[tuple[str, bytes]] = []
    while line := stream.line():
        name, _, value = line.partition(b":")
        fields.append((name.decode("utf-8", "replace"), value.strip(b" \t")))
    if line is None:
        raise ValueError("a record's head breaks off")
    return fields


def _value(fields: list[tuple[str, bytes]], name: str) -> bytes | None:
    return next((v for k, v in fields if k.lower() == name.lower()), None)


_MANIFEST = "archive string, index string, n_records long, bytes long"
_INDEX = "offset long, length long, record_id string, record_type string, page_id long, uri string, payload_digest string"


def _rewritten(stream: Inflated, again: dict[int, Any], out: Any, index: Any) -> tuple[int, int]:
    """Every record of ``stream`` as a member of its own; ``again`` has the repeats by number."""
    offset = number = 0
    while (fields := _read_head(stream)) is not None:
        length = int(_value(fields, "Content-Length") or 0)
        body = stream.pieces(length)
        kind, kept = _value(fields, "WARC-Type"), again.get(number)
        if kept is not None and kind == b"response":
            block = bytearray()
            for piece in body:  # the head of the reply stays, the payload goes
                if b"\r\n\r\n" not in block:
                    block += piece
            length = block.find(b"\r\n\r\n") + 4
            body = iter([bytes(block[:length])])
            dropped = {"warc-type", "content-length"}
            fields = [("WARC-Type", b"revisit"), *((k, v) for k, v in fields if k.lower() not in dropped)]
            fields += [("WARC-Profile", _PROFILE.encode()), ("WARC-Refers-To", f"<urn:uuid:{kept['record_id']}>".encode())]
            if kept["url"] is not None:
                fields.append(("WARC-Refers-To-Target-URI", _field(kept["url"])))
            if kept["page_id"] is not None:
                fields.append(("Refers-To-Page-Id", b"%d" % kept["page_id"]))
        else:
            fields = [(k, v) for k, v in fields if k.lower() != "content-length"]
        gzip, size = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP), 0

        def put(piece: bytes) -> None:
            nonlocal size
            size += len(piece)
            out.write(piece)

        put(gzip.compress(_head(list(fields), length)))
        for piece in body:
            put(gzip.compress(piece))
        put(gzip.compress(b"\r\n\r\n"))
        put(gzip.flush())
        for piece in stream.pieces(4):
            if piece.strip(b"\r\n"):
                raise ValueError("a record is longer than its head says")
        text = {k: (v := _value(fields, n)) and v.decode("utf-8", "replace") for k, n in (("uri", "WARC-Target-URI"), ("payload_digest", "WARC-Payload-Digest"), ("record_type", "WARC-Type"), ("record_id", "WARC-Record-ID"))}
        page = _value(fields, "Page-Id")
        index.write(json.dumps({"offset": offset, "length": size, "page_id": None if page is None else int(page), **text}).encode() + b"\n")
        offset, number = offset + size, number + 1
    return number, offset


def normalise(archives: DataFrame, path: str, out_path: str, again: DataFrame | None = None) -> DataFrame:
    """Rewrite the archives named in ``archive`` from ``path`` to ``out_path``, with an index
    beside each; returns the manifest, one row per archive.

    Archives may hold any records in gzip members of any size.  ``again`` (as :func:`repeats`
    gives it) names responses that become revisits.  A file that breaks off, or is no WARC,
    ends the job with what was found.  Memory does not grow with a record, but for the head
    of a revisited reply.
    """
    names = archives.select("archive").distinct()
    if again is not None:
        # An archive has a bounded number of records, and so of repeats.
        listed = again.groupBy("archive").agg(F.collect_list(F.struct("n", "page_id", "url", "record_id")).alias("again"))
        names = names.join(listed, "archive", "left")
    else:
        names = names.withColumn("again", F.lit(None).cast("array<struct<n:int,page_id:bigint,url:string,record_id:string>>"))
    names = staged(names, "warc-archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, from_folder = _store(path)
        target, folder = _store(out_path)
        target.create_dir(folder, recursive=True)
        for batch in batches:
            for archive, listed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stem = f"{archive.removesuffix('.gz').removesuffix('.warc')}-{uuid.uuid4().hex}"
                by_number = {x["n"]: x for x in listed.as_py() or ()}
                with (
                    source.open_input_stream(f"{from_folder}/{archive}", compression=None) as file,
                    target.open_output_stream(f"{folder}/{stem}.warc.gz", compression=None) as out,
                    target.open_output_stream(f"{folder}/{stem}.index.jsonl", compression=None) as index,
                ):
                    n, size = _rewritten(Inflated(file), by_number, out, index)
                yield _batch([(f"{stem}.warc.gz", f"{stem}.index.jsonl", n, size)], [pa.string(), pa.string(), pa.int64(), pa.int64()])

    # A row is an archive: about as many tasks as archives, whatever little their names weigh.
    dealt = names.repartition(max(1, 2 * names.count()), "archive")
    return staged(dealt.mapInArrow(run, _MANIFEST), "warc-manifest")


def read_index(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """The index lines of the manifest's archives, each with its ``archive``."""
    if manifest.isEmpty():
        return spark.createDataFrame([], f"index string, {_INDEX}, archive string")
    lines = spark.read.schema(_INDEX).option("pathGlobFilter", "*.index.jsonl").json(path)
    return lines.withColumn("index", F.col("_metadata.file_name")).join(manifest.select("index", "archive"), "index")


_READ = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "record_id string, archive string, offset long, payload binary"
)


def _record(member: bytes) -> tuple[list[tuple[str, bytes]], bytes]:
    gzip = zlib.decompressobj(_GZIP)
    content = gzip.decompress(member)
    if not gzip.eof or gzip.unused_data:
        raise ValueError("an index line is not one member")
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = [(k.decode("utf-8", "replace"), v.strip(b" \t")) for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])]
    return fields, rest[: int(_value(fields, "Content-Length") or 0)]


def read_records(spark: SparkSession, path: str, manifest: DataFrame, with_payload: bool = False, stretch: int = STRETCH) -> DataFrame:
    """One row per response or revisit, read from its member alone.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload: counted anew for a
    response, and compared with its head; from its heads for a revisit.  ``refers_to`` is the
    page_id of the record that a revisit refers to.
    """
    lines = read_index(spark, path, manifest).filter("record_type IN ('response', 'revisit')")
    at = F.floor(F.col("offset") / stretch).alias("stretch")
    dealt = lines.groupBy("archive", at).agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("members"))
    total = manifest.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    tasks = max(1, int((total[0] or 0) / stretch) + total[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for archive, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                with store.open_input_file(f"{folder}/{archive}") as file:
                    for member in members.as_py():
                        fields, block = _record(file.read_at(member["length"], member["offset"]))
                        text = {k.lower(): v.decode("utf-8", "replace") for k, v in fields}
                        http, _, payload = block.partition(b"\r\n\r\n")
                        told = (text.get("warc-payload-digest") or "").removeprefix("sha1:")
                        if text["warc-type"] == "response":
                            n, digest = len(payload), payload_digest(payload)
                            if told and told != digest:
                                raise ValueError(f"{archive} at {member['offset']}: the payload is not that of its digest")
                        else:
                            n, digest, payload = int(dict(x.lower().split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"content-length"]), told, None
                        page, refers = (None if (x := text.get(k)) is None else int(x) for k in ("page-id", "refers-to-page-id"))
                        rows.append((page, text.get("warc-target-uri"), n, digest, text["warc-type"], refers, text["warc-record-id"][10:-1], archive, member["offset"], payload if with_payload else None))
                        held += n if with_payload else 100
                        if held > 1 << 24:
                            yield _batch(rows, kinds)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, kinds)

    return dealt.repartition(2 * tasks, "archive", "stretch").select("archive", "members").mapInArrow(run, _READ)
