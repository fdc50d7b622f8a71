"""Token-id files with Elias-Fano document boundaries.

A file holds the ids of consecutive documents, in one array, and behind it where each document
ends.  The ends ascend, so they are kept as an Elias-Fano sequence: the low bits of every end
in a packed array and the high bits as a unary bit vector, about ``2 + log2(ids / documents)``
bits a document.  ``select`` finds the i-th end, helped by the place of every ``SAMPLE``-th
one, without unpacking the others.  Documents are in ascending id order, so their ids are a
second such sequence, counted from the least.

Layout, little-endian: 8 bytes magic; the token ids, as uint16 if the tokenizer has no larger
ones, else as uint32, padded to 8 bytes; for the ends and then for the document ids the low
array, the high vector and the samples (uint32), each padded to 8 bytes; and a tail of 13
numbers (uint64): documents, of them without an id (they come first), ids, bytes an id, least
document id, and for each sequence low bits, bytes of the low array, of the high vector and of
the samples; and the magic once more.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import byte_bpe
from .shared import by_value, staged

by_value(__name__)

MAGIC = b"TOKENEF2"
#: Every so many ends, the place of a one in the high vector is written down.
SAMPLE = 256
#: A file is closed after the document that brings it to this many ids.
FILE_IDS = 1 << 23
#: Documents that are read side by side.
READ = 4096
END_ID = 0


_BITS = np.array([bin(i).count("1") for i in range(256)], np.int64)


class EliasFano:
    """An ascending sequence of integers, read by ``select``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = np.zeros(n * low_bits, np.uint8)
        for b in range(low_bits):
            bits[b::low_bits] = values >> np.uint64(b) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, low_bits, np.packbits(bits, bitorder="little"), np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, at: np.ndarray | int) -> np.ndarray:
        """The values at the given places, found side by side."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        begin = self.samples[at // SAMPLE].astype(np.int64)
        left, byte = at % SAMPLE, begin >> 3
        window = self.high[byte] & ~((1 << (begin & 7)) - 1) if len(at) else np.zeros(0, np.int64)
        ones = _BITS[window & 0xFF]
        behind = np.flatnonzero(left >= ones)
        while len(behind):  # to the byte that holds the wanted one
            left[behind] -= ones[behind]
            byte[behind] += 1
            window[behind] = self.high[byte[behind]]
            ones[behind] = _BITS[window[behind] & 0xFF]
            behind = behind[left[behind] >= ones[behind]]
        for _ in range(7):
            more = left > 0
            window[more] &= window[more] - 1
            left[more] -= 1
        one = byte * 8 + _BITS[((window & -window) - 1) & 0xFF]
        return ((one - at) << self.low_bits) | self._low(at)

    def _low(self, at: np.ndarray) -> np.ndarray:
        found = np.zeros(len(at), np.int64)
        for b in range(self.low_bits):
            bit = at * self.low_bits + b
            found |= (self.low[bit >> 3].astype(np.int64) >> (bit & 7) & 1) << b
        return found

    def sections(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


class Writer:
    """Writes a file as its ids come; holds a number per document."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.doc_ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.nulls = self.n = self.size = 0
        out.write(MAGIC)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents that follow in id order, with all their ids in a row."""
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.nulls += doc_ids.null_count
        self.doc_ids.append(doc_ids.drop_null().to_numpy())
        self.counts.append(counts)
        self.n, self.size = self.n + len(counts), self.size + len(ids)

    def close(self) -> None:
        self.out.write(bytes(-(self.size * self.width) % 8))
        doc_ids = np.concatenate([np.zeros(0, np.int64), *self.doc_ids])
        least = int(doc_ids[0]) if len(doc_ids) else 0
        ends = EliasFano.of(np.cumsum(np.concatenate([np.zeros(0, np.int64), *self.counts])))
        owners = EliasFano.of(doc_ids - np.int64(least))
        tail = [self.n, self.nulls, self.size, self.width, least % (1 << 64)]
        for sequence in (ends, owners):
            parts = sequence.sections()
            tail += [sequence.low_bits, *map(len, parts)]
            for part in parts:
                self.out.write(_padded(part))
        self.out.write(np.array(tail, "<u8").tobytes() + MAGIC)


class TokenFile:
    """Reads what :class:`Writer` has written."""

    def __init__(self, content: bytes):
        view = memoryview(content)
        if bytes(view[:8]) != MAGIC or bytes(view[-8:]) != MAGIC:
            raise ValueError("not a token file")
        tail = [int(x) for x in np.frombuffer(view[-8 - 8 * 13 : -8], "<u8")]
        self.n, self.nulls, self.n_ids, width, least = tail[:5]
        self.least = least - (1 << 64) if least >> 63 else least
        self.ids = np.frombuffer(view, f"<u{width}", self.n_ids, 8)
        at = 8 + self.n_ids * width + -(self.n_ids * width) % 8
        sequences = []
        for n, (low_bits, *lengths) in ((self.n, tail[5:9]), (self.n - self.nulls, tail[9:13])):
            parts = []
            for length in lengths:
                parts.append(np.frombuffer(view, np.uint8, length, at))
                at += length + -length % 8
            sequences.append(EliasFano(n, low_bits, parts[0], parts[1].astype(np.int64), parts[2].view("<u4")))
        self.ends, self.owners = sequences

    def spans(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the given documents begin and end in the id array."""
        before = np.where(at > 0, self.ends.select(np.maximum(at - 1, 0)), 0)
        return before, self.ends.select(at)

    def doc_ids(self, at: np.ndarray) -> pa.Array:
        null = at < self.nulls
        found = np.zeros(len(at), np.int64)
        found[~null] = self.owners.select(at[~null] - self.nulls) + np.int64(self.least)
        return pa.array(found, mask=null)

    def tokens(self, i: int) -> np.ndarray:
        begin, end = self.spans(np.array([i]))
        return self.ids[begin[0] : end[0]].astype("<u4")


MANIFEST = "part int, seq int, file string, n_docs long, n_ids long"


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode all texts, write them to files under ``path`` in ascending id order and return
    the manifest: one row per file.

    Rows are range-partitioned and sorted by id; a null id comes first, repeated ids follow
    each other in the order of their texts' hashes.  A null text is empty and has the end
    id alone.  Each attempt of a task writes files of its own names; those of attempts that
    failed are in no manifest, and readers go by the manifest.  An empty table gives an
    empty manifest.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(folder, recursive=True)
        width = 2 if max(len(byte_bpe.encoder(tokenizer).lengths) - 1, end_id) < 1 << 16 else 4
        part, seq, name, file = TaskContext.get().partitionId(), 0, "", None

        def closed() -> pa.RecordBatch:
            file.close()
            file.out.close()
            row = [[part], [seq], [name], [file.n], [file.size]]
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["part", "seq", "file", "n_docs", "n_ids"]
            )

        for rows, ids, counts in byte_bpe.encoded(tokenizer, batches, 1):
            if file is None:
                name = f"{part:07d}-{seq:07d}-{uuid.uuid4().hex}.ids"
                file = Writer(store.open_output_stream(f"{folder}/{name}"), width)
            file.add(rows.column(0), np.insert(ids, np.cumsum(counts), end_id), counts + 1)
            if file.size >= file_ids:
                yield closed()
                file, seq = None, seq + 1
        if file is not None:
            yield closed()

    return staged(ordered.mapInArrow(run, MANIFEST), "token-files")


def read(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone;
    ``start`` counts the ids of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                file = TokenFile(content.as_buffer())
                for first in range(0, file.n, READ):
                    at = np.arange(first, min(first + READ, file.n))
                    starts, ends = file.spans(at)
                    crcs = [zlib.crc32(file.ids[a:b].astype("<u4")) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name.as_py().rsplit("/", 1)[-1]] * len(at), pa.string()),
                            file.doc_ids(at),
                            pa.array(starts, pa.int64()),
                            pa.array(ends - starts, pa.int64()),
                            pa.array(crcs, pa.int64()),
                        ],
                        names=["file", "doc_id", "local", "n_tokens", "ids_crc32"],
                    )

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(path).select("path", "content")
    found = files.mapInArrow(run, "file string, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(bases, "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
