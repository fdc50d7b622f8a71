"""Words of many texts as arrays: no Python object is made for a word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .shared import by_value

by_value(__name__)

#: What a byte is to a splitter.
WORD, SPACE, BREAK = 0, 1, 2


def byte_classes(spaces: bytes, breaks: bytes = b"") -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(spaces)] = SPACE
    table[list(breaks)] = BREAK
    return table


@dataclass
class Words:
    """The words of some texts in a row.

    ``ids`` numbers them by the places of ``vocabulary``; ``doc`` is the text a word is
    from, ``piece`` counts the stretches between breaks and texts; ``data`` has the bytes
    of all words, of which word ``i`` has ``offsets[i]`` to ``offsets[i + 1]``.
    """

    ids: np.ndarray
    vocabulary: pa.Array
    doc: np.ndarray
    piece: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def words_of(texts: pa.Array, classes: np.ndarray, lower: np.ndarray | None = None) -> Words:
    """Words of a string column; nulls have none.  ``lower`` maps bytes before they are read."""
    texts = texts.fill_null("") if texts.null_count else texts
    large = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    begin, stop = (int(ends[0]), int(ends[-1])) if len(texts) else (0, 0)
    content = texts.buffers()[2]
    raw = np.frombuffer(content, np.uint8)[begin:stop] if content is not None else np.zeros(0, np.uint8)
    if lower is not None:
        raw = lower[raw]
    kind = classes[raw]
    inside = kind == WORD
    first = np.zeros(len(raw) + 1, bool)
    first[ends[:-1] - begin] = True  # a text's first byte begins a word whatever precedes it
    first = first[:-1]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:]
    at = np.flatnonzero(starts)
    data = raw[inside]
    offsets = np.r_[np.flatnonzero(starts[inside]), len(data)].astype(np.int64)
    held = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    encoded = held.dictionary_encode()
    doc = np.searchsorted(ends - begin, at, side="right") - 1
    piece = np.cumsum((kind == BREAK) | first)[at] if len(at) else np.zeros(0, np.int64)
    return Words(encoded.indices.to_numpy().astype(np.int64), encoded.dictionary, doc, piece, data, offsets)


def joined(words: Words, keep: np.ndarray, n_docs: int) -> pa.Array:
    """For each text its kept words, joined by one space."""
    at = np.flatnonzero(keep)
    doc, size = words.doc[at], words.offsets[at + 1] - words.offsets[at]
    last = np.r_[doc[1:] != doc[:-1], True] if len(at) else np.zeros(0, bool)
    room = size + ~last  # a space after every word but a text's last
    place = np.cumsum(room) - room
    out = np.full(int(room.sum()), 32, np.uint8)
    source = np.repeat(words.offsets[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    target = np.repeat(place - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out[target] = words.data[source]
    bytes_of = np.bincount(doc, room, n_docs).astype(np.int64)
    offsets = np.r_[0, np.cumsum(bytes_of)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), n_docs, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def slices(batch: pa.RecordBatch, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs of about ``most`` bytes of text; a longer text stands alone."""
    size = np.array([x or 0 for x in pa.compute.binary_length(batch.column(text)).to_pylist()], np.int64)
    begin = held = 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)
