"""Token ids of whole texts as the tokenizers library gives them, spelt out once per piece.

The byte-level pre-tokenizer always begins a new piece at a space that a non-space follows.
Texts are therefore cut there, all texts of a slice at once, and each distinct piece between
two cuts is encoded by the library once and then remembered by the worker; the ids of a text
are those of its pieces in a row.  Texts that hold the string of an added token are given to
the library whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from .shared import by_value, kept_in_process
from .word_arrays import slices

by_value(__name__)

#: Bytes of remembered pieces in a worker; beyond it, pieces met in one slice only are forgotten.
MEMORY = 80 << 20
#: What a remembered piece takes besides its bytes and ids.
ENTRY = 160
#: New pieces that are given to the library in a row, as one text.
ROW = 64
#: Bytes of text that are cut and spelt together.
SLICE = 1 << 22


def version(path: str) -> str:
    """Digest of the tokenizer file and the library that reads it."""
    import tokenizers

    with open(path, "rb") as file:
        content = file.read()
    return hashlib.sha256(content + b"\n" + tokenizers.__version__.encode()).hexdigest()


def _after_cut() -> np.ndarray:
    """Bytes before which a space is a cut: whatever begins no white space, for certain."""
    table = np.ones(256, bool)
    table[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = False
    return table


class Encoder:
    """Ids of string columns."""

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        step = spec["pre_tokenizer"] or {}
        plain = step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space")
        added = spec.get("added_tokens") or []
        simple = not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
        #: Whether texts may be cut at spaces; otherwise every text is encoded whole.
        self.cuts = bool(plain and simple and spec.get("normalizer") is None)
        self.added = [a["content"] for a in added]
        self.after = _after_cut()
        # The byte-level alphabet spells a token with one character a byte.
        lengths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            lengths[i] = len(token)
        self.lengths = lengths
        self.memory = memory
        self._forget(np.zeros(0, np.int64))

    # Remembered pieces: ``places`` by their bytes; ``begin``, ``size`` and ``seen`` by place;
    # their ids in ``ids``.
    def _forget(self, kept: np.ndarray) -> None:
        if not len(kept):
            self.places: dict[bytes, int] = {}
            self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(0, np.int64)
            self.size, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        new = np.full(len(self.size), -1, np.int64)
        new[kept] = np.arange(len(kept))
        self.ids = self.ids[_spread(self.begin[kept], self.size[kept])]
        self.size = self.size[kept]
        self.begin = np.cumsum(self.size) - self.size
        self.seen = np.zeros(len(kept), np.int64)
        self.places = {piece: int(to) for piece, at in self.places.items() if (to := new[at]) >= 0}

    def _held(self) -> int:
        return ENTRY * len(self.places) + 4 * len(self.ids)

    def _spelt(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row and their number in each.  Pieces that begin with the
        space of a cut are encoded in rows and told apart by their bytes."""
        inner = [i for i, p in enumerate(pieces) if p[:1] == b" " and len(p) > 1 and self.after[p[1]]]
        single = sorted(set(range(len(pieces))) - set(inner))
        texts = [b"".join(pieces[i] for i in inner[k : k + ROW]).decode() for k in range(0, len(inner), ROW)]
        texts += [pieces[i].decode() for i in single]
        found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        order = np.array([*inner, *single], np.int64)
        ends = np.cumsum([len(pieces[i]) for i in order.tolist()])
        told = np.cumsum(self.lengths[ids])
        at = np.searchsorted(told, ends)
        if not np.array_equal(told[at], ends):
            raise ValueError("a token crosses a piece")
        size = np.empty(len(pieces), np.int64)
        size[order] = np.diff(np.r_[-1, at])
        begin = np.empty(len(pieces), np.int64)
        begin[order] = np.r_[0, at[:-1] + 1] if len(at) else at
        return ids[_spread(begin, size)], size

    def _known(self, pieces: list[bytes]) -> np.ndarray:
        """Places of distinct pieces; new ones are encoded and remembered."""
        places = np.fromiter((self.places.get(p, -1) for p in pieces), np.int64, len(pieces))
        new = np.flatnonzero(places < 0)
        if len(new):
            fresh = [pieces[i] for i in new.tolist()]
            ids, size = self._spelt(fresh)
            places[new] = len(self.size) + np.arange(len(new))
            self.places.update(zip(fresh, places[new].tolist(), strict=True))
            self.begin = np.r_[self.begin, len(self.ids) + np.cumsum(size) - size]
            self.ids, self.size = np.r_[self.ids, ids], np.r_[self.size, size]
            self.seen = np.r_[self.seen, np.zeros(len(new), np.int64)]
        self.seen[places] += 1
        return places

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has; a null has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        if self.cuts:
            found = [pa.compute.match_substring(texts, a) for a in self.added]
            whole = np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in found]) if found else np.zeros(n, bool)
        else:
            whole = np.ones(n, bool)
        special = np.flatnonzero(whole)
        spelt = self._whole(texts.take(pa.array(special)).to_pylist()) if len(special) else []
        plain = pa.compute.if_else(pa.array(whole), "", texts).cast(pa.large_string()) if len(special) else texts
        ids, counts = self._cut(plain)
        if not len(special):
            return ids, counts
        parts, done = [], 0
        ends = np.cumsum(counts)
        for i, own in zip(special.tolist(), spelt, strict=True):
            parts += [ids[done : ends[i]], own]
            done, counts[i] = int(ends[i]), len(own)
        return np.concatenate([*parts, ids[done:]]), counts

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self._held() > self.memory:
            kept = np.flatnonzero(self.seen > 1)
            self._forget(kept)
            if self._held() > self.memory // 2:
                self._forget(np.zeros(0, np.int64))
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        base = int(ends[0])
        content = texts.buffers()[2]
        raw = np.frombuffer(content, np.uint8)[base : int(ends[-1])] if content is not None else np.zeros(0, np.uint8)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        begins = np.zeros(len(raw) + 1, bool)
        begins[:-2] = (raw[:-1] == 32) & self.after[raw[1:]]
        begins[ends[:-1] - base] = True
        at = np.flatnonzero(begins[:-1])
        offsets = np.r_[at, len(raw)].astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        places = self._known(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        size = self.size[places]
        ids = self.ids[_spread(self.begin[places], size)]
        text_of = np.searchsorted(ends[1:] - base, at, side="right")
        return ids, np.bincount(text_of, size, len(texts)).astype(np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32 bytes."""
        ids, counts = self.encode_column(pa.array(texts, pa.large_string()))
        ends = np.cumsum(counts)
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the stretches that begin at ``begin`` and have ``size`` places."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def encoder(path: str) -> Encoder:
    """This worker's encoder for the file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    made = kept_in_process("byte_bpe_encoders", dict)
    if path not in made:
        made[path] = Encoder(path)
    return made[path]


def encoded(path: str, batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows some at a time, with the ids of their texts in a row and the number of each."""
    own = encoder(path)
    for batch in batches:
        for rows in slices(batch, text, SLICE):
            yield rows, *own.encode_column(rows.column(text))


def parts(texts: Iterable[str], most: int = 1 << 22) -> Iterator[list[str]]:
    """Texts in runs of about ``most`` characters, so that memory is bounded by those."""
    run: list[str] = []
    size = 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run
