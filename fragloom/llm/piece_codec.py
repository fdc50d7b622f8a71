"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Text is cut in front of each run of spaces, which no piece crosses.  In each cut the
agenda holds all neighbouring symbols that form a piece, best score first; a candidate
taken from it is skipped with the probability ``dropout``, and otherwise merged, which
brings its new neighbours onto the agenda.  Which are skipped is drawn for each cut of
each document by a hash of the seed, the document's id, its copy and the cut's place in
the text, so that a run can be repeated exactly and a word is spelt anew wherever it
stands.

The draws say how many candidates are taken before the next one is skipped.  A spelling
depends on the cut and the places of the skips on its agenda alone, so a worker remembers
spellings by both, as trees: a cut's root is its spelling without skips, a child has one
skip more.

Without dropout the ids are those of the sentencepiece library, but for a literal U+2581,
which is spelt in bytes here, so that decoding gives back every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import islice, repeat, takewhile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import parts
from .shared import by_value, kept_in_process

by_value(__name__)

SPACE = "▁"
DROPOUT = 0.1
#: Spellings a worker remembers; beyond it, the memory is begun anew.
MEMORY = 250_000
_CUTS = re.compile(r" *[^ ]+| +").findall
_MASK = (1 << 64) - 1
_NEVER = np.int64(1 << 62)
#: Cuts up to this length are remembered, and spelt side by side, so many at once.
SIDE_BY_SIDE = 48
_AT_ONCE = 8_000
#: Characters whose cuts are looked at together.
_RUN = 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _gaps(keys: np.ndarray, steps: np.ndarray, dropout: float) -> np.ndarray:
    """How many candidates are taken between a key's skips ``steps - 1`` and ``steps``."""
    h = _mixed(keys + (steps + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    u = ((h >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
    return np.minimum(np.log(u) / np.log1p(-dropout), 1 << 40).astype(np.int64) if dropout < 1 else np.zeros(u.shape, np.int64)


def _skips(key: int, dropout: float) -> Iterator[int]:
    """The places on the agenda of the candidates that a key skips, without end."""
    at, step = 0, 0
    while dropout:
        for gap in _gaps(np.array([key], np.uint64), np.arange(step, step + 64, dtype=np.uint64), dropout).tolist():
            yield at + gap
            at += gap + 1
        step += 64


class Pieces:
    """The pieces of a model file and the merges they allow."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[piece] = i
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        crossing = re.compile(f"[^{SPACE}]{SPACE}").search
        if any(map(crossing, self.ids)):
            raise ValueError("a piece crosses the front of a space")
        # A pair of symbols is one number; the number above all ids stands for a character
        # that is no piece, and forms no pair.
        self.shift = n.bit_length()
        self.none = (1 << self.shift) - 1
        self.first = self.ids | {" ": self.ids.get(SPACE, self.none), SPACE: self.none}
        self.scores = {i: -model.get_score(i) for i in self.ids.values()}

    @cached_property
    def merges(self) -> dict[int, tuple[float, int]]:
        """For each pair that forms a piece its place on the agenda and the piece; decoding
        does without them."""
        merges = {}
        for piece, i in self.ids.items():
            if any(c not in self.ids for c in piece):
                raise ValueError("a piece has a character that is no piece")
            for at in range(1, len(piece)):
                left, right = self.ids.get(piece[:at]), self.ids.get(piece[at:])
                if left is not None and right is not None:
                    merges[left << self.shift | right] = self.scores[i], i
        return merges

    def spell(self, cut: str, key: int, dropout: float) -> list[int]:
        """Ids of one cut, in which a space stands for the model's own mark."""
        skips = _skips(key, dropout)
        skip, taken = next(skips, -1), 0
        pair, shift, first, none = self.merges.get, self.shift, self.first.get, self.none
        symbols = [first(c, none) for c in cut]
        n = len(symbols)
        end = list(range(1, n + 1))
        before = list(range(-1, n))
        agenda = []
        left = symbols[0]
        for i in range(1, n):
            right = symbols[i]
            if found := pair(left << shift | right):
                agenda.append((found[0], i - 1, i, i + 1, found[1]))
            left = right
        heapify(agenda)
        while agenda:
            _, i, j, e, merged = heappop(agenda)
            if end[i] != j or end[j] != e:
                continue  # one of the two has been merged otherwise
            taken += 1
            if taken - 1 == skip:
                skip = next(skips)
                continue
            symbols[i], end[i], end[j] = merged, e, 0
            if e < n:
                before[e] = i
                if found := pair(merged << shift | symbols[e]):
                    heappush(agenda, (found[0], i, e, end[e], found[1]))
            if (b := before[i]) >= 0 and (found := pair(symbols[b] << shift | merged)):
                heappush(agenda, (found[0], b, i, e, found[1]))
        out: list[int] = []
        i = 0
        while i < n:
            if symbols[i] != none:
                out.append(symbols[i])
            else:
                out += [self.byte_ids[x] for x in cut[i].encode()]
            i = end[i]
        return out

    @cached_property
    def arrays(self) -> tuple[np.ndarray, ...]:
        """The merges as sorted arrays (pair, order of its score, piece) and the symbols of
        all characters."""
        pairs = np.array(sorted(self.merges), np.int64)
        scores = np.array([self.merges[p][0] for p in pairs.tolist()])
        order = np.unique(scores, return_inverse=True)[1].astype(np.int64)
        made = np.array([self.merges[p][1] for p in pairs.tolist()], np.int64)
        symbols = np.full(0x110000, self.none, np.int64)
        for c, i in self.first.items():
            if len(c) == 1:
                symbols[ord(c)] = i
        return pairs, order, made, symbols

    def spell_all(self, cuts: list[str], keys: np.ndarray, dropout: float) -> list[bytes]:
        """:meth:`spell` for many cuts at once."""
        # Each merge brings at most two candidates besides those of the characters.
        places = [list(takewhile((3 * len(c)).__gt__, _skips(int(k), dropout))) for c, k in zip(cuts, keys, strict=True)]
        skips = np.full((len(cuts), max(map(len, places), default=0)), -1, np.int64)
        for i, own in enumerate(places):
            skips[i, skips.shape[1] - len(own) :] = own
        ids, sizes, _ = self.side_by_side(cuts, skips)
        ends = np.cumsum(sizes)
        return [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]

    def side_by_side(self, cuts: list[str], skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all cuts, how many each has, and how many candidates each has taken or
        skipped.  A row of ``skips`` has the places of the candidates to skip, rising, with
        -1 in front.  The agendas are worked off side by side: in each round every cut takes
        the best candidate of its own.
        """
        pairs, order, made, first = self.arrays
        skip, taken = (skips < 0).sum(axis=1), np.zeros(len(cuts), np.int64)
        skips = np.column_stack([skips, np.full(len(cuts), -1)])
        codes = np.frombuffer("".join(cuts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, cuts), np.int64, len(cuts))
        starts_at = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(cuts)), lengths)
        symbol = first[codes]
        begin = np.arange(len(owner)) - np.repeat(starts_at, lengths)
        end = begin + 1

        def candidates(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """For symbols at ``at`` and their right neighbours: place on the agenda, piece."""
            pair = symbol[at] << self.shift | symbol[at + 1]
            found = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            return np.where(pairs[found] == pair, order[found] << 20 | begin[at], _NEVER), made[found]

        place, piece = np.full(len(owner), _NEVER), np.zeros(len(owner), np.int64)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        if len(inner):
            place[inner], piece[inner] = candidates(inner)
        done: list[tuple[np.ndarray, ...]] = [(owner[:0], symbol[:0], begin[:0])]
        turn = 0
        while len(owner):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(place, starts)
            size = np.diff(np.r_[starts, len(owner)])
            over = np.repeat(best == _NEVER, size)
            done.append((owner[over], symbol[over], begin[over]))
            owner, symbol, begin, end, place, piece, best = (
                x[~over] for x in (owner, symbol, begin, end, place, piece, np.repeat(best, size))
            )
            left = np.flatnonzero(place == best)
            own = owner[left]
            taken[own] += 1
            skipped = skips[own, skip[own]] == turn
            skip[own[skipped]] += 1
            place[left[skipped]] = _NEVER
            left = left[~skipped]
            turn += 1
            symbol[left], end[left] = piece[left], end[left + 1]
            stays = np.ones(len(owner), bool)
            stays[left + 1] = False
            owner, symbol, begin, end, place, piece = (x[stays] for x in (owner, symbol, begin, end, place, piece))
            left = left - np.arange(len(left))
            place[left] = _NEVER
            last = len(owner) - 1
            for at in (left, left - 1):
                at = at[(at >= 0) & (at < last)]
                at = at[owner[at] == owner[at + 1]]
                if len(at):
                    place[at], piece[at] = candidates(at)
        owner, symbol, begin = (np.concatenate(x) for x in zip(*done, strict=True))
        by_owner = np.argsort(owner, kind="stable")
        owner, symbol, begin = owner[by_owner], symbol[by_owner], begin[by_owner]
        # Characters that are no pieces are spelt in bytes.
        odd = np.flatnonzero(symbol == self.none)
        spelt = [[self.byte_ids[x] for x in chr(c).encode()] for c in codes[starts_at[owner[odd]] + begin[odd]].tolist()]
        width = np.ones(len(owner), np.int64)
        width[odd] = [len(x) for x in spelt]
        ids = np.repeat(symbol, width).astype(np.int32)
        if spelt:
            ids[np.repeat(symbol == self.none, width)] = np.concatenate(spelt)
        return ids, np.bincount(owner, width, len(cuts)).astype(np.int64), taken


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.held, self.n = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.held):
            self.held = np.concatenate([self.held, np.empty(max(n, len(self.held)), self.held.dtype)])
        self.held[self.n : n], self.n = values, n


class _Spellings:
    """Remembered spellings.  A node is a cut with some skips: its ids, and how many
    candidates follow its last skip; each of those has a slot for the child that skips it."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.roots: dict[str, int] = {}
        self.cuts: list[str] = []  # by node
        self.ids, self.children = _Grown(np.int32), _Grown(np.int32)
        self.begin, self.slots = _Grown(np.int64), _Grown(np.int64)
        self.size, self.follow, self.parent, self.last = (_Grown(np.int32) for _ in range(4))

    def _add(self, cuts: list[str], parents: np.ndarray, last: np.ndarray) -> None:
        """New nodes below ``parents`` (-1 for roots), whose last skips are at ``last``."""
        for at in range(0, len(cuts), _AT_ONCE):
            some, up, own = cuts[at : at + _AT_ONCE], parents[at : at + _AT_ONCE], last[at : at + _AT_ONCE]
            self.parent.add(up)
            self.last.add(own)
            columns = [own]
            while (up >= 0).any():
                columns.append(np.where(up >= 0, self.last.held[up], -1))
                up = np.where(up >= 0, self.parent.held[up], -1)
            ids, size, taken = self.pieces.side_by_side(some, np.column_stack(columns[::-1]))
            follow = taken - (own + 1)
            self.begin.add(self.ids.n + np.cumsum(size) - size)
            self.slots.add(self.children.n + np.cumsum(follow) - follow)
            self.size.add(size)
            self.follow.add(follow)
            self.ids.add(ids)
            self.children.add(np.full(int(follow.sum()), -1, np.int32))
            self.cuts += some

    def of(self, cuts: list[str]) -> np.ndarray:
        """The cuts' roots; -1 for cuts that are too long to be remembered."""
        nodes = np.fromiter(map(self.roots.get, cuts, repeat(-1)), np.int64, len(cuts))
        unknown = np.flatnonzero(nodes < 0).tolist()
        if new := [c for c in dict.fromkeys(cuts[i] for i in unknown) if len(c) <= SIDE_BY_SIDE]:
            self.roots.update(zip(new, range(self.parent.n, self.parent.n + len(new)), strict=True))
            self._add(new, np.full(len(new), -1), np.full(len(new), -1))
            nodes[unknown] = [self.roots.get(cuts[i], -1) for i in unknown]
        return nodes

    def below(self, nodes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """The children of ``nodes`` that skip the candidate after ``gaps`` others."""
        slots = self.slots.held[nodes] + gaps
        missing = np.flatnonzero(self.children.held[slots] < 0)
        if len(missing):
            new, at = np.unique(slots[missing], return_index=True)
            at, n = missing[at], self.parent.n
            self._add([self.cuts[i] for i in nodes[at].tolist()], nodes[at], self.last.held[nodes[at]] + 1 + gaps[at])
            self.children.held[new] = np.arange(n, n + len(new))
        return self.children.held[slots]


class Codec:
    """Encodes and decodes texts with one model, seed and dropout."""

    def __init__(self, path: str, seed: int = 0, dropout: float = DROPOUT):
        self.pieces, self.seed, self.dropout = Pieces(path), seed, dropout
        self.spellings = _Spellings(self.pieces)

    def encode_all(self, texts: list[str], keys: list[object]) -> list[np.ndarray]:
        """Ids of each text; a text's key (its id, and copy) and a cut's place in it draw
        what is skipped."""
        if self.spellings.parent.n > MEMORY:
            self.spellings = _Spellings(self.pieces)
        known = self.spellings
        each = [_CUTS(" " + t) if t else [] for t in texts]  # the model puts a space in front
        n = np.fromiter(map(len, each), np.int64, len(each))
        cuts = [c for own in each for c in own]
        nodes = known.of(cuts)
        own = np.array([xxhash.xxh64_intdigest(str(k).encode(), self.seed & _MASK) for k in keys], np.uint64)
        place = np.arange(len(cuts)) - np.repeat(np.cumsum(n) - n, n)
        drawn = _mixed(np.repeat(own, n) + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        active, step = np.flatnonzero(nodes >= 0), 0
        while len(active) and self.dropout:
            gaps = _gaps(drawn[active], np.array([step], np.uint64), self.dropout)
            skips = gaps < known.follow.held[nodes[active]]
            active = active[skips]
            nodes[active] = known.below(nodes[active], gaps[skips])
            step += 1
        long = np.flatnonzero(nodes < 0).tolist()
        alone = [np.array(self.pieces.spell(cuts[i], int(drawn[i]), self.dropout), np.int32) for i in long]
        size = known.size.held[nodes].astype(np.int64)
        size[long] = [len(x) for x in alone]
        ends = np.cumsum(size)
        at = known.begin.held[nodes]
        at[long] = 0
        from_ids = np.repeat(at - (ends - size), size) + np.arange(int(size.sum()))
        for i in long:
            from_ids[ends[i] - size[i] : ends[i]] = 0
        ids = known.ids.held[from_ids].astype("<i4")
        for i, x in zip(long, alone, strict=True):
            ids[ends[i] - size[i] : ends[i]] = x
        return np.split(ids, np.r_[0, ends][np.cumsum(n)[:-1]]) if len(n) else []

    def encode(self, text: str, key: object = None) -> np.ndarray:
        return self.encode_all([text], [key])[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _codec(path: str, seed: int, dropout: float) -> Codec:
    made = kept_in_process("piece_codecs", dict)
    at = (path, seed, dropout)
    if at not in made:
        made[at] = Codec(*at)
    return made[at]


def encode(
    docs: DataFrame,
    model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    out_col: str = "ids",
    seed: int = 0,
    dropout: float = DROPOUT,
    copy_col: str | None = None,
) -> DataFrame:
    """All columns of ``docs`` and the ids of the whole text.

    A null text has null ids, an empty one none.  The same text under the same id, copy,
    seed and dropout gives the same ids in every run.  ``copy_col`` tells rows apart that
    repeat an id and are to be spelt anew; without it, repeated rows are alike.
    ``out_col`` replaces a column of that name.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != out_col]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, seed, dropout)
        for batch in _sliced(batches):
            row = batch.column(0)
            ids_of, texts = row.field(id_col).to_pylist(), row.field(text_col).to_pylist()
            owners = iter(zip(ids_of, row.field(copy_col).to_pylist(), strict=True) if copy_col else ids_of)
            spelt = [x for run in parts([t or "" for t in texts], _RUN) for x in codec.encode_all(run, list(islice(owners, len(run))))]
            ends = np.cumsum([0, *(len(x) for x in spelt)])
            offsets = pa.array(ends, pa.int32(), mask=np.array([*(t is None for t in texts), False]))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(spelt), pa.int32()))
            yield pa.RecordBatch.from_arrays([row, ids], names=["row", out_col])

    schema = T.StructType([rows.schema["row"], T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema).select("row.*", out_col)


def decode(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and the text of the ids; null ids have a null text.
    ``out_col`` replaces a column of that name."""
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != out_col]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, 0, 0.0)
        for batch in _sliced(batches):
            ids = batch.column(0).field(ids_col)
            values, offsets, known = ids.values.to_numpy(), ids.offsets.to_numpy(), ids.is_valid().to_pylist()
            texts = [codec.decode(values[a:b]) if k else None for a, b, k in zip(offsets[:-1], offsets[1:], known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", out_col])

    schema = T.StructType([whole.schema["row"], T.StructField(out_col, T.StringType())])
    return whole.mapInArrow(run, schema).select("row.*", out_col)
