"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words of smallest period q and at least ``max(least, 2 q)`` words that
no neighbouring word extends.

* The suffixes of a text are sorted by prefix doubling; the ranks of every doubling step are
  kept, so that two stretches of words are compared in as many steps as their length has bits.
* The text is cut into dyadic blocks of ``B = 2, 4, 8, …`` words.  A run of period q between
  ``2 B - 1`` and ``4 B - 2`` is long enough to hold a whole block that stands again q words
  on, still within the run (for B = 2 that holds from period 1 to 6, as runs have at least 12
  words).  So each block looks for its own occurrences in the neighbouring windows, where
  such a q can end.
* The occurrences of a block are an interval of the suffix array; a wavelet tree over that
  array gives the next one from a place on (range successor), and the last one up to a place.
* Occurrences of a block of B words that begin within B places are an arithmetic progression,
  known from its first two and its last.  Each gives a candidate period, unless the block and
  the progression are one stretch of the progression's own period: no run has a smallest
  period that leads from there to there (Fine and Wilf), and that stretch's own period is
  found by smaller blocks.
* A candidate is extended to both sides as far as it holds; what is long enough is a run, and
  of equal stretches the smallest period counts.

Texts are sorted some at a time, a longer one by itself: memory grows with the longest text,
by about 200 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .shared import by_value
from .word_arrays import byte_classes, joined, slices, words_of

by_value(__name__)

LEAST = 12
#: Bytes of text that are sorted together.
SLICE = 1 << 21
_CLASSES = byte_classes(b" \t\n\x0b\x0c\r")


class Ranks:
    """Ranks of the stretches of 1, 2, 4, … words at every place, told apart by text."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, end: np.ndarray):
        n = len(ids)
        place = np.arange(n)
        order = np.argsort(doc * (ids.max() + 1) + ids, kind="stable") if n else place
        key = doc[order] * (ids.max() + 1) + ids[order] if n else place
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], place, 0)) if n else place
        self.levels = [rank]
        size = np.bincount(rank, minlength=n) if n else place
        open_ = np.flatnonzero(size[rank] > 1)
        step = 1
        while len(open_):
            rank = rank.copy()
            far = open_ + step
            second = np.where(far < end[open_], self.levels[-1][np.minimum(far, n - 1)], -1)
            first = self.levels[-1][open_]
            by = np.lexsort([second, first])
            first, second, at = first[by], second[by], open_[by]
            new_group = np.r_[True, first[1:] != first[:-1]]
            new_rank = new_group | np.r_[True, second[1:] != second[:-1]]
            count = np.arange(len(at))
            within = count - np.maximum.accumulate(np.where(new_group, count, 0))
            rank[at] = np.maximum.accumulate(np.where(new_rank, first + within, 0))
            self.levels.append(rank)
            size = np.bincount(rank[at], minlength=n)
            open_ = open_[size[rank[open_]] > 1]
            step *= 2
        #: Suffixes in order; the last level tells all of them apart.
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[self.levels[-1]] = place
        self.n = n

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from the places ``a`` and ``b`` on."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            ok = (a < self.n) & (b < self.n)
            rank = self.levels[k]
            ok[ok] = rank[a[ok]] == rank[b[ok]]
            total[ok] += 1 << k
            a[ok] += 1 << k
            b[ok] += 1 << k
        return total

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words that end just before the places ``a`` and ``b``."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            ok = (a >= 1 << k) & (b >= 1 << k)
            rank = self.levels[k]
            ok[ok] = rank[a[ok] - (1 << k)] == rank[b[ok] - (1 << k)]
            total[ok] += 1 << k
            a[ok] -= 1 << k
            b[ok] -= 1 << k
        return total


class WaveletTree:
    """Counts and order statistics of the values in a range of places, a bit at a time."""

    def __init__(self, values: np.ndarray):
        self.steps: list[tuple[int, np.ndarray, int]] = []
        for b in range(max(len(values) - 1, 1).bit_length() - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            zeros = np.r_[0, np.cumsum(~one)].astype(np.int32)
            self.steps.append((b, zeros, int(zeros[-1])))
            values = np.r_[values[~one], values[one]]

    def below(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values in ``[left, right)`` are smaller than ``value``."""
        count = np.zeros(len(left), np.int64)
        top = 1 << len(self.steps)
        over = value >= top
        count[over] = (right - left)[over]
        left, right = left.copy(), np.where(over, left, right)
        for b, zeros, n_zeros in self.steps:
            zl, zr = zeros[left].astype(np.int64), zeros[right].astype(np.int64)
            one = (value >> b & 1).astype(bool)
            count += np.where(one, zr - zl, 0)
            left, right = np.where(one, n_zeros + left - zl, zl), np.where(one, n_zeros + right - zr, zr)
        return count

    def smallest(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value, from 0, in ``[left, right)``."""
        value, k = np.zeros(len(left), np.int64), k.copy()
        for b, zeros, n_zeros in self.steps:
            zl, zr = zeros[left].astype(np.int64), zeros[right].astype(np.int64)
            one = k >= zr - zl
            k = np.where(one, k - (zr - zl), k)
            value |= one.astype(np.int64) << b
            left, right = np.where(one, n_zeros + left - zl, zl), np.where(one, n_zeros + right - zr, zr)
        return value


def _members(first: np.ndarray, step: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of arithmetic progressions, and the number of the one each is from."""
    owner = np.repeat(np.arange(len(first)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return first[owner] + step[owner] * nth, owner


def find_runs(ids: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, period`` of all runs of texts given in a row: word numbers and, not
    descending, the text of each word.  Sorted by start, then period."""
    if least < 12:
        raise ValueError("blocks of two words find the shortest periods of runs of 12 words or more")
    n = len(ids)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    last = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True])
    end = np.repeat(last + 1, np.diff(np.r_[-1, last]))
    ranks = Ranks(ids, doc, end)
    tree = None
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(1, len(ranks.levels)):
        width = 1 << k
        low, high = (1, 6) if k == 1 else (2 * width - 1, 4 * width - 2)
        at = np.arange(0, n, width)
        at = at[at + low + width <= end[at]]
        rank = ranks.levels[k]
        size = np.bincount(rank, minlength=n)
        at = at[size[rank[at]] > 1]
        if not len(at):
            continue
        tree = tree or WaveletTree(ranks.suffixes)
        left, right = rank[at], rank[at] + size[rank[at]]
        stop = np.minimum(at + high, end[at] - width) + 1
        before, upto = tree.below(left, right, at + low), tree.below(left, right, stop)
        some = before < upto
        at, left, right, stop = at[some], left[some], right[some], stop[some]
        for x in range(low, high + 1, width):
            begin = np.minimum(at + x, stop)
            a = tree.below(left, right, begin)
            b = tree.below(left, right, np.minimum(at + x + width, stop))
            hit = np.flatnonzero(b > a)
            if not len(hit):
                continue
            i, l, r, a, count = at[hit], left[hit], right[hit], a[hit], (b - a)[hit]
            first = tree.smallest(l, r, a)
            step = tree.smallest(l, r, np.minimum(a + 1, b[hit] - 1)) - first
            final = tree.smallest(l, r, b[hit] - 1)
            many = np.flatnonzero(count > 2)
            if len(many):
                own = ranks.common(i[many], i[many] + step[many]) >= final[many] + width - i[many] - step[many]
                keep = np.ones(len(i), bool)
                keep[many[own]] = False
                i, first, step, count = i[keep], first[keep], step[keep], count[keep]
            place, owner = _members(first, step, count)
            found.append((i[owner], place - i[owner]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    at, period = (np.concatenate(x) for x in zip(*found, strict=True))
    start = at - ranks.common_before(at, at + period)
    stop = at + period + ranks.common(at, at + period)
    long = stop - start >= np.maximum(least, 2 * period)
    start, stop, period = start[long], stop[long], period[long]
    by = np.lexsort([period, stop, start])
    start, stop, period = start[by], stop[by], period[by]
    fresh = np.r_[True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])] if len(start) else np.zeros(0, bool)
    start, stop, period = start[fresh], stop[fresh], period[fresh]
    by = np.lexsort([period, start])
    return start[by], stop[by], period[by]


_RUNS = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))


def with_runs(
    docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, least: int = LEAST, slice_bytes: int = SLICE
) -> DataFrame:
    """The columns of ``docs``, or those of ``carry``, in a struct ``row``, with ``n_words``, the ``runs`` of the
    text (by start, then period; words numbered from 0) and ``collapsed``: the words that no
    run contains after its first period, joined by one space.

    Words are what stands between white space (space and U+0009 to U+000D).  Null and empty
    texts have no words, no runs and an empty ``collapsed``.  Each row is judged by itself,
    so that repeated rows and ids need no rule; no row is dropped, and no column of ``docs``
    can clash.  An empty table gives an empty result.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, slice_bytes)):
            words = words_of(batch.column(1), _CLASSES)
            n = batch.num_rows
            start, stop, period = find_runs(words.ids, words.doc, least)
            change = np.zeros(len(words.ids) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.subtract.at(change, stop, 1)
            text = joined(words, np.cumsum(change[:-1]) == 0, n).cast(pa.string())
            counts = np.bincount(words.doc, minlength=n)
            base = np.cumsum(counts) - counts
            owner = words.doc[start]
            offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int32)
            columns = [pa.array(start - base[owner]), pa.array(stop - start), pa.array(period)]
            members = pa.StructArray.from_arrays(columns, fields=list(kind.value_type))
            runs = pa.ListArray.from_arrays(pa.array(offsets), members).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), runs, text], names=["row", "n_words", "runs", "collapsed"])

    row = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row")
    given = docs.select(row, F.col(f"`{text_col}`").alias("text"))
    schema = given.select("row").schema.add("n_words", "long").add("runs", _RUNS).add("collapsed", "string")
    return given.mapInArrow(run, schema)
