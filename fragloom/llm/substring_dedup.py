"""Substring dedup with prefix-partitioned suffix trees.

A window of ``WINDOW`` words that also starts earlier in the corpus is a repeat; every word
that a repeat covers is removed.

* Suffixes are sampled: of the word six-grams in a window, the one of least hash is its
  anchor.  Equal windows have equal anchors at equal places, so trees of the suffixes that
  begin at anchors, each with the words to its left, hold all repeats.
* Suffixes are split by prefix.  The prefix is the six words of the anchor; anchors that
  stand only once are left out.  Where more than ``GROUP`` suffixes share the six words,
  the prefix is made as long as the window: then suffixes begin at window starts, tasks
  combine equal prefixes before the shuffle, and what meets is one suffix per task.  So
  every group has a bounded size, however often a passage occurs.
* Each task builds the trees of its prefixes, as sorted suffixes with their longest common
  prefixes (an internal node of depth d is a run with common prefixes of at least d words),
  and likewise of the reversed left sides.  Two windows are equal when the node of the
  words right of the anchor and the node of those left of it are the same, deep enough to
  span the window.  All but the first window of such a node are repeats.

Words are compared as they are below a prefix of six words; a prefix as long as the window
is compared by 128 bits of its hash.  Other hashes only choose anchors and route rows.
"""

from __future__ import annotations

import hashlib
from base64 import b64encode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_value, kept_in_process, staged
from .word_arrays import byte_classes, slices, words_of

by_value(__name__)

WINDOW = 20
PREFIX = 6
#: Suffixes of one six-word prefix that one tree holds.
GROUP = 2000
SALTS = 16
_BEFORE = WINDOW - PREFIX
_ROWS = 20_000
#: Bytes of text that are worked on together.
SLICE = 1 << 22
_CLASSES = byte_classes(b" \t\n\x0b\x0c\r")
_KNOWN = 1_000_000
_COPIES, _NO_ID = 200_000, int(np.iinfo(np.int64).max)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _word_hashes(words: list[bytes]) -> np.ndarray:
    known = kept_in_process("word_hashes", _Words)
    if len(known) > _KNOWN:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _rolled(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    n = len(hashes) - length + 1
    total = np.zeros(n, np.uint64)
    for j in range(length):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return (total ^ total >> np.uint64(29)).view(np.int64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its least one, the first of equals."""
    best, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[left] <= values[right], left, right)
        reach += step
    return best


def anchors(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """``hash, doc, position, first, last`` of the anchors of all windows of some texts: the
    six-gram's hash, its text and place there, and the first and last window start it is the
    anchor of.  In order of text and place."""
    words = words_of(texts, _CLASSES)
    n = len(words.ids)
    start = np.flatnonzero(words.doc[: max(n - WINDOW + 1, 0)] == words.doc[WINDOW - 1 :])
    if not len(start):
        return (np.zeros(0, np.int64),) * 5
    own = np.fromiter(map(xxhash.xxh64_intdigest, words.vocabulary.to_pylist()), np.uint64, len(words.vocabulary))
    grams = _rolled(own[words.ids], PREFIX)
    place = _least(grams, _BEFORE + 1)[start]
    begins = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    place, first, last = place[begins], start[begins], start[np.r_[begins[1:], len(start)] - 1]
    doc = words.doc[place]
    counts = np.bincount(words.doc, minlength=len(texts))
    base = (np.cumsum(counts) - counts)[doc]
    return grams[place], doc, place - base, first - base, last - base


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _anchor_rows(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, 1, SLICE)):
            key, doc, place, _, _ = anchors(part.column(1))
            owner = part.column(0).to_numpy()[doc]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner), pa.array(place)], names=["hash", "doc", "at"])

    return rows.select("doc", "text").mapInArrow(run, "hash long, doc long, at long")


def repeated_anchors(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """``doc, at, n`` of the anchors that stand ``n`` > 1 times.

    A hash is spread over up to 64 salts; its count is looked up once for each salt in use.
    """
    found = _anchor_rows(rows).withColumn("salt", F.pmod("doc", F.lit(salts)).cast("int"))
    in_use = F.bit_or(F.expr("shiftleft(1L, salt)")).alias("in_use")
    counted = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), in_use).filter("n > 1")
    salted = counted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).filter("getbit(in_use, salt) = 1")
    return found.join(salted.select("hash", "salt", "n"), ["hash", "salt"]).select("doc", "at", "n")


_SUFFIX = "key long, doc long, at long, ahead int, first int, last int, words binary"
_NAMES = ["key", "doc", "at", "ahead", "first", "last", "words"]


def _suffixes(marked: DataFrame, group: int) -> DataFrame:
    """Suffixes of the repeated anchors, under their prefix.

    ``ahead`` words stand before the suffix in ``words``; the windows begin ``first`` to
    ``last`` words before it.  A row with ``ahead`` -1 is a repeat that its task has already
    found; ``first`` and ``last`` say where it begins.
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, tuple[int, int]] = {}  # of prefixes as long as a window

        def whole() -> list[tuple]:
            return [
                (int.from_bytes(prefix[:8], "little", signed=True), *at, 0, 0, 0, b64encode(prefix[8:])) for prefix, at in least.items()
            ]

        for batch in (part for whole_batch in batches for part in slices(whole_batch, 1, SLICE)):
            out: list[tuple] = []
            keys, owner, places, firsts, lasts = anchors(batch.column(1))
            begins = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            for i, (doc, text, marks) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                words, own = _split(text), slice(begins[i], begins[i + 1])
                often = sorted((m["at"], m["n"]) for m in marks)
                at = begins[i] + np.searchsorted(places[own], [p for p, _ in often])
                found = zip(keys[at].tolist(), firsts[at].tolist(), lasts[at].tolist(), often, strict=True)
                for key, first, last, (place, n) in found:
                    if n <= group:
                        out.append((key, doc, place, place - first, place - last, place - first, b" ".join(words[first : last + WINDOW])))
                        continue
                    known_earlier = 0
                    for start in range(first, last + 1):
                        prefix = xxhash.xxh3_128_digest(b" ".join(words[start : start + WINDOW]))
                        mine = (doc, start)
                        known = least.setdefault(prefix, mine)
                        if known < mine:
                            known_earlier |= 1 << place - start
                        elif mine < known:
                            least[prefix] = mine
                            out.append((known[0] ^ key, *known, -1, 1, 0, b""))
                    if known_earlier:
                        out.append((doc ^ key, doc, place, -1, known_earlier, 0, b""))
                if len(least) > _COPIES:
                    out += whole()
                    least.clear()
                if len(out) > _ROWS:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)
        yield batch_of(whole())

    return marked.select("doc", "text", "marks", "doc_id").mapInArrow(run, _SUFFIX)


def _nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix the node of the given depth that it hangs under."""
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(np.r_[0, common < depth])
    return node


def _tree(keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree of each key: sorted suffixes and the common prefix of neighbours."""
    order = np.lexsort([*words.T[::-1], keys])
    same = words[order[1:]] == words[order[:-1]]
    common = np.where(same.all(axis=1), words.shape[1], same.argmin(axis=1))
    common[keys[order[1:]] != keys[order[:-1]]] = -1
    return order, common


def _repeats(keys, docs, ats, ahead, first, last, contents: list[bytes]) -> np.ndarray:
    """For each suffix a mask: bit o is set if the window that starts o words before the
    suffix also starts earlier."""
    ids: dict[bytes, int] = {}
    right = np.full((len(keys), WINDOW), -1, np.int64)
    left = np.full((len(keys), _BEFORE), -1, np.int64)
    for i, (content, a) in enumerate(zip(contents, ahead.tolist(), strict=True)):
        row = [ids.setdefault(w, len(ids)) for w in content.split()]
        after = row[a : a + WINDOW]
        right[i, : len(after)] = after
        left[i, :a] = row[:a][::-1]
    right_tree, left_tree = _tree(keys, right), _tree(keys, left)
    mask = np.zeros(len(keys), np.int64)
    for o in range(_BEFORE + 1):
        at = np.flatnonzero((first <= o) & (o <= last))
        if not len(at):
            continue
        node = _nodes(*right_tree, WINDOW - o)[at] * np.int64(len(keys) + 1) + _nodes(*left_tree, o)[at]
        by = np.lexsort([ats[at], docs[at], node])
        at, node = at[by], node[by]
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        least = np.repeat(at[starts], np.diff(np.r_[starts, len(at)]))
        later = (docs[at] != docs[least]) | (ats[at] != ats[least])
        mask[at[later]] |= np.int64(1) << np.int64(o)
    return mask


def _found(suffixes: DataFrame) -> DataFrame:
    """``doc, at, mask`` of the repeats, tree by tree: rows come sorted by prefix, and whole
    prefixes are taken together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def judged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            keys, docs, ats, ahead, first, last = (rows.column(i).to_numpy() for i in range(6))
            mask = first.astype(np.int64)
            open_ = np.flatnonzero(ahead >= 0)
            if len(open_):
                contents = rows.column(6).take(pa.array(open_)).to_pylist()
                mask[open_] = _repeats(*(x[open_] for x in (keys, docs, ats, ahead, first, last)), contents)
            at = np.flatnonzero(mask)
            yield pa.RecordBatch.from_arrays([pa.array(docs[at]), pa.array(ats[at]), pa.array(mask[at])], names=["doc", "at", "mask"])

        for whole in batches:
            for begin in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(begin, _ROWS)
                held.append(batch)
                size += batch.num_rows
                keys = batch.column(0).to_numpy()
                changes = np.flatnonzero(keys[1:] != keys[:-1])
                if size < _ROWS or not len(changes):
                    continue
                cut = int(changes[-1]) + 1  # the last prefix may go on in the next batch
                held[-1] = batch.slice(0, cut)
                yield from judged(pa.Table.from_batches(held))
                held = [batch.slice(cut)]
                size = held[0].num_rows
        if held:
            yield from judged(pa.Table.from_batches(held))

    return suffixes.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc long, at long, mask long")


def _covered(n: int, starts: list[int]) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    if starts:
        change[starts] += 1
        np.subtract.at(change, np.minimum(np.array(starts) + WINDOW, n), 1)
    return np.cumsum(change[:n]) > 0


def _kept(rows: DataFrame, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, kept = _split(text), None
                if found:
                    starts = {m["at"] - o for m in found for o in range(_BEFORE + 1) if m["mask"] >> o & 1}
                    gone = _covered(len(words), sorted(starts))
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = words if kept is None else kept
                content = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(content).hexdigest())
                texts.append(content.decode("utf-8", "surrogatepass") if with_text else None)
            columns = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    schema = rows.select("doc_id").schema
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string"), ("kept", "string")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, with_text: bool = True
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256, kept``.

    ``kept`` is the kept words joined by one space (null without ``with_text``).  Windows
    are judged on the input: earlier is a smaller doc_id or, in one document, an earlier
    start.  Null and short texts have no windows and keep all their words.  A null id is
    larger than every other.  Rows that share an id are told apart by their texts, of
    which the one of smaller SHA-256 counts as earlier; rows that repeat id and text are one
    document and get the same result.  Empty tables give an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
    if shared.isEmpty():
        # Not the id itself: of two equal columns one would be left out of one of the two
        # shuffles of the texts, and they would no longer be the same.
        key = F.coalesce("doc_id", F.lit(_NO_ID))
        return _judged(rows.select(key.alias("doc"), "doc_id", "text"), group, with_text)
    found = _judged(_numbered(rows).withColumn("doc_id", F.struct("doc_id", "copies")), group, with_text)
    rest = [c for c in found.columns if c != "doc_id"]
    copies = F.explode(F.sequence(F.lit(1), F.col("doc_id.copies"))).alias("_copy")
    return found.select("doc_id.doc_id", *rest, copies).drop("_copy")


def _numbered(rows: DataFrame) -> DataFrame:
    """``doc, doc_id, text, copies``: rows that repeat id and text taken as one, numbered in
    the order of ids (nulls last) and, of one id, of their texts' digests.

    Numbers are places in range partitions after the rows of the partitions before, so that
    no id, not even the null one, is a key that rows meet under.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    alike = rows.groupBy("doc_id", digest.alias("digest")).agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    order = [F.col("no_id"), F.col("doc_id"), F.col("digest")]
    ranged = alike.withColumn("no_id", F.col("doc_id").isNull()).repartitionByRange(*order)
    placed = staged(ranged.withColumn("part", F.spark_partition_id()), "numbered-texts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return placed.join(starts, "part").select((F.col("start") + own).alias("doc"), "doc_id", "text", "copies")


def _judged(rows: DataFrame, group: int, with_text: bool) -> DataFrame:
    """The result for ``rows(doc, doc_id, text)``, where ``doc`` is unique and in id order."""
    marks = repeated_anchors(rows).groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("marks"))
    # Both joins take the same columns of the texts, so that they read one shuffle of them.
    marked = rows.join(marks, "doc")
    found = _found(_suffixes(marked, group)).groupBy("doc").agg(F.collect_list(F.struct("at", "mask")).alias("found"))
    return _kept(rows.join(found, "doc", "left").select("doc_id", "text", "found"), with_text)
