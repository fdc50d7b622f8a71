"""Phrase collocations from a weighted de Bruijn graph.

Nodes are phrases of ``LONGEST - 1`` words and edges the phrases of ``LONGEST`` words that
overlap in them, weighted by how often they stand in the corpus.  Edges are aggregated once;
every shorter count is read off the graph: a phrase stands as often as the flow that leaves
it (the phrases one word longer that begin with it) plus a correction, the places where the
piece ends with it.

* Rare edges are dead wood: a phrase that stands often has only pairs that stand often.  A
  first pass counts words and pairs by 64-bit hashes, and the hashes that reach the threshold
  become a bitmap of a fixed size.  Equal hashes or bits can only let more through.  A pair
  that is not in the bitmap ends a piece as far as the graph goes, so that most windows of
  natural text are cut to one or two words and combine in the task that read them.
* A second pass hands on, for every place, the longest phrase up to ``LONGEST`` words that
  its piece allows.  Phrases themselves are the keys: words are numbered exactly, by the
  words of a task's slice, and written out before they are combined with other tasks'.
* Flow is summed down from edges to words, one length at a time.
* A node whose whole flow goes through one edge is inside a unary path.  Paths are compacted
  by absorption: a phrase is dropped when a phrase one word longer stands as often.  That is
  the whole rule for longer phrases, too: if a phrase stands as often as some longer one that
  holds it, so does every phrase between them.

No key meets more than one row from each task, and looking up the parts of phrases is salted,
as many phrases may begin with one word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_value, looked_up, staged
from .word_arrays import Words, byte_classes, slices, words_of

by_value(__name__)

LONGEST = 5
LEAST, BEST = 100, 2000
#: Bits of the bitmap of frequent words and pairs: 8 MB, whatever the corpus.
FILTER_BITS = 1 << 26
SLICE = 1 << 22
_CLASSES = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(31)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _hashes(words: Words, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the word at each place, and of the pair of words that begins there; 0 where
    the piece ends with that word."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    own = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.vocabulary.to_pylist()), np.uint64, len(words.vocabulary))
    word = own[words.ids]
    pair = np.zeros(len(word), np.uint64)
    if len(word) > 1:
        follows = words.piece[1:] == words.piece[:-1]
        pair[:-1][follows] = _mixed(word[:-1][follows] * np.uint64(0x9E3779B97F4A7C15) + word[1:][follows])
    return word, pair


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """Words of the texts of one language at a time."""
    for batch in (part for whole in batches for part in slices(whole, 1, SLICE)):
        langs = batch.column(0)
        for lang in pa.compute.unique(langs).to_pylist():
            words = words_of(batch.column(1).filter(pa.compute.equal(langs, lang)), _CLASSES, _LOWER)
            if len(words.ids):
                yield lang, words


def _frequent_hashes(texts: DataFrame, least: int) -> DataFrame:
    """``hash`` of words and pairs that may stand ``least`` times, and of all that share theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _slices(batches):
            word, pair = _hashes(words, lang)
            found, n = np.unique(np.concatenate([word, pair[pair != 0]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["hash", "n"])

    counted = texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least).select("hash")


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bit ``hash mod bits`` for every hash: at most ``bits / 8`` bytes come to the driver."""
    place = F.pmod("hash", F.lit(bits)) + 1
    made = hashes.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    out = np.zeros((bits + 7) // 8, np.uint8)
    for row in made.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        at = (row["bucket"] - 1) * 4096
        part = np.frombuffer(row["bits"], np.uint8)[: len(out) - at]
        out[at : at + len(part)] = part
    return out


def _known(hashes: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    place = np.mod(hashes.view(np.int64), np.int64(bits))
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def longest_phrases(texts: DataFrame, bitmap: np.ndarray, bits: int, longest: int = LONGEST) -> DataFrame:
    """``lang, phrase, size, f``: for every place in ``texts`` (``lang, text``) the longest
    phrase that begins there, up to ``longest`` words, counted within tasks and over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _slices(batches):
            word, pair = _hashes(words, lang)
            n = len(word)
            alive = (pair != 0) & _known(pair, bitmap, bits)
            size = _known(word, bitmap, bits).astype(np.int64)
            going = size > 0
            for k in range(1, longest):
                going[n - k :] = False
                going[: n - k] &= alive[k - 1 : n - 1] if k > 1 else alive[: n - 1]
                size += going
            vocabulary = [w.decode() for w in words.vocabulary.to_pylist()]
            phrases, sizes, counts = [], [], []
            for k in range(1, longest + 1):
                at = np.flatnonzero(size == k)
                if not len(at):
                    continue
                # Phrases of one slice are numbered word by word: equal numbers are equal phrases.
                number = words.ids[at]
                for j in range(1, k):
                    number = np.unique(number * len(vocabulary) + words.ids[at + j], return_inverse=True)[1]
                _, one, count = np.unique(number, return_index=True, return_counts=True)
                columns = [[vocabulary[i] for i in words.ids[at[one] + j].tolist()] for j in range(k)]
                phrases += map(" ".join, zip(*columns, strict=True)) if k > 1 else columns[0]
                sizes.append(np.full(len(one), k, np.int32))
                counts.append(count)
            if phrases:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(counts), pa.int64())],
                    names=["lang", "phrase", "size", "f"],
                )

    found = texts.mapInArrow(run, "lang string, phrase string, size int, f long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))


def _first(phrase: Column, n: int) -> Column:
    return F.substring_index(phrase, " ", n)


def flows(edges: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``lang, phrase, size, f`` of all phrases, summed from the longest down: what flows on
    from a phrase and what ends with it."""
    level = edges.filter(F.col("size") == longest)
    levels = [level]
    for k in range(longest - 1, 0, -1):
        onward = level.select("lang", _first(F.col("phrase"), k).alias("phrase"), F.lit(k).alias("size"), "f")
        level = onward.unionByName(edges.filter(F.col("size") == k)).groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    best: int = BEST,
    longest: int = LONGEST,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``best`` phrases of each language.

    Texts have A-Z lowered, are split into pieces at ``. , ; : ! ?`` and U+000A to U+000D, and
    those into words at spaces and tabs.  ``n`` counts all words of the language, ``a`` the
    places of the phrase within pieces (2 to ``longest`` words, at least ``least`` places),
    ``l`` and ``r`` those of its parts at the cut of the lowest score
    ``floor(1000 a n / (l r))``, ties to the shortest first part.  Phrases inside a longer one
    that stands as often are dropped.  Order: score and ``a`` descending, then the phrase's
    bytes.

    A null language is ``und``.  Null and empty texts have no words.  Repeated rows count each
    time.  Other columns are not read.  An empty table gives an empty result.
    """
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    bitmap = _bitmap(_frequent_hashes(texts, least), filter_bits)
    edges = staged(longest_phrases(texts, bitmap, filter_bits, longest), "phrase-edges")
    lowered = F.regexp_count("text", F.lit(r"[^ \t.,;:!?\n-\r]+"))
    totals = texts.groupBy("lang").agg(F.sum(lowered).cast("long").alias("n"))
    counted = staged(flows(edges, longest).filter(F.col("f") >= least), "phrase-counts")

    phrases = counted.filter("size > 1")
    # Unary paths: what flows through one edge alone is absorbed by it.
    rest = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    inside = phrases.filter("size > 2")
    shorter = F.expr("substring_index(phrase, ' ', size - 1)")
    ends = [inside.select("lang", x.alias("phrase"), F.col("f").alias("onward")) for x in (shorter, rest)]
    through = reduce(DataFrame.unionByName, ends).groupBy("lang", "phrase").agg(F.max("onward").alias("onward"))
    open_ = phrases.join(through, ["lang", "phrase"], "left").filter("onward IS NULL OR onward < f").drop("onward")

    # Parts of every cut, looked up by (language, phrase).
    numbered = open_.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    left = F.expr("substring_index(phrase, ' ', cut)")
    right = F.expr("substring(phrase, length(substring_index(phrase, ' ', cut)) + 2)")
    parts = counted.select(F.struct("lang", "phrase").alias("part"), F.col("f").alias("part_f"))
    cuts = numbered.withColumn("part", F.struct("lang", left.alias("phrase")))
    cuts = looked_up(cuts, parts, "part", "phrase").withColumnRenamed("part_f", "l").drop("part")
    cuts = cuts.withColumn("part", F.struct("lang", right.alias("phrase")))
    cuts = looked_up(cuts, parts, "part", "phrase").withColumnRenamed("part_f", "r").drop("part")
    wide = "cast({} as decimal(38,0))".format
    cuts = looked_up(cuts, totals, "lang", "phrase").withColumn("score", F.expr(f"({wide(1000)} * a * n) div ({wide('l')} * r)"))
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("at")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest)
    order = Window.partitionBy("lang").orderBy(F.col("at.score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "at.l", "at.r", "n", "at.score")

