"""SimHash near-dedup by the generalised pigeonhole principle.

Documents get a 64-bit fingerprint of their four-word shingles; equal fingerprints are
combined at once.  The 64 bits are split into parts that hold correlated bits together.
If two fingerprints differ in at most ``t`` bits and the parts have thresholds that sum to
``t - parts + 1`` (a threshold of -1 leaves a part out), some part differs within its
threshold.  Every fingerprint gets thresholds of its own, by dynamic programming on the
number of candidates each would bring, estimated from counts of all fingerprints.  It then
probes each part's exact-value index with all values within the threshold, and candidates
are verified on all 64 bits.  Links become components by alternating stars.

What reaches the driver or is sent along with the functions has a fixed size: 64 x 64
counts of bit pairs, 256 counts for each block of up to 8 bits, and ``MODEL_ROWS``
fingerprints on which the number of parts is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import by_value, row_hash, staged

by_value(__name__)

BITS = 64
DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Fingerprints on which the number of parts is chosen; the choice changes only the cost.
MODEL_ROWS = 1024
PARTS = (2, 3, 4, 5)
#: Cost of one probe against that of one candidate to be verified.
PROBE_COST = 4.0
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of a text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    counts = np.zeros(BITS, np.int64)
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at : min(at + _CHUNK, n)].tolist(), last[at : at + _CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``fp``."""
    chosen = docs.select(F.col(text_col).alias("_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter(map(fingerprint, batch.column(0).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(values)], names=[*keep, "fp"])

    schema = chosen.drop("_text").schema.add("fp", "long")
    return chosen.mapInArrow(run, schema)


# --- parts ------------------------------------------------------------------------------


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _pair_counts(fps: DataFrame) -> np.ndarray:
    """How often bits i and j are both set: 64 x 64 sums over all fingerprints."""

    def run(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy()).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "n"])

    sums = fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    out = np.zeros((BITS, BITS))
    for row in sums.collect():
        out[row["i"], row["j"]] = row["n"]
    return out


def grouped_bits(pairs: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Split the bits into ``parts`` groups of nearly equal width, correlated bits together."""
    share = np.diag(pairs) / max(n, 1)
    cov = pairs / max(n, 1) - np.outer(share, share)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    near = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(near, 0.0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, groups))) // (parts - k)
        group = [max(free, key=lambda b: (near[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < width:
            group.append(max(free, key=lambda b: (near[b, group].sum(), -b)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _blocks(groups: list[list[int]]) -> list[tuple[int, list[int]]]:
    """Blocks of up to 8 bits inside the parts: ``(part, bits)``."""
    return [(k, group[at : at + 8]) for k, group in enumerate(groups) for at in range(0, len(group), 8)]


def _taken(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each value, packed from the lowest."""
    out = np.zeros(len(values), np.uint64)
    for at, bit in enumerate(bits):
        out |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(at)
    return out


def _histograms(fps: DataFrame, layouts: dict[int, list[tuple[int, list[int]]]]) -> dict[int, np.ndarray]:
    """For each number of parts: counts of the 256 values of each block."""
    flat = [(m, i, bits) for m, blocks in layouts.items() for i, (_, bits) in enumerate(blocks)]

    def run(batches):
        total = np.zeros((len(flat), 256), np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for k, (_, _, bits) in enumerate(flat):
                total[k] += np.bincount(_taken(values, bits).astype(np.int64), minlength=256)
        k, v = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v), pa.array(total[k, v])], names=["k", "v", "n"])

    out = {m: np.zeros((len(blocks), 256)) for m, blocks in layouts.items()}
    sums = fps.select("fp").mapInArrow(run, "k long, v long, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
    for row in sums.collect():
        m, i, _ = flat[row["k"]]
        out[m][i, row["v"]] = row["n"]
    return out


class Allocation:
    """Parts of the bits and each fingerprint's thresholds for them."""

    def __init__(self, groups: list[list[int]], histogram: np.ndarray, n: int, distance: int):
        self.groups, self.n, self.distance = groups, n, distance
        self.spare = distance - len(groups) + 1  # what the thresholds sum to
        # From -1 for all others, one part may get at most this much.
        self.most = min(distance, self.spare + len(groups) - 1)
        apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
        self.blocks = _blocks(groups)
        # near[block][e][v]: share of fingerprints at exactly e bits from v in that block
        self.near = [
            np.stack([(apart == e) @ (h / max(n, 1)) for e in range(self.most + 1)]) for h in histogram
        ]

    def expected(self, values: np.ndarray) -> np.ndarray:
        """``[part, e, value]``: candidates expected within e bits."""
        out = np.zeros((len(self.groups), self.most + 1, len(values)))
        for k in range(len(self.groups)):
            dist = None
            for (part, bits), near in zip(self.blocks, self.near, strict=True):
                if part != k:
                    continue
                own = near[:, _taken(values, bits).astype(np.int64)]
                if dist is None:
                    dist = own
                else:
                    dist = np.stack([sum(dist[a] * own[e - a] for a in range(e + 1)) for e in range(self.most + 1)])
            out[k] = np.cumsum(dist, axis=0) * self.n
        return out

    def thresholds(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``[value, part]`` thresholds of least cost, and the cost."""
        expected = self.expected(values)
        parts, n = len(self.groups), len(values)
        room = self.spare + parts  # thresholds counted from -1: they sum to this
        best = np.full((room + 1, n), np.inf)
        best[0] = 0.0
        choice = np.zeros((parts, room + 1, n), np.int8)
        for k, group in enumerate(self.groups):
            after = np.full_like(best, np.inf)
            for e in range(-1, self.most + 1):
                probes = sum(comb(len(group), i) for i in range(e + 1))
                cost = expected[k, e] + PROBE_COST * probes if e >= 0 else np.zeros(n)
                for had in range(room - e):
                    total = best[had] + cost
                    better = total < after[had + e + 1]
                    after[had + e + 1][better] = total[better]
                    choice[k, had + e + 1][better] = e
            best = after
        out = np.zeros((n, parts), np.int8)
        left = np.full(n, room)
        for k in reversed(range(parts)):
            out[:, k] = choice[k, left, np.arange(n)]
            left = left - (out[:, k].astype(np.int64) + 1)
        return out, best[room]

    def keys(self, values: np.ndarray) -> np.ndarray:
        """``[part, value]`` exact index keys: the part's bits in place, the part above."""
        return np.stack([values & np.uint64(sum(1 << b for b in g)) for g in self.groups])


def plan(fps: DataFrame, n: int, distance: int = DISTANCE) -> Allocation:
    """Parts of least expected cost for these fingerprints."""
    pairs = _pair_counts(fps)
    groups = {m: grouped_bits(pairs, n, m) for m in PARTS if m <= distance + 1}
    histograms = _histograms(fps, {m: _blocks(g) for m, g in groups.items()})
    sample = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(MODEL_ROWS).collect()
    values = np.array([r["fp"] for r in sample], np.int64).view(np.uint64)
    allocations = [Allocation(groups[m], histograms[m], n, distance) for m in groups]
    return min(allocations, key=lambda a: a.thresholds(values)[1].mean())


def _entries(fps: DataFrame, allocation: Allocation, probe: bool) -> DataFrame:
    """Index rows, or probe rows within each fingerprint's thresholds: ``part, key, fp``."""
    masks = {
        (k, e): np.array([sum(1 << b for b in c) for c in combinations(group, e)], np.uint64)
        for k, group in enumerate(allocation.groups)
        for e in range(allocation.most + 1)
    }

    def run(batches):
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            keys = allocation.keys(values)
            limits = allocation.thresholds(values)[0] if probe else np.zeros((len(values), len(keys)), np.int8)
            for k in range(len(keys)):
                for e in range(allocation.most + 1):
                    at = np.nonzero(limits[:, k] >= e)[0]
                    mask = masks[k, e]
                    step = max(1, _CHUNK // len(mask))
                    for i in range(0, len(at), step):
                        some = at[i : i + step]
                        found = (keys[k, some][:, None] ^ mask[None, :]).ravel().view(np.int64)
                        owner = np.repeat(values[some].view(np.int64), len(mask))
                        part = np.full(len(found), k, np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(found), pa.array(owner)], names=["part", "key", "fp"])

    return fps.select("fp").mapInArrow(run, "part int, key long, fp long")


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``a, b`` of the distinct fingerprints ``fp`` that differ in 1 to ``distance`` bits.

    The larger of two fingerprints probes for the smaller, so each link is found by the
    guarantee of one side.
    """
    n = fps.count()
    if not n:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    allocation = plan(fps, n, distance)
    index = _entries(fps, allocation, False).withColumnRenamed("fp", "a")
    probes = _entries(fps, allocation, True).withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    found = probes.join(index, ["part", "key"]).filter((F.col("a") < F.col("b")) & near)
    return found.select("a", "b").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, distance: int) -> tuple[DataFrame, DataFrame]:
    marked = docs.select(F.col(id_col).alias("doc_id"), row_hash(docs).alias("row"), F.col(text_col).alias("text"))
    prints = staged(fingerprints(marked, "text", "doc_id", "row"), "simhash")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row")))
    nulls = F.min("row")  # only of rows without an id
    distinct = staged(prints.groupBy("fp").agg(first.alias("least"), nulls.alias("least_row")), "fingerprints")
    roots = staged(components(links(distinct, distance)), "roots")
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    best = labelled.groupBy("root").agg(F.min("least").alias("best"), F.min("least_row").alias("best_row"))
    return prints, staged(labelled.select("fp", "root").join(best, "root"), "groups")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    Documents whose fingerprints differ in at most ``distance`` bits are linked;
    ``component_id`` is the least doc_id reachable over links, null only where no document
    of the component has an id.  Null and wordless texts have fingerprint zero, linked
    like any other.  Repeated rows share their component.  Empty tables give an empty
    result.
    """
    prints, found = _grouped(docs, id_col, text_col, distance)
    return prints.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id")
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of each component stays, that with the least doc_id (ties: the least hash of
    the row; of wholly equal rows, one), with all its columns."""
    _, found = _grouped(docs, id_col, text_col, distance)
    stay = found.select(
        F.col("best.doc_id").alias("_id"), F.coalesce("best.row", "best_row").alias("_row")
    ).distinct()
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), row_hash(docs).alias("_row"), F.col(id_col).alias("_own")
    )
    kept = whole.join(stay, "_row").filter(F.col("_own").eqNullSafe(F.col("_id")))
    first = F.row_number().over(Window.partitionBy("_row").orderBy("_own"))
    return kept.withColumn("_n", first).filter("_n = 1").select("d.*")
