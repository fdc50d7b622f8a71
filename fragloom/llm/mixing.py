"""Mixing sources to target weights over a time-varying curriculum.

Each source gets a target number of words.  Its documents stand in an order drawn by a
keyed hash, are read from the start and, where the target is larger than the source, once
more.  A source's demand is a rate that varies over training time ``t`` in [0, 1]; its
integral says how much of the target is due by ``t``, and inverting that integral gives
the time at which each document is due.  The integral of all sources' demand at that time
is the document's training position, by which the mix is range-sorted.

Running sums never put a source into one task: documents are summed per (source, bucket),
buckets are summed per source, and only a bucket's own documents are ordered together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import row_hash, staged, word_count

#: Target weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Rates at time 0, 1/2 and 1, linear between, of the same sources; they are scaled so that
#: each integral is 1.  Heavy sources fade, light ones grow.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
BUDGET = 1.5
MOST_EPOCHS = 2


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """``source, source_size, rank, target`` of the one-row-per-source table ``source, source_size``.

    Shares are filled like water: a source stops at twice its size, the excess goes to the
    others by weight.  The sources that stop are those with the least room per weight, so
    one ordering by room settles all of them.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", (F.row_number().over(by_name) - 1).cast("long"))
    ranked = ranked.withColumn("weight", F.get(cycle, (F.col("rank") % n).cast("int"))).withColumn(
        "cap", F.lit(float(MOST_EPOCHS)) * F.col("source_size")
    )
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    left = F.lit(budget) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / heavy).withColumn("room", F.col("cap") / F.col("weight"))
    # Past the first source that doesn't stop, levels only fall: the largest is the true one.
    final = F.max(F.when(F.col("room") > F.col("level"), F.col("level"))).over(everyone)
    target = F.when(F.col("room") <= F.col("level"), F.col("cap")).otherwise(final * F.col("weight"))
    return level.select("source", "source_size", "rank", F.coalesce(target, F.lit(0.0)).alias("target"))


def _scaled(schedule: Sequence[float]) -> tuple[float, float, float]:
    a, b, c = schedule
    whole = (a + b) / 4 + (b + c) / 4
    return a / whole, b / whole, c / whole


def _pick(values: list[float], rank: Column) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values)).cast("int"))


def _integral(t: Column, a: Column, b: Column, c: Column) -> Column:
    """Share of a source's demand due by ``t``: rates are linear on both halves."""
    first = a * t + (b - a) * t * t
    u = t - 0.5
    second = (a + b) / 4 + b * u + (c - b) * u * u
    return F.when(t <= 0.5, first).otherwise(second)


def _inverse(share: Column, a: Column, b: Column, c: Column) -> Column:
    """The time by which ``share`` of the demand is due."""
    half = (a + b) / 4

    def root(rate: Column, slope: Column, due: Column) -> Column:
        # slope*t^2 + rate*t = due, in the form that also holds for a slope of zero
        return 2 * due / (rate + F.sqrt(F.greatest(rate * rate + 4 * slope * due, F.lit(0.0))))

    first = root(a, b - a, share)
    second = 0.5 + root(b, c - b, share - half)
    return F.least(F.greatest(F.when(share <= half, first).otherwise(second), F.lit(0.0)), F.lit(1.0))


def assign(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    budget: float = BUDGET,
    seed: str = "mix",
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken, copies, row``.

    ``size`` is the number of words; ``taken`` says how many words the mix takes of the
    document, repeats counted, at most twice its size.  ``copies`` has for each pass that
    takes something of it ``(epoch, words, time, position)``; ``row`` is a hash of all columns, by
    which rows that repeat an id find their own.  The document in which a
    target ends gives only the words that are still due, so that the words taken of a
    source differ from its target by less than one.

    A null text has size 0 and is taken nothing of; null sources are a source of their
    own, last in order.  Repeated ids are documents of their own.  Empty tables give an
    empty result.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        row_hash(docs).alias("row"),
    ).withColumn("draw", F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256))
    sized = staged(sized, "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = staged(targets(per_source, weights, budget).join(
        per_source.select(F.col("source").alias("source_"), "n_docs"),
        F.col("source").eqNullSafe(F.col("source_")),
    ).drop("source_"), "mix-targets")

    # Running sums: buckets follow the order of the draw.
    scale = F.conv(F.substring("draw", 1, 8), 16, 10).cast("double") / float(1 << 32)
    n_buckets = F.ceil(F.sqrt("n_docs"))  # as many buckets as documents in each
    known = plan.select(F.col("source").alias("source_"), "source_size", "rank", "target", n_buckets.alias("n_buckets"))
    placed = sized.join(known, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    placed = placed.withColumn("bucket", F.floor(scale * F.col("n_buckets")).cast("long"))
    per_bucket = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select(
        "rank", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start")
    )
    own = Window.partitionBy("rank", "bucket").orderBy("draw", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    located = placed.join(starts, ["rank", "bucket"]).withColumn(
        "start", F.col("bucket_start") + F.coalesce(F.sum("size").over(own), F.lit(0))
    )

    # What each pass takes, and when.
    due = F.round("target").cast("long")
    scaled = [_scaled(s) for s in schedules]
    rates = [_pick([s[i] for s in scaled], F.col("rank")) for i in range(3)]
    shapes = plan.groupBy((F.col("rank") % len(schedules)).alias("shape")).agg(F.sum("target").alias("total"))
    totals = {r["shape"]: r["total"] for r in shapes.collect()}  # one row per schedule

    def copy(epoch: int) -> Column:
        begins = F.col("start") + epoch * F.col("source_size")
        words = F.greatest(F.least(F.col("size"), due - begins), F.lit(0)).cast("long")
        time = _inverse(F.least(F.try_divide(begins, F.col("target")), F.lit(1.0)), *rates)
        return F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), time.alias("time"))

    def position(c: Column) -> Column:
        total = F.lit(0.0)
        for shape, target in sorted(totals.items()):
            total = total + target * _integral(c["time"], *[F.lit(v) for v in scaled[shape]])
        return F.struct(c["epoch"].alias("epoch"), c["words"].alias("words"), c["time"].alias("time"), total.alias("position"))

    copies = F.filter(F.array(*[copy(e) for e in range(MOST_EPOCHS)]), lambda c: c["words"] > 0)
    taken = F.aggregate(F.col("copies"), F.lit(0).cast("long"), lambda s, c: s + c["words"])
    return located.withColumn("copies", F.transform(copies, position)).select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", "row"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the documents taken, in training order, once for each pass that takes
    at least half of their words.  All columns of ``docs`` stay as they are.

    Rows are range-partitioned and sorted by training position.  Rows that repeat an id are
    told apart by their other columns, and wholly equal rows share their copies out.
    """
    passes = assign(docs, id_col, text_col, source_col, **options).select(
        F.col("doc_id").alias("id"), "row", F.filter("copies", lambda c: 2 * c["words"] >= F.col("size"))["position"].alias("due")
    )
    # A key is one row but for wholly equal ones.
    keyed = passes.groupBy("id", "row").agg(F.count(F.lit(1)).alias("alike"), F.array_sort(F.flatten(F.collect_list("due"))).alias("due"))
    keyed = keyed.filter(F.size("due") > 0)
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), row_hash(docs).alias("row")
    )
    keyed = keyed.withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit("null")))
    found = whole.join(keyed, ["id", "row"])
    mine = F.row_number().over(Window.partitionBy("id", "row").orderBy("alike")) - 1
    found = found.withColumn("mine", mine)
    own = F.filter("due", lambda _, i: i % F.col("alike") == F.col("mine"))
    ordered = found.select("whole", "id", F.explode(own).alias("position")).repartitionByRange("position", "id")
    return ordered.sortWithinPartitions("position", "id").select("whole.*")
