"""Group look-ups that stay balanced when one group holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged

#: Keys that are looked at for being hot, and buckets a whole table's worth of rows gets per
#: shuffle partition: a key with a tenth of the rows is spread over 0.4 x the partitions.
HOT_KEYS, BUCKETS_PER_PARTITION = 256, 4


def as_large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input and must not be sent to the driver.

    Catalyst takes the size of an encoded file for that of its rows and counts no row that an
    array is exploded into, so that it would broadcast some of these.
    """
    return df.hint("merge")


def hot_buckets(facts: DataFrame, on: list[str]) -> dict[int, int]:
    """Number of buckets of each key that needs more than one, by the key's hash.

    A frequent-items sketch over the keys, one pass without a shuffle, finds at most
    ``HOT_KEYS`` of them, whatever the data.  A key that shares its hash with a hot one is
    spread like it, which changes no result.
    """
    spark = facts.sparkSession
    room = BUCKETS_PER_PARTITION * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = facts.select(F.xxhash64(*on).alias("key"))
    top = f"approx_top_k(key, {HOT_KEYS}, {64 * HOT_KEYS})"
    found = keys.agg(F.count("*").alias("n"), F.expr(top).alias("top")).first()
    shares = ((row["item"], -(-row["count"] * room // found["n"])) for row in found["top"] or ())
    return {key: int(n) for key, n in shares if n > 1}


def _bucketed(facts: DataFrame, on: list[str], spread: list[str], hot: dict[int, int]) -> DataFrame:
    """``facts`` with ``_bucket``: 0 for the keys that are not hot."""
    return facts.withColumn("_bucket", F.pmod(F.xxhash64(*spread), _buckets(on, hot)).cast("int"))


def _buckets(on: list[str], hot: dict[int, int]) -> Column:
    if not hot:
        return F.lit(1)
    known = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.xxhash64(*on)), F.lit(1))


def join_spread(
    facts: DataFrame, lookup: DataFrame, on: list[str], spread: list[str], how: str = "inner"
) -> DataFrame:
    """Join ``facts`` to ``lookup`` (one row per ``on``) with hot keys spread over buckets.

    Which keys are hot, and over how many buckets they go, is measured.  Facts of a hot key
    get a bucket from ``spread`` and its look-up row is repeated for each; all others take an
    ordinary join.
    """
    salted, repeated = dealt(facts, lookup, on, spread, hot_buckets(facts, on))
    return salted.join(repeated, [*on, "_bucket"], how).drop("_bucket")


def dealt(
    facts: DataFrame, lookup: DataFrame, on: list[str], spread: list[str], hot: dict[int, int]
) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_bucket``: facts of a hot key have one, look-up rows are repeated for each."""
    repeated = lookup.withColumn("_bucket", F.explode(F.sequence(F.lit(0), _buckets(on, hot) - 1)))
    return _bucketed(facts, on, spread, hot), repeated


def attach_best(
    facts: DataFrame, on: list[str], best: Column, name: str, spread: list[str]
) -> DataFrame:
    """Add the smallest ``best`` of each group of ``on`` to all of the group's rows.  Hot
    groups are spread as in :func:`join_spread`."""
    hot = hot_buckets(facts, on)
    salted = _bucketed(facts, on, spread, hot)
    partial = salted.groupBy(*on, "_bucket").agg(F.min(best).alias(name))
    lookup = (
        partial.groupBy(*on)
        .agg(F.min(name).alias(name), F.collect_set("_bucket").alias("_buckets"))
        .withColumn("_bucket", F.explode("_buckets"))
        .drop("_buckets")
    )
    return salted.join(as_large(lookup), [*on, "_bucket"]).drop("_bucket")


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``row_number`` within ``group`` without putting a whole group into one task.

    Rows are range-partitioned by (group, order) and written; a row's number is the
    count of its group in earlier partitions plus its place in its own partition.
    """
    placed = staged(
        df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "ranked"
    )
    counts = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_part").orderBy(*order)
    return (
        placed.join(as_large(starts), [group, "_part"])
        .withColumn(name, (F.col("_start") + F.row_number().over(inside)).cast("int"))
        .drop("_part", "_start")
    )
