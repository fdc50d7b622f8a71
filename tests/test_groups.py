"""Look-ups of hot keys."""

from collections import Counter

from pyspark.sql import functions as F

from fragloom.functions import groups


def facts(spark):
    """Half of all rows are of one entity, a few are of the null one."""
    key = F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 999 != 0, F.concat(F.lit("e"), F.col("id") % 500))
    return spark.range(20_000).select("id", key.alias("entity"))


def test_hot_keys_are_measured(spark):
    hot = groups.hot_buckets(facts(spark), ["entity"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert list(hot.values()) == [groups.BUCKETS_PER_PARTITION * parts // 2]
    assert groups.hot_buckets(facts(spark).limit(0), ["entity"]) == {}
    assert groups.hot_buckets(spark.range(9999).select(F.col("id").alias("entity")), ["entity"]) == {}


def test_no_task_has_much_more_than_another(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        hot = groups.hot_buckets(facts(spark), ["entity"])
        rows = groups._bucketed(facts(spark), ["entity"], ["id"], hot).repartition(32, "entity", "_bucket")
        sizes = sorted(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sizes[-1] <= 4 * sizes[len(sizes) // 2]


def test_spread_joins_are_plain_joins(spark):
    df = facts(spark)
    lookup = df.select("entity").distinct().filter("entity <> 'e7'").withColumn("more", F.length("entity"))
    for how in ("inner", "left"):
        got = groups.join_spread(df, lookup, ["entity"], ["id"], how)
        want = df.join(lookup, "entity", how)
        assert Counter(map(tuple, got.select("id", "entity", "more").collect())) == Counter(map(tuple, want.select("id", "entity", "more").collect()))


def test_best_of_a_hot_group(spark):
    got = groups.attach_best(facts(spark).filter("entity IS NOT NULL"), ["entity"], F.col("id"), "least", ["id"])
    rows = got.collect()
    assert len(rows) == facts(spark).filter("entity IS NOT NULL").count()
    assert {r.least for r in rows if r.entity == "hot"} == {0} and {r.least for r in rows if r.entity == "e7"} == {7}
