"""Connected components by alternating stars, with written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def _nearest(links: DataFrame) -> DataFrame:
    """Each link ``u, v`` with the least of u and u's partners.  Partners of one node are
    not gathered: the minimum is pre-aggregated and joined back, and a node with very
    many links is an ordinary skewed join."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` links; root is the least node reachable."""
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = staged(pairs, "links")
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _nearest(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        pairs = staged(small.filter("u <> v").distinct(), "links")
        state = pairs.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before or not state[0]:
            break
        before = state
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )
