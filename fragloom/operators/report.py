"""Reports over fragments, mentions, merged entities and schema versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.groups import as_large
from .merge import ENTITY


def format_counts(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("format").agg(F.count("*").alias("n"))


def repeated_entities(index: DataFrame, *, within: list[str] | None = None) -> DataFrame:
    """Entities mentioned in two places or more, with their labels and sources."""
    within = within or []
    return (
        index.groupBy(*within, "entity")
        .agg(
            F.count("*").alias("n"),
            F.array_sort(F.collect_set("label")).alias("labels"),
            F.array_sort(F.collect_set("source")).alias("sources"),
        )
        .filter(F.col("n") >= 2)
        .orderBy(*within, "entity")
    )


def totals(fragments: DataFrame, index: DataFrame) -> DataFrame:
    """Fragments, distinct entities and entities in two places or more."""
    none = F.lit(0).cast("bigint")
    per_entity = index.groupBy("entity").agg(F.count("*").alias("n"))
    entities = per_entity.agg(
        none.alias("n_fragments"),
        F.count("*").alias("n_entities"),
        F.coalesce(F.sum((F.col("n") >= 2).cast("bigint")), none).alias("n_repeated"),
    )
    counted = fragments.agg(
        F.count("*").alias("n_fragments"), none.alias("n_entities"), none.alias("n_repeated")
    )
    names = ["n_fragments", "n_entities", "n_repeated"]
    return counted.unionByName(entities).agg(*[F.sum(n).alias(n) for n in names])


def label_counts(mentions: DataFrame) -> DataFrame:
    """Mentions per label, most common first."""
    return (
        mentions.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")
    )


def first_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group in a given order."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= n)


def conflict_listing(conflicts: DataFrame) -> DataFrame:
    return conflicts.select(*ENTITY, "conflict_key", "value", "source", "format")


def evolution_summary(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """Per type: versions, changes, breaking changes and whether there is any."""
    counted = changes.groupBy("entity_type").agg(
        F.count("*").alias("n_changes"),
        F.sum(F.col("breaking").cast("int")).alias("n_breaking"),
    )
    return (
        versions.groupBy("entity_type")
        .agg(F.count("*").alias("n_versions"))
        .join(as_large(counted), "entity_type", "left")
        .select(
            "entity_type",
            "n_versions",
            F.coalesce("n_changes", F.lit(0)).alias("n_changes"),
            F.coalesce("n_breaking", F.lit(0)).alias("n_breaking"),
            (F.coalesce("n_breaking", F.lit(0)) > 0).alias("any_breaking"),
        )
    )
