"""Merging: one set of fields per entity out of all its fragments.

Everything is long form, one row per (entity, key, fragment).  Winners come from
aggregates that combine before the shuffle, so an entity that owns a large share of the
corpus costs no more than its distinct keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.columns import bind, trim_ws
from ..functions.groups import as_large, join_spread
from .mentions import FRAGMENT_KEY
from .normalize import clean_object
from .resolve import format_rank

ENTITY = ["scope", "entity_id"]


def usable() -> Column:
    """Damaged JSON merges only as an object of two keys or more."""
    return (F.col("format") != "MALFORMED_JSON") | clean_object(F.col("rows"))


def _folded(value: Column) -> Column:
    return F.lower(trim_ws(F.coalesce(value, F.lit("none"))))


def row_matches(fields: Column, entity_id: Column, match: str = "substring") -> Column:
    """Whether a table row speaks about an entity; orphans own all their rows."""
    wanted = F.lower(trim_ws(entity_id))

    def fits(f: Column) -> Column:
        cell = _folded(f["value"])
        if match == "exact":
            return cell == wanted
        return F.contains(cell, wanted) | F.contains(wanted, cell)

    return F.startswith(entity_id, F.lit("orphan_")) | F.exists(fields, fits)


def is_header_row(row_idx: Column, fields: Column) -> Column:
    """Row 0 that repeats a column name as a value."""
    return (row_idx == 0) & F.exists(
        fields, lambda f: _folded(f["value"]) == F.lower(trim_ws(f["key"]))
    )


def _comparable(vtype: Column, value: Column) -> Column:
    """Equal exactly when two values count as equal: numbers and booleans by size."""
    number = F.when(vtype == "boolean", F.when(value == "true", F.lit(1.0)).otherwise(F.lit(0.0)))
    number = number.otherwise(value.try_cast("double"))
    return (
        F.when(vtype == "null", F.lit("n"))
        .when(vtype.isin("boolean", "integer", "decimal"), F.concat(F.lit("#"), number))
        .otherwise(F.concat(F.lit("s"), value))
    )


def facts(
    parsed: DataFrame,
    entity_fragments: DataFrame,
    *,
    keys: tuple[str, ...] = ("doc_id",),
    match: str = "substring",
    exclusions: DataFrame | None = None,
    scope: str = "document",
) -> DataFrame:
    """One row per entity, key and fragment: everything that is known, before merging.

    A table cell's key is ``row_<row>_<column>``.  In one document the row is its index, so
    that a later table overwrites an earlier one; over a corpus it names the fragment too,
    so that no document's rows replace another's.
    ``exclusions`` (``keys`` and ``start``) names fragments that must not be merged.
    """
    source = parsed.filter(F.col("rows").isNotNull() & usable()).select(
        *keys, *FRAGMENT_KEY, "start", "rows"
    )
    if exclusions is not None:
        source = source.join(exclusions.select(*keys, "start"), [*keys, "start"], "left_anti")
    wanted = entity_fragments.select(*ENTITY, *keys, *FRAGMENT_KEY)
    joined = source.join(as_large(wanted), [*keys, *FRAGMENT_KEY])
    exploded = joined.select(
        *ENTITY, *keys, *FRAGMENT_KEY, "start", F.explode("rows").alias("r")
    ).filter(
        (F.coalesce(F.col("r.row_idx"), F.lit(-1)) < 0)
        | (
            row_matches(F.col("r.fields"), F.col("entity_id"), match)
            & ~is_header_row(F.col("r.row_idx"), F.col("r.fields"))
        )
    )
    fields = exploded.select(
        *ENTITY,
        *keys,
        *FRAGMENT_KEY,
        "start",
        F.col("r.row_idx").alias("row_idx"),
        F.posexplode("r.fields").alias("pos", "f"),
    )
    in_table = F.col("row_idx") >= 0
    row = F.col("row_idx").cast("string")
    if scope == "corpus":
        row = F.concat(F.lower(F.hex(F.xxhash64(*keys, "frag_id", "format"))), F.lit(":"), row)
    key = F.when(in_table, F.concat(F.lit("row_"), row, F.lit("_"), F.col("f.key"))).otherwise(F.col("f.key"))
    return fields.select(
        *ENTITY,
        key.alias("key"),
        F.col("f.vtype").alias("vtype"),
        F.col("f.value").alias("value"),
        _comparable(F.col("f.vtype"), F.col("f.value")).alias("same_as"),
        # Table cells and bare values are overwritten by later fragments, keys are not.
        F.col("row_idx").isNotNull().alias("overwrites"),
        F.struct(
            *[F.col(k) for k in keys],
            F.col("start"),
            format_rank(F.col("format")).alias("rank"),
            F.coalesce(F.col("row_idx"), F.lit(-1)).alias("row_idx"),
            F.col("pos"),
        ).alias("at"),
        *keys,
        *FRAGMENT_KEY,
    )


def merged_fields(facts: DataFrame) -> DataFrame:
    """One row per entity and key: value, lineage and whether sources disagree."""
    payload = F.struct("at", "vtype", "value", "frag_id", "format", "same_as")
    grouped = facts.groupBy(*ENTITY, "key").agg(
        F.min(payload).alias("first"),
        F.max(payload).alias("last"),
        F.bool_or("overwrites").alias("overwrites"),
        F.min("same_as").alias("low"),
        F.max("same_as").alias("high"),
    )
    chosen = F.when(F.col("overwrites"), F.col("last")).otherwise(F.col("first"))
    return bind(grouped, w=chosen).select(
        *ENTITY,
        "key",
        F.col("w.vtype").alias("vtype"),
        F.col("w.value").alias("value"),
        F.col("w.frag_id").alias("source"),
        F.col("w.format").alias("source_format"),
        F.col("w.same_as").alias("same_as"),
        (~F.col("overwrites") & (F.col("low") != F.col("high"))).alias("has_conflict"),
        F.col("first.at").alias("at"),
    )


def conflicts(facts: DataFrame, merged: DataFrame, *, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every value that lost against a different one, after the value that won.

    The winner carries the format ``unknown`` and sequence position ``is_winner``.
    """
    disputed = merged.filter("has_conflict")
    won = disputed.select(
        *ENTITY,
        F.concat("key", F.lit("_conflict")).alias("conflict_key"),
        "value",
        "source",
        F.lit("unknown").alias("format"),
        F.lit(True).alias("is_winner"),
        "at",
    )
    lost = join_spread(
        facts.filter(~F.col("overwrites")),
        as_large(disputed.select(*ENTITY, "key", F.col("same_as").alias("winning"))),
        [*ENTITY, "key"],
        [*keys, "frag_id"],
    ).filter(F.col("same_as") != F.col("winning"))
    return won.unionByName(
        lost.select(
            *ENTITY,
            F.concat("key", F.lit("_conflict")).alias("conflict_key"),
            "value",
            F.col("frag_id").alias("source"),
            "format",
            F.lit(False).alias("is_winner"),
            "at",
        )
    )


def quality_score(n_fields: Column, n_fragments: Column, disputed: Column) -> Column:
    score = F.when(disputed, F.lit(0.8)).otherwise(F.lit(1.0)) * F.when(
        n_fragments < 2, F.lit(0.9)
    ).otherwise(F.lit(1.0))
    return F.when(n_fields == 0, F.lit(0.0)).otherwise(score)


def completeness(n_fields: Column) -> Column:
    return n_fields / F.greatest(F.lit(20), n_fields)


def merged(merged_fields: DataFrame, entity_fragments: DataFrame) -> DataFrame:
    """One row per entity: counts, quality score, completeness; empty ones included."""
    sizes = entity_fragments.groupBy(*ENTITY).agg(F.count("*").alias("fragment_count"))
    fields = merged_fields.groupBy(*ENTITY).agg(
        F.count("*").alias("n_fields"), F.sum(F.col("has_conflict").cast("int")).alias("n_conflicts")
    )
    n = F.coalesce(F.col("n_fields"), F.lit(0))
    k = F.coalesce(F.col("n_conflicts"), F.lit(0))
    return sizes.join(as_large(fields), ENTITY, "left").select(
        *ENTITY,
        "fragment_count",
        n.alias("n_fields"),
        k.alias("n_conflicts"),
        quality_score(n, F.col("fragment_count"), k > 0).alias("quality_score"),
        completeness(n).alias("completeness"),
        (n == 0).alias("is_empty"),
    )
