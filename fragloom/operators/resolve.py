"""Entity resolution: which fragments speak about which entity.

Ids with the same digits (three or more) are one entity, named by the id with the most
other characters.  Whether a fragment belongs to an entity or is an orphan shows on its
own row; only the choice of the name needs to see a whole group, and that is one
aggregation with a spread-out join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.columns import let
from ..functions.groups import attach_best
from .mentions import FRAGMENT_KEY

_RANK = rules.PRIORITY


def format_rank(fmt: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in _RANK.items() for x in pair])
    return F.try_element_at(ranks, fmt)


def digit_core(entity: Column) -> Column:
    return F.regexp_replace(entity, "[^0-9]", "")


def group_key(entity: Column) -> Column:
    """The digits of an id where there are enough of them, else the id itself."""
    return let(
        F.struct(entity.alias("id"), digit_core(entity).alias("core")),
        lambda v: F.when(F.length(v["core"]) >= rules.MIN_CORE_DIGITS, v["core"]).otherwise(
            v["id"]
        ),
    )


def _product_ids() -> Column:
    return F.transform(
        F.filter("index_entries", lambda m: m["label"] == "product_id"), lambda m: m["entity"]
    )


def product_mentions(tagged: DataFrame, *, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Product ids per fragment together with their digits-only variants."""
    variants = lambda e: F.array(
        e, F.when(F.length(digit_core(e)) >= rules.MIN_CORE_DIGITS, digit_core(e))
    )
    ids = F.array_distinct(F.array_compact(F.flatten(F.transform(_product_ids(), variants))))
    return tagged.select(*keys, *FRAGMENT_KEY, F.explode(ids).alias("product_id"))


def _has_content() -> Column:
    return F.size("rows") > 0


def is_orphan() -> Column:
    """Content that no product id claims."""
    filled = F.exists("rows", lambda r: r["n_keys"] > 0)
    indexed = F.exists("rows", lambda r: r["row_idx"] >= 0)
    return (F.size(_product_ids()) == 0) & (filled | indexed)


def orphans(tagged: DataFrame, *, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Fragments with content that belong to no entity, each its own ``orphan_`` entity."""
    name = F.concat_ws("_", F.lit("orphan"), F.lower("format"), F.col("start"))
    return (
        tagged.filter(is_orphan())
        .select(F.concat_ws("/", *keys).alias("scope"), name.alias("entity_id"), *keys, *FRAGMENT_KEY, "start")
    )


def _claims(tagged: DataFrame, keys: tuple[str, ...], scope: str) -> DataFrame:
    """One row per fragment with content and product id group."""
    within = F.concat_ws("/", *keys) if scope == "document" else F.lit("")
    def claim(e: Column, i: Column, groups: Column) -> Column:
        return F.struct(
            F.get(groups, i).alias("group_id"),
            (-(F.length(e) - F.length(digit_core(e)))).alias("plainness"),
            e.alias("id"),
            (F.array_position(groups, F.get(groups, i)) == i + 1).alias("first_of_group"),
        )

    claims = let(
        _product_ids(),
        lambda ids: let(
            F.transform(ids, group_key),
            lambda groups: F.transform(ids, lambda e, i: claim(e, i, groups)),
        ),
    )
    return (
        tagged.filter(_has_content() & (F.size(_product_ids()) > 0))
        .select(
            within.alias("scope"), *keys, *FRAGMENT_KEY, "start", F.explode(claims).alias("claim")
        )
        .select("scope", *keys, *FRAGMENT_KEY, "start", "claim.*")
    )


def named_claims(
    tagged: DataFrame, *, keys: tuple[str, ...] = ("doc_id",), scope: str = "document"
) -> DataFrame:
    """Each product id mention with the canonical name of its group."""
    best = F.struct(
        F.col("plainness"),
        *[F.col(k) for k in keys],
        F.col("start"),
        format_rank(F.col("format")).alias("rank"),
        F.col("id"),
    )
    claims = _claims(tagged, keys, scope)
    if scope == "document":
        # A group is part of one document, which was one row: its claims meet in one shuffle.
        group = Window.partitionBy("scope", "group_id")
        named = claims.withColumn("best", F.min(best).over(group))
    else:
        named = attach_best(claims, ["scope", "group_id"], best, "best", [*keys, "start"])
    return named.withColumn("entity_id", F.col("best.id")).drop("best", "plainness")


def entity_aliases(
    tagged: DataFrame, *, keys: tuple[str, ...] = ("doc_id",), scope: str = "document"
) -> DataFrame:
    """Every id that goes by another entity's name, digits-only variants included."""
    named = named_claims(tagged, keys=keys, scope=scope)
    core = digit_core(F.col("id"))
    variants = F.array_compact(
        F.array(F.col("id"), F.when(F.length(core) >= rules.MIN_CORE_DIGITS, core))
    )
    return (
        named.select("scope", F.explode(variants).alias("id"), "entity_id")
        .filter(F.col("id") != F.col("entity_id"))
        .distinct()
    )


def entity_fragments(
    tagged: DataFrame, *, keys: tuple[str, ...] = ("doc_id",), scope: str = "document"
) -> DataFrame:
    """(scope, entity, fragment), each fragment once per entity, orphans included.

    ``scope`` is "document" (ids mean something within one document) or "corpus".
    """
    claimed = named_claims(tagged, keys=keys, scope=scope)
    # Ids of one group inside one fragment all carry the same name: keep the first of them.
    columns = ["scope", "entity_id", *keys, *FRAGMENT_KEY, "start"]
    one_per_entity = claimed.filter("first_of_group").select(*columns)
    return one_per_entity.unionByName(orphans(tagged, keys=keys).select(*columns))
