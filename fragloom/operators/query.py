"""Queries over the produced tables, and audits of query logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.groups import join_spread


def below(df: DataFrame, field: str, limit: float) -> DataFrame:
    return df.filter(F.col(field).try_cast("double") < limit)


def above(df: DataFrame, field: str, limit: float) -> DataFrame:
    return df.filter(F.col(field).try_cast("double") > limit)


def ordered(df: DataFrame, field: str, *ties: str) -> DataFrame:
    """Largest first; values that are no numbers come last."""
    return df.orderBy(F.col(field).try_cast("double").desc_nulls_last(), *ties)


def count_above(df: DataFrame, field: str, limit: float) -> DataFrame:
    return above(df, field, limit).agg(F.count("*").alias("n"))


def containing(df: DataFrame, field: str, text: str) -> DataFrame:
    return df.filter(F.contains(F.col(field), F.lit(text)))


def preview(df: DataFrame, order: list, n: int = 5) -> DataFrame:
    """The first ``n`` rows in a given order."""
    return df.orderBy(*order).limit(n)


def unknown_columns(
    queries: DataFrame,
    schema_fields: DataFrame,
    *,
    keys: list[str],
    known_names: list[str] | None = None,
) -> DataFrame:
    """Queries that name columns their schema lacks, with the first three such names.

    ``queries(keys, entity_type, query)``, ``schema_fields(entity_type, field)``; names in
    ``known_names`` (tables, functions) are never unknown.  A schema's field names are
    listed once per type and looked up per query.
    """
    listed = schema_fields.groupBy("entity_type").agg(F.collect_set("field").alias("fields"))
    joined = join_spread(queries.select(*keys, "entity_type", "query"), listed, ["entity_type"], keys, "left")
    fields = F.coalesce("fields", F.array().cast("array<string>"))
    words = F.regexp_extract_all("query", F.lit(rules.QUERY_IDENTIFIER), F.lit(1))
    known = F.array(*[F.lit(n) for n in known_names or [""]])
    missing = F.filter(
        words,
        lambda w: ~F.upper(w).isin(rules.SQL_WORDS)
        & ~F.array_contains(F.col("known_fields"), w)
        & ~F.array_contains(known, w),
    )
    found = joined.withColumn("known_fields", fields).withColumn("names", F.array_distinct(missing))
    return found.filter(F.size("names") > 0).select(
        *keys,
        F.concat(F.lit("Unknown columns: "), F.array_join("names", ", ")).alias("error"),
    )


def dangerous_word(query: Column) -> Column:
    """The first word of a statement that would change a table, or null."""
    upper = F.upper(query)
    chain = F
    for word in rules.DANGEROUS_WORDS:
        chain = chain.when(
            F.contains(upper, F.lit(word)) & F.contains(upper, F.lit("TABLE")), F.lit(word)
        )
    return chain.otherwise(F.lit(None).cast("string"))


def dangerous_queries(queries: DataFrame, *, keys: list[str]) -> DataFrame:
    found = queries.select(*keys, dangerous_word(F.col("query")).alias("word"))
    return found.filter(F.col("word").isNotNull()).select(
        *keys, F.concat(F.lit("Dangerous operation detected: "), F.col("word")).alias("error")
    )


def document_query_errors(queries: DataFrame, *, keys: list[str]) -> DataFrame:
    """Document-store queries (JSON in ``query``) with what is wrong with each, or null."""
    spec = F.from_json("query", "map<string,string>")
    operation = F.try_element_at(F.col("spec"), F.lit("operation"))
    has = lambda name: F.array_contains(F.map_keys("spec"), name)
    error = (
        F.when(F.col("spec").isNull(), F.lit("Not a JSON object"))
        .when(~has("collection"), F.lit("Missing required field: collection"))
        .when(~has("operation"), F.lit("Missing required field: operation"))
        .when(
            ~F.coalesce(operation.isin(rules.DOCUMENT_STORE_OPERATIONS), F.lit(False)),
            F.concat(F.lit("Invalid operation: "), F.coalesce(operation, F.lit("None"))),
        )
    )
    return queries.withColumn("spec", spec).select(*keys, error.alias("error"))


def route(text: Column, default: Column) -> Column:
    """Entity type whose keywords occur most often in a text; the first one on a tie."""
    lower = F.lower(text)
    scores = []
    for place, (name, words) in enumerate(rules.ROUTING_WORDS):
        hits = sum((F.contains(lower, F.lit(w)).cast("int") for w in words), F.lit(0))
        scores.append(F.struct(hits.alias("hits"), F.lit(-place).alias("place"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scores))
    return F.when(best["hits"] > 0, best["name"]).otherwise(default)


def field_catalogue(schema_fields: DataFrame, schemas: DataFrame, *, db: str = "postgresql") -> DataFrame:
    """Fields as shown to someone writing a query: type, nullability, an example."""
    kind = F.col("type_info.sql_type") if db == "postgresql" else F.col("type_info.mongo_type")
    example = F.when(F.col("example_value") != "", F.col("example_value"))
    head = schemas.select(
        "scope",
        "schema_id",
        F.col("is_normalized_table").alias("is_child"),
        F.concat(F.lower("category"), F.lit("s")).alias("table_name"),
        "primary_key_candidates",
        "suggested_indexes",
    )
    return schema_fields.join(head, ["scope", "schema_id", "is_child"]).select(
        "scope",
        "schema_id",
        "table_name",
        "pos",
        F.col("field").alias("name"),
        kind.alias("type"),
        F.col("type_info.nullable").alias("nullable"),
        example.alias("example"),
        F.array_contains("primary_key_candidates", F.col("field")).alias("is_primary_key"),
        F.array_contains("suggested_indexes", F.col("field")).alias("is_indexed"),
    )


