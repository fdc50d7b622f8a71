"""Schemas inferred from merged entities, and their export as DDL and validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.columns import bind, cached, contains_any
from ..functions.groups import as_large
from ..functions.types import null_info, type_info, varchar
from .merge import ENTITY

SCHEMA = ["scope", "schema_id"]
ROW_KEY = r"^row_([^_]*)_([\s\S]*)$"


def infer(df: DataFrame, field: str = "field") -> DataFrame:
    """Add ``type_info`` for columns ``vtype``, ``value`` and the field name."""
    made = cached(
        f"type_info.{field}", lambda: type_info(F.col("vtype"), F.col("value"), F.col(field))
    )
    return bind(df, type_info=made)


def consensus(values: DataFrame, by: list[str], field: str = "field", at: str = "at") -> DataFrame:
    """Agreed type of each field over many values (``vtype``, ``value``, order ``at``).

    The most frequent type wins, the first seen on a tie; its first value is the
    template.  Both steps aggregate before they shuffle.
    """
    keys = [*by, field]
    numeric = F.col("vtype").isin("boolean", "integer", "decimal")
    per_type = (
        infer(values, field)
        .groupBy(*keys, F.col("type_info.base_type").alias("base_type"))
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct(F.col(at).alias("at"), "type_info")).alias("template"),
            F.min(F.when(numeric, F.col("value").try_cast("double"))).alias("low"),
            F.max(F.when(numeric, F.col("value").try_cast("double"))).alias("high"),
            F.max(F.when(F.col("vtype") == "string", F.length("value"))).alias("longest"),
            F.min(F.struct(F.col(at).alias("at"), F.col("value"))).alias("example"),
        )
    )
    known = F.col("base_type") != "null"
    # Larger counts first, then earlier templates: the minimum of (-n, template).
    agreed = per_type.groupBy(*keys).agg(
        F.min(F.when(known, F.struct((-F.col("n")).alias("minus_n"), "template"))).alias("best"),
        F.sum(F.when(known, F.col("n"))).alias("n_known"),
        F.sum("n").alias("n_all"),
        F.count(F.when(known, True)).alias("n_types"),
        F.min(F.when(known, F.col("low"))).alias("low"),
        F.max(F.when(known, F.col("high"))).alias("high"),
        F.max(F.when(known, F.col("longest"))).alias("longest"),
        F.min("example").alias("example"),
        F.min("template.at").alias("first_at"),
    )
    t = F.col("best.template.type_info")
    is_number = t["base_type"].isin("integer", "decimal")
    sized = t["base_type"] == "string"
    resized = F.when(
        sized & F.startswith(t["sql_type"], F.lit("VARCHAR")),
        varchar(F.greatest(F.lit(255), F.col("longest") * 2)),
    ).otherwise(t["sql_type"])
    info = F.when(F.col("best").isNull(), null_info()).otherwise(
        F.struct(
            t["base_type"].alias("base_type"),
            resized.alias("sql_type"),
            t["mongo_type"].alias("mongo_type"),
            (F.col("n_known") < F.col("n_all")).alias("nullable"),
            (t["confidence"] * (-F.col("best.minus_n") / F.col("n_known"))).alias("confidence"),
            F.when(is_number, F.col("low")).otherwise(t["min"]).alias("min"),
            F.when(is_number, F.col("high")).otherwise(t["max"]).alias("max"),
            F.when(sized, F.col("longest")).otherwise(t["max_length"]).cast("int").alias("max_length"),
            t["format"].alias("format"),
            t["currency_hint"].alias("currency_hint"),
            t["indexed"].alias("indexed"),
            t["element_type"].alias("element_type"),
        )
    )
    return agreed.select(
        *keys,
        info.alias("type_info"),
        (F.col("n_types") > 1).alias("type_conflicts"),
        F.col("example.value").alias("example_value"),
        F.col("first_at"),
    )


def is_row_key(key: Column) -> Column:
    return key.rlike(ROW_KEY)


def split_row_keys(merged_fields: DataFrame) -> DataFrame:
    """Add ``row_num`` and ``field``: ``row_3_price`` is field ``price`` of row 3."""
    in_row = is_row_key(F.col("key"))
    return merged_fields.withColumns(
        {
            "row_num": F.when(in_row, F.regexp_extract("key", ROW_KEY, 1)),
            "field": F.when(in_row, F.regexp_extract("key", ROW_KEY, 2)).otherwise(F.col("key")),
        }
    )


def child_rows(merged_fields: DataFrame) -> DataFrame:
    """Data side of the child tables: one row per entity and table row, cells as a map.

    ``row_num`` is the row's index in its table; ``row_of`` names the table over a corpus.
    """
    cells = split_row_keys(merged_fields).filter(F.col("row_num").isNotNull())
    return cells.groupBy(
        *ENTITY,
        F.regexp_extract("row_num", "^(?:(.*):)?", 1).alias("row_of"),
        F.element_at(F.split("row_num", ":"), -1).cast("int").alias("row_num"),
    ).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def is_key_candidate(field: Column, has_conflict: Column, base_type: Column) -> Column:
    return (
        contains_any(F.lower(field), rules.KEY_FIELD_WORDS)
        & ~has_conflict
        & base_type.isin("identifier", "string", "integer")
    )


def is_orphan_id(entity_id: Column) -> Column:
    return F.startswith(entity_id, F.lit("orphan_"))


def _main_fields(split: DataFrame) -> DataFrame:
    fields = infer(
        split.filter(F.col("row_num").isNull() & ~F.endswith("key", F.lit("_conflict")))
    )
    name = F.lower("field")
    return fields.select(
        *ENTITY,
        F.col("entity_id").alias("schema_id"),
        F.lit(False).alias("is_child"),
        "field",
        "type_info",
        F.lit(False).alias("type_conflicts"),
        "has_conflict",
        F.col("value").alias("example_value"),
        is_key_candidate(F.col("field"), F.col("has_conflict"), F.col("type_info.base_type")).alias("is_key"),
        (F.col("type_info.indexed") | contains_any(name, rules.INDEX_FIELD_WORDS)).alias("is_index"),
        F.col("at").alias("first_at"),
    )


def _child_id() -> Column:
    return F.when(is_orphan_id(F.col("entity_id")), F.col("entity_id")).otherwise(
        F.concat("entity_id", F.lit("_items"))
    )


def _child_fields(split: DataFrame) -> DataFrame:
    typed = consensus(split.filter(F.col("row_num").isNotNull()), ENTITY)
    return typed.select(
        *ENTITY,
        _child_id().alias("schema_id"),
        F.lit(True).alias("is_child"),
        "field",
        "type_info",
        "type_conflicts",
        F.lit(False).alias("has_conflict"),
        "example_value",
        F.lit(False).alias("is_key"),
        contains_any(F.lower("field"), rules.CHILD_INDEX_FIELD_WORDS).alias("is_index"),
        "first_at",
    )


def _foreign_key() -> Column:
    """``<entity>_id``, the last field of the child table of a parent with a key candidate."""
    info = F.struct(
        F.lit("identifier").alias("base_type"),
        F.lit("VARCHAR(50)").alias("sql_type"),
        F.lit("String").alias("mongo_type"),
        F.lit(False).alias("nullable"),
        F.lit(1.0).alias("confidence"),
        F.lit(None).cast("double").alias("min"),
        F.lit(None).cast("double").alias("max"),
        F.lit(None).cast("int").alias("max_length"),
        F.lit(None).cast("string").alias("format"),
        F.lit(None).cast("string").alias("currency_hint"),
        F.lit(True).alias("indexed"),
        F.lit(None).cast("string").alias("element_type"),
    )
    return F.struct(
        F.concat("entity_id", F.lit("_id")).alias("field"),
        info.alias("type_info"),
        F.lit(False).alias("type_conflicts"),
        F.lit(False).alias("has_conflict"),
        F.col("entity_id").alias("example_value"),
        F.lit(True).alias("is_key"),
        F.lit(True).alias("is_index"),
        (F.col("pos") + 1).alias("pos"),
    )


_OWN = ["field", "type_info", "type_conflicts", "has_conflict", "example_value", "is_key", "is_index", "pos"]


def schema_fields(merged_fields: DataFrame) -> DataFrame:
    """One row per schema and field, with ``pos`` in order of first sight.

    Expanded table rows go to a child schema of their own; everything else is the
    entity's main schema.  All windows share one partitioning by entity.
    """
    split = split_row_keys(merged_fields)
    every = _main_fields(split).unionByName(_child_fields(split))
    entity = Window.partitionBy(*ENTITY)
    placed = Window.partitionBy(*ENTITY, "is_child").orderBy("first_at", "field")
    whole = Window.partitionBy(*ENTITY, "is_child")
    every = every.withColumns(
        {
            "_keyed": F.max(F.col("is_key") & ~F.col("is_child")).over(entity),
            "pos": F.row_number().over(placed),
            "_size": F.count("*").over(whole),
        }
    )
    linked = F.col("is_child") & F.col("_keyed") & (F.col("pos") == F.col("_size"))
    rows = F.array_compact(F.array(F.struct(*_OWN), F.when(linked, _foreign_key())))
    return every.select(*ENTITY, "schema_id", "is_child", F.inline(rows))


def category(entity_id: Column, names: Column) -> Column:
    """Category of an entity by the exact names of its fields; the first rule that fits."""
    chain = F.when(F.startswith(F.lower(entity_id), F.lit("orphan")), F.lit("orphan"))
    for name, words in rules.CATEGORY_FIELDS:
        chain = chain.when(
            F.arrays_overlap(names, F.array(*[F.lit(w) for w in words])), F.lit(name)
        )
    return chain.otherwise(F.lit(rules.DEFAULT_CATEGORY))


def _ordered(condition: Column) -> Column:
    found = F.array_sort(F.collect_list(F.when(condition, F.struct("pos", "field"))))
    return F.transform(found, lambda x: x["field"])


def schemas(schema_fields: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """One row per schema.  ``merged`` supplies whether the entity has conflicts at all."""
    grouped = schema_fields.groupBy(*ENTITY, "schema_id", "is_child").agg(
        F.count("*").alias("field_count"),
        F.collect_set("field").alias("names"),
        _ordered(F.col("is_key")).alias("primary_key_candidates"),
        _ordered(F.col("is_index")).alias("suggested_indexes"),
        F.bool_or("has_conflict").alias("has_conflicts"),
    )
    parents = (
        schema_fields.filter(~F.col("is_child")).select(*ENTITY).distinct()
        .withColumn("has_parent", F.lit(True))
    )
    grouped = grouped.join(as_large(parents), ENTITY, "left")
    if merged is not None:
        totals = merged.select(*ENTITY, (F.col("n_conflicts") > 0).alias("disputed"))
        grouped = grouped.join(as_large(totals), ENTITY, "left").withColumn(
            "has_conflicts", ~F.col("is_child") & F.coalesce("disputed", F.lit(False))
        )
    return grouped.select(
        "scope",
        "entity_id",
        "schema_id",
        category(F.col("entity_id"), F.col("names")).alias("category"),
        F.col("field_count").cast("int").alias("field_count"),
        "primary_key_candidates",
        "suggested_indexes",
        "has_conflicts",
        F.col("is_child").alias("is_normalized_table"),
        F.when(F.col("is_child") & F.col("has_parent"), F.col("entity_id")).alias("parent_entity"),
        F.current_timestamp().alias("generated_at"),
    )


def sql_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_")


def postgresql(schema_fields: DataFrame, schemas: DataFrame) -> DataFrame:
    """CREATE TABLE and CREATE INDEX text per schema."""
    column = F.concat_ws(
        " ",
        F.concat(F.lit("    "), sql_name(F.col("field"))),
        F.col("type_info.sql_type"),
        F.when(F.col("type_info.nullable"), F.lit("NULL")).otherwise(F.lit("NOT NULL")),
    )
    columns = schema_fields.groupBy(*SCHEMA, F.col("is_child").alias("is_normalized_table")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", column.alias("line")))), lambda x: x["line"]
        ).alias("columns")
    )
    keys, table = F.col("primary_key_candidates"), sql_name(F.col("schema_id"))
    head = F.array_compact(
        F.array(
            F.concat(F.lit("-- Schema for entity: "), F.col("schema_id")),
            F.when(F.col("is_normalized_table"), F.lit("-- Normalized table from CSV/tabular data")),
            F.concat(F.lit("-- Parent entity: "), F.col("parent_entity")),
            F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), table, F.lit(" (")),
        )
    )
    key_line = F.when(
        F.size(keys) > 0,
        F.array(F.concat(F.lit("    PRIMARY KEY ("), sql_name(F.get(keys, F.lit(0))), F.lit(")"))),
    ).otherwise(F.array().cast("array<string>"))
    indexes = F.transform(
        F.array_except("suggested_indexes", keys),
        lambda f: F.concat(
            F.lit("\nCREATE INDEX IF NOT EXISTS idx_"),
            F.col("table"), F.lit("_"), sql_name(f), F.lit(" ON "), F.col("table"),
            F.lit("("), sql_name(f), F.lit(");"),
        ),
    )
    joined = schemas.join(as_large(columns), [*SCHEMA, "is_normalized_table"]).withColumn("table", table)
    body = F.concat_ws(",\n", F.concat("columns", key_line))
    return joined.select(
        *SCHEMA,
        "category",
        F.concat_ws("\n", F.concat(head, F.array(body, F.lit(");")), indexes)).alias("ddl"),
    )


def document_validators(schema_fields: DataFrame, schemas: DataFrame) -> DataFrame:
    """Document-store validator (JSON Schema with bsonType) per schema."""
    bson = F.create_map(*[F.lit(x) for pair in rules.BSON_TYPES.items() for x in pair])
    info = F.col("type_info")
    prop = F.struct(
        F.coalesce(F.try_element_at(bson, info["mongo_type"]), F.lit("string")).alias("bsonType"),
        F.concat(F.lit("Field: "), F.col("field")).alias("description"),
        (info["max_length"] * 2).alias("maxLength"),
        info["min"].alias("minimum"),
        info["max"].alias("maximum"),
    )
    fields = schema_fields.groupBy(*SCHEMA, F.col("is_child").alias("is_normalized_table")).agg(
        F.array_sort(
            F.collect_list(
                F.struct("pos", "field", prop.alias("prop"), info["nullable"].alias("nullable"))
            )
        ).alias("fields")
    )
    validator = F.struct(
        F.col("schema_id").alias("title"),
        F.lit("object").alias("bsonType"),
        F.transform(
            F.filter("fields", lambda f: ~f["nullable"]), lambda f: f["field"]
        ).alias("required"),
        F.map_from_entries(
            F.transform("fields", lambda f: F.struct(f["field"].alias("key"), f["prop"].alias("value")))
        ).alias("properties"),
    )
    return schemas.join(as_large(fields), [*SCHEMA, "is_normalized_table"]).select(
        *SCHEMA, "category", F.to_json(validator).alias("validator")
    )
