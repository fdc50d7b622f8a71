"""Resolution, merging, types and schemas."""

import pytest
from pyspark.sql import functions as F

from fragloom.functions.types import type_info
from fragloom.operators import merge, normalize, resolve, schema
from fragloom.plans import pipeline
from fragloom.plans.staging import staged

PAGE = (
    '{"id": "prod-1001", "sku": "WA-1001", "price": "9.99"}\n\n'
    "code: prod-1001\nprice: $9.99\nseen: 3\n\n"
    '{"id": "prod-1001", "price": "9.99", "stock": 5}\n\n'
    "ProductID,Stock\nprod-1001,n5\nprod-1002,n6\n\n"
    "author: Ann\nrating: 5"
)


@pytest.fixture(scope="module")
def result(spark):
    docs = spark.createDataFrame([(1, PAGE)], "doc_id long, text string")
    return pipeline.run(docs)


def test_entities(result):
    rows = {r["entity_id"]: r for r in result["merged"].collect()}
    assert rows["prod-1001"]["fragment_count"] == 4
    assert rows["prod-1001"]["n_conflicts"] == 1
    assert rows["prod-1001"]["quality_score"] == 0.8
    assert rows["prod-1002"]["quality_score"] == 0.9
    orphans = [e for e in rows if e.startswith("orphan_")]
    assert len(orphans) == 1 and len(rows) == 3


def test_first_value_wins_and_the_rest_is_listed(result):
    fields = {(r["entity_id"], r["key"]): r["value"] for r in result["merged_fields"].collect()}
    assert fields["prod-1001", "price"] == "9.99"
    assert fields["prod-1001", "row_0_Stock"] == "n5"
    assert fields["prod-1002", "row_1_Stock"] == "n6"
    listed = [
        (r["value"], r["format"])
        for r in result["conflicts"].orderBy("conflict_key", "at").collect()
    ]
    assert listed == [("9.99", "unknown"), ("$9.99", "KEY_VALUE")]


def test_schemas(result):
    heads = {r["schema_id"]: r for r in result["schemas"].collect()}
    assert heads["prod-1001"]["category"] == "products"
    assert heads["prod-1001"]["primary_key_candidates"] == ["id", "sku"]
    assert heads["prod-1001_items"]["parent_entity"] == "prod-1001"
    assert heads["prod-1002_items"]["parent_entity"] is None
    child = [
        (r["pos"], r["field"])
        for r in result["schema_fields"].filter("schema_id = 'prod-1001_items'").orderBy("pos").collect()
    ]
    assert child == [(1, "ProductID"), (2, "Stock"), (3, "prod-1001_id")]


def test_a_hot_entity_keeps_all_its_conflicts(spark):
    """A third of the corpus speaks about one entity, as with book-978."""
    text = F.when(
        F.col("id") % 3 == 0,
        F.concat(F.lit('{"id": "book-978", "pages": '), F.col("id"), F.lit("}")),
    ).otherwise(F.concat(F.lit('{"id": "prod-'), F.col("id") + 10000, F.lit('", "pages": 1}')))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), text.alias("text"))
    tagged = staged(pipeline.tagged_fragments(docs), "hot")
    groups = staged(resolve.entity_fragments(tagged, scope="corpus"), "hot-groups")
    facts = staged(merge.facts(tagged, groups), "hot-facts")
    fields = merge.merged_fields(facts)
    assert groups.filter("entity_id = 'book-978'").count() == 1000
    lost = merge.conflicts(facts, fields).filter("entity_id = 'book-978' and not is_winner")
    assert lost.count() == 999
    won = fields.filter("entity_id = 'book-978' and key = 'pages'").first()
    assert won["value"] == "0" and won["has_conflict"]


@pytest.mark.parametrize(
    "vtype, value, field, base",
    [
        ("string", "120", "stock", "string"),
        ("string", "12345", "stock", "identifier"),
        ("string", "4.50", "x", "money"),
        ("string", "9,99 EUR", "x", "money"),
        ("string", "5", "rating", "string"),
        ("string", "5", "width", "identifier"),
        ("string", "2.3%", "return_rate", "money"),
        ("string", "2025-11-01", "price", "date"),
        ("string", "a@b.de", "x", "email"),
        ("string", "http://x", "x", "url"),
        ("string", "N/A", "price", "null"),
        ("null", None, "x", "null"),
        ("boolean", "true", "x", "boolean"),
        ("integer", "7", "price", "integer"),
        ("decimal", "7.5", "price", "decimal"),
        ("object", "{}", "x", "object"),
        ("array", "[1, 2]", "x", "array"),
    ],
)
def test_types(spark, vtype, value, field, base):
    df = spark.createDataFrame([(vtype, value, field)], "vtype string, value string, field string")
    made = df.select(type_info(F.col("vtype"), F.col("value"), F.col("field")).alias("t")).first()["t"]
    assert made["base_type"] == base
    if base == "array":
        assert made["sql_type"] == "INTEGER[]"


def test_quality_scores(spark):
    df = spark.createDataFrame(
        [(1, 2, False, 1.0), (1, 1, False, 0.9), (1, 2, True, 0.8), (1, 1, True, 0.72), (0, 3, False, 0.0)],
        "n int, f int, c boolean, want double",
    )
    for r in df.withColumn("got", merge.quality_score(F.col("n"), F.col("f"), F.col("c"))).collect():
        assert r["got"] == pytest.approx(r["want"])


def test_equal_values_of_different_types(spark):
    docs = spark.createDataFrame(
        [(1, '{"id": "prod-1001", "n": 1}\n\n{"id": "prod-1001", "n": 1.0}\n\n{"id": "prod-1001", "n": "1"}')],
        "doc_id long, text string",
    )
    out = pipeline.run(docs)
    lost = out["conflicts"].filter("not is_winner").collect()
    assert [r["value"] for r in lost] == ["1"]
    assert normalize.FIELDS_DDL and schema.SCHEMA


def test_names_within_documents_take_one_shuffle(spark):
    docs = spark.createDataFrame([(1, PAGE), (2, PAGE), (2, PAGE), (None, PAGE)], "doc_id long, text string")
    tagged = staged(pipeline.tagged_fragments(docs), "tagged")
    named = resolve.named_claims(tagged)
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Join" not in plan
    rows = {(r.format, r.id, r.group_id, r.entity_id) for r in named.collect()}
    best = resolve.attach_best(resolve._claims(tagged, ("doc_id",), "document"), ["scope", "group_id"], F.struct("plainness", "doc_id", "start", resolve.format_rank(F.col("format")), "id"), "best", ["start"])
    assert rows == {(r.format, r.id, r.group_id, r.best.id) for r in best.collect()}
