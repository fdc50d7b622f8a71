"""The sink of text documents."""

import json
import os

import pytest
from pyspark.sql import functions as F

from fragloom.sources import documents


def _read(path):
    return {n: open(os.path.join(path, n), encoding="utf-8").read() for n in sorted(os.listdir(path))}


def test_a_file_per_document_in_order(spark, tmp_path):
    rows = [("a/b", 2, "two"), ("a/b", 1, "one"), ("c é", 1, None), (None, 1, "x"), ("", 2, "y")]
    df = spark.createDataFrame(rows, "d string, n int, s string").repartition(3)
    path = str(tmp_path / "out")
    documents.write_sql_documents(df, path, F.col("d"), [F.col("n")], "s")
    found = _read(path)
    assert found["a%2Fb.sql"] == "one\n\ntwo\n" and found["c%20%C3%A9.sql"] == "\n" and found["%.sql"] == "x\n\ny\n" and len(found) == 3
    documents.write_sql_documents(df.filter("d = 'a/b' and n = 1"), path, F.col("d"), [F.col("n")], "s")
    assert _read(path) == {"a%2Fb.sql": "one\n"}  # replaced, and nothing of an attempt is left


def test_a_large_document_is_several_whole_ones(spark, tmp_path):
    df = spark.range(5000).select(F.lit("hot").alias("d"), F.concat(F.lit('k"'), "id").alias("k"), F.to_json(F.struct("id")).alias("j"))
    path = str(tmp_path / "out")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        documents.write_json_documents(df, path, F.col("d"), F.col("k"), "j")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = [json.loads(t) for t in _read(path).values()]
    assert len(parts) > 1 and all(n.startswith("hot+") for n in os.listdir(path))
    assert {k: v for p in parts for k, v in p.items()} == {f'k"{i}': {"id": i} for i in range(5000)}
    assert sum(map(len, parts)) == 5000


def test_no_file_grows_with_a_partition(spark, tmp_path):
    value = F.to_json(F.struct("id", F.repeat(F.lit("x"), F.lit(1 << 20)).alias("x")))
    df = spark.range(40).coalesce(1).select(F.lit("hot").alias("d"), F.format_string("k%02d", "id").alias("k"), value.alias("j"))
    path = str(tmp_path / "out")
    documents.write_json_documents(df, path, F.col("d"), F.col("k"), "j")
    assert max(os.path.getsize(os.path.join(path, n)) for n in os.listdir(path)) < 20 << 20
    parts = [json.loads(t) for t in _read(path).values()]
    assert [k for p in parts for k in p] == [f"k{i:02d}" for i in range(40)]


def test_a_failed_job_leaves_no_documents(spark, tmp_path):
    df = spark.range(100).select(F.lit("d").alias("d"), F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise("x").alias("s"))
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="lost"):
        documents.write_sql_documents(df, path, F.col("d"), [], "s")
    assert not os.path.isdir(path) or _read(path) == {}
    documents.write_sql_documents(df.limit(0), path, F.col("d"), [], "s")
    assert _read(path) == {}
