"""Readers: whole documents, a landing folder, the schema registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..operators.evolve import VERSIONS_DDL, latest_versions


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: ``doc_id, path, text``."""
    df = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return df.select(F.xxhash64("path").alias("doc_id"), "path", F.col("value").alias("text"))


def landed(
    files: DataFrame, source_id: str | None = None, version: str | None = None, max_bytes: int | None = rules.MAX_FILE_BYTES
) -> DataFrame:
    """Files of a landing folder with their provenance; works on streams as well.

    Every file that Spark reads is there, which empty ones are not.  ``status`` is ``accepted``, or ``rejected`` with the ``reason``: too
    large (without ``max_bytes`` no size is refused) or no UTF-8.  The content of files that
    are too large is not read, and null.
    """
    broken = F.when(~F.is_valid_utf8(F.col("content").cast("string")), F.lit("not UTF-8"))
    if max_bytes is None:
        return _landed(files, broken, source_id, version)
    # A filter on the length reaches the scan, which then opens no other files.
    fitting = _landed(files.filter(F.col("length") <= max_bytes), broken, source_id, version)
    large = files.filter(F.col("length") > max_bytes).withColumn("content", F.lit(None).cast("binary"))
    return fitting.unionByName(_landed(large, F.lit(f"larger than {max_bytes} bytes"), source_id, version))


def _landed(files: DataFrame, reason: Column, source_id: str | None, version: str | None) -> DataFrame:
    return files.select(
        F.xxhash64("path").alias("doc_id"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("size"),
        "path",
        F.lit(source_id).cast("string").alias("source_id"),
        F.lit(version).cast("string").alias("version"),
        F.col("modificationTime").alias("uploaded_at"),
        F.when(reason.isNotNull(), F.lit("rejected")).otherwise(F.lit("accepted")).alias("status"),
        reason.alias("reason"),
        "content",
    )


def read_landing(
    spark: SparkSession,
    path: str,
    source_id: str | None = None,
    version: str | None = None,
    max_bytes: int | None = rules.MAX_FILE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Accepted documents and rejected files of a landing folder and its subfolders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = landed(found, source_id, version, max_bytes)
    return accepted(files), rejected(files)


def accepted(files: DataFrame) -> DataFrame:
    text = F.decode("content", "UTF-8").alias("text")
    kept = files.filter("status = 'accepted'")
    return kept.select(*[c for c in files.columns if c not in ("content", "status", "reason")], text)


def rejected(files: DataFrame) -> DataFrame:
    return files.filter("status = 'rejected'").drop("content", "status")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """All schema versions of a registry written by ``append_versions``."""
    return spark.read.schema(VERSIONS_DDL).option("recursiveFileLookup", True).parquet(path)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    return latest_versions(read_registry(spark, path))
