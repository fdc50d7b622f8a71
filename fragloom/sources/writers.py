"""Writers: registry, exported schemas, migration scripts, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_versions(versions: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Add versions to a registry.  Those of a numbered batch have a folder of their own, so
    that writing the batch once more replaces it and adds nothing."""
    if batch_id is None:
        versions.write.mode("append").parquet(path)
    else:
        versions.write.mode("overwrite").parquet(batch_folder(path, batch_id))


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch-{batch_id:012d}"


def write_ddl(ddl: DataFrame, path: str) -> None:
    """DDL text in one folder per category (``category=products/…``)."""
    titled = F.concat(F.col("ddl"), F.lit("\n\n"))
    ddl.select("category", titled.alias("value")).write.mode("overwrite").partitionBy(
        "category"
    ).text(path)


def write_validators(validators: DataFrame, path: str) -> None:
    """Validators keyed by schema id, one JSON object per line, one folder per category."""
    entry = F.concat(
        F.lit("{"),
        F.to_json(F.array("schema_id")).substr(F.lit(2), F.length(F.to_json(F.array("schema_id"))) - 2),
        F.lit(":"),
        F.col("validator"),
        F.lit("}"),
    )
    validators.select("category", entry.alias("value")).write.mode("overwrite").partitionBy(
        "category"
    ).text(path)


def write_migrations(migrations: DataFrame, views: DataFrame, path: str) -> None:
    """Forward, rollback and view script of each type and version, a folder per kind.

    One row per script: a folder per version would mean a file per version.
    """
    scripts = migrations.select(
        "entity_type",
        "version",
        F.inline(
            F.array(
                F.struct(F.lit("forward").alias("script"), F.col("forward").alias("value")),
                F.struct(F.lit("rollback").alias("script"), F.col("rollback").alias("value")),
            )
        ),
    ).unionByName(
        views.select("entity_type", "version", F.lit("view").alias("script"), F.col("view").alias("value"))
    )
    scripts.write.mode("overwrite").partitionBy("script").parquet(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
