"""Exact dedup by skew-safe combining.

Three stages, each grouping by the digest *and* the whole normalised text, so that equal
digests alone never make two texts equal:

1. every task combines its own rows (the partial aggregation before the first shuffle),
2. rows of one group and salt meet, so that a group holding a third of all rows is
   spread over ``SALTS`` tasks,
3. the at most ``SALTS`` winners of a group meet and the smallest of them wins.

A document then finds the winner of its group through (digest, salt), the pairs that
stage 2 has shown to be in use, so that the look-up is as spread as stage 2 was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import normal_space, row_hash

SALTS = 64


def _judged(docs: DataFrame, id_col: str, text_col: str, salts: int, row) -> DataFrame:
    keyed = docs.select(
        row.alias("row"),
        F.col(id_col).alias("doc_id"),
        normal_space(F.col(text_col)).alias("content"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("salt"),
        row_hash(docs).alias("tie"),
    ).withColumn("digest", F.sha2("content", 256))
    salted = keyed.groupBy("digest", "content", "salt").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")
    )
    whole = Window.partitionBy("digest", "content")
    winners = salted.select(
        "digest",
        "salt",
        F.min("least").over(whole).alias("keep_id"),
        F.sum("n").over(whole).alias("group_size"),
    )
    # Documents look their group up by digest: two texts of one digest must not pass.
    texts = F.count(F.lit(1)).over(Window.partitionBy("digest", "salt"))
    winners = winners.withColumn(
        "group_size", F.when(texts > 1, F.raise_error(F.lit("two texts share a digest"))).otherwise(F.col("group_size"))
    )
    first = F.row_number().over(Window.partitionBy("digest", "salt", "doc_id").orderBy("tie"))
    return (
        keyed.drop("content")
        .join(winners, ["digest", "salt"])
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (first == 1))
    )


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after each run of white space became one
    space; a null text counts as empty.  The row with the smallest id stays; a null id is
    larger than every other.  Rows that repeat an id within a group are a tie: exactly one
    of the rows with the kept id stays, the one of the least hash of all columns.  An empty table gives an empty result; other
    columns are not looked at.
    """
    return _judged(docs, id_col, text_col, salts, F.lit(None)).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all their columns; rules as in :func:`groups`."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _judged(docs, id_col, text_col, salts, row).filter("kept").select("row.*")
