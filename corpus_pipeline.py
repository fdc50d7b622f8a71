"""Corpus pipeline: stages applied to ``documents``, each written and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fragloom.llm import exact_dedup, language_id, mixing, piece_codec, simhash_dedup
from fragloom.llm.shared import checkpoint_dir, row_hash


#: Documents whose language is known with less than this are rejected, as are those without
#: a letter.
LEAST_SCORE = 0.35
PIECES, PIECE_SEED = "piece_bpe_32k.model", 20


def of_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents in no learnt language go."""
    return language_id.identified(docs, LEAST_SCORE)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts, the row with the smallest doc_id stays."""
    return exact_dedup.dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    return simhash_dedup.near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents as often as their source's target asks for, in training order."""
    return mixing.mix(docs)


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece with merge-dropout: ids of every text, with the text decoded from them.
    A document that the mix takes twice is spelt anew the second time."""
    model = public_tokenizers.path(PIECES)
    taken = {c.lower() for c in docs.columns}
    place, copy = (next(n for k in range(len(taken) + 1) if (n := "_" * k + name) not in taken) for name in ("_place", "_copy"))
    alike = Window.partitionBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), row_hash(docs)).orderBy(place)
    numbered = docs.withColumn(place, F.monotonically_increasing_id()).withColumn(copy, F.row_number().over(alike))
    in_order = numbered.repartitionByRange(place).sortWithinPartitions(place).drop(place)
    spelt = piece_codec.encode(in_order, model, seed=PIECE_SEED, copy_col=copy).drop(copy)
    return piece_codec.decode(spelt, model)


STAGES = [
    ("language id", of_known_language),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", in_pieces),
]

#: Fingerprints and a trained classifier are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/fragloom/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
