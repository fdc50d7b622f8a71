"""Token counts through a digest cache.

The cache is a table ``digest, version, n_tokens`` in a folder: the SHA-256 of a text and
of the tokenizer (its file and the library).  Texts are joined to the stored counts of the
same tokenizer version; only the distinct texts that are missing are encoded, and their
counts are appended.  Because counts must be the library's own, the normalisation in front
of the digest changes nothing but null, which is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe
from .shared import by_value, looked_up, staged

by_value(__name__)

CACHE = "digest binary, version string, n_tokens long"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none where the folder does not exist yet."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def _encoded(missing: DataFrame, tokenizer: str, version: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, counts in byte_bpe.encoded(tokenizer, batches, 1):
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                names=["digest", "version", "n_tokens"],
            )

    return missing.select("digest", "content").mapInArrow(run, CACHE)


def fill_cache(docs: DataFrame, cache_path: str, tokenizer: str, text_col: str = "text") -> str:
    """Encode the distinct texts that the cache lacks and append their counts; returns the
    tokenizer's version.  A run that breaks off has appended nothing or whole rows, and the
    next one encodes what is missing."""
    version = byte_bpe.version(tokenizer)
    stored = read_cache(docs.sparkSession, cache_path).filter(F.col("version") == version).select("digest")
    content = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("content"))
    # Equal texts are combined within each task before the shuffle, and once more behind it;
    # only then are they looked up.  (An anti join would be moved in front of the grouping.)
    distinct = texts.groupBy("digest").agg(F.any_value("content").alias("content"))
    missing = distinct.join(stored.distinct().withColumn("known", F.lit(True)), "digest", "left").filter("known IS NULL")
    _encoded(missing, tokenizer, version).write.mode("append").parquet(cache_path)
    return version


def token_counts(
    docs: DataFrame,
    cache_path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts are those of the tokenizers library without begin, end or added special tokens;
    special strings inside texts count as the library's default takes them.  A null text
    counts as empty: 0 bytes, 0 tokens.  Repeated rows and ids each give a row.  Empty
    tables give an empty result.
    """
    version = fill_cache(docs, cache_path, tokenizer, text_col)
    stored = read_cache(docs.sparkSession, cache_path).filter(F.col("version") == version)
    stored = stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two runs may have appended one text
    content = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(content).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(content, 256)).alias("digest"),
    )
    return looked_up(staged(own, "digests"), stored, "digest", "doc_id").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
