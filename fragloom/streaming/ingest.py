"""Streaming ingest: new files become fragments, new schemas become versions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import rules
from ..operators import detect, evolve
from ..plans.staging import staged
from ..sources.readers import accepted, landed, read_registry, rejected
from ..sources.writers import append_versions, batch_folder

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_fragments(
    spark: SparkSession, landing: str, output: str, checkpoint: str, *, js_first: bool = False
) -> StreamingQuery:
    """Fragment every file that lands, once, until nothing new is left."""
    files = spark.readStream.format("binaryFile").schema(_FILES).load(landing)
    docs = accepted(landed(files))
    return stream_documents(docs, output, checkpoint, keys=("doc_id", "path"), js_first=js_first)


def stream_rejects(spark: SparkSession, landing: str, output: str, checkpoint: str) -> StreamingQuery:
    """The files that :func:`stream_fragments` refuses, each with the reason."""
    files = spark.readStream.format("binaryFile").schema(_FILES).load(landing)
    refused = rejected(landed(files))
    return (
        refused.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )


def land_batch(
    files: DataFrame, batch_id: int, output: str, *, max_bytes: int | None = rules.MAX_FILE_BYTES, js_first: bool = False
) -> None:
    """One micro-batch of landed files: every file once, accepted or refused, and the fragments
    of those accepted.

    The files are read once, into ``files/batch-N``; fragments are cut from there into
    ``fragments/batch-N``.  Both folders are replaced when the batch runs again, so a batch
    that fails at whatever point leaves nothing behind that counts twice.
    """
    seen = landed(files, max_bytes=max_bytes)
    text = F.when(F.col("status") == "accepted", F.decode("content", "UTF-8")).alias("text")
    path = batch_folder(f"{output}/files", batch_id)
    seen.select(*[c for c in seen.columns if c != "content"], text).write.mode("overwrite").parquet(path)
    docs = files.sparkSession.read.parquet(path).filter("status = 'accepted'")
    found = detect.fragments(docs.select("doc_id", "path", "text"), keys=("doc_id", "path"), js_first=js_first)
    found.write.mode("overwrite").parquet(batch_folder(f"{output}/fragments", batch_id))


def stream_landing(
    spark: SparkSession,
    landing: str,
    output: str,
    checkpoint: str,
    *,
    max_bytes: int | None = rules.MAX_FILE_BYTES,
    max_files: int = 100_000,
    js_first: bool = False,
) -> StreamingQuery:
    """Every file that lands, in whatever subfolder, through :func:`land_batch`, until nothing
    new is left.  A batch takes ``max_files``; the rest waits for the next."""
    reader = spark.readStream.format("binaryFile").schema(_FILES)
    files = reader.option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(landing)
    return (
        files.writeStream.foreachBatch(
            lambda batch, batch_id: land_batch(batch, batch_id, output, max_bytes=max_bytes, js_first=js_first)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_landed(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """The files that :func:`stream_landing` has seen, and their fragments."""
    reader = spark.read.option("recursiveFileLookup", True)
    return reader.parquet(f"{output}/files"), reader.parquet(f"{output}/fragments")


def stream_documents(
    docs: DataFrame,
    output: str,
    checkpoint: str,
    *,
    keys: tuple[str, ...] = ("doc_id",),
    js_first: bool = False,
) -> StreamingQuery:
    """Fragment a stream of documents; nothing is kept between batches."""
    found = detect.fragments(docs, keys=keys, js_first=js_first)
    return (
        found.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )


def register_batch(batch: DataFrame, batch_id: int, registry: str, order: list[str]) -> None:
    """Register the schemas of one micro-batch, with a single write that may be repeated.

    The batch is held against what the registry has of other batches, so a batch that runs
    again, after a failure at whatever point, leaves what it would have left the first time.
    """
    spark = batch.sparkSession
    own = F.contains("_metadata.file_path", F.lit(batch_folder("", batch_id)))
    try:
        known = read_registry(spark, registry).filter(~own)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], evolve.VERSIONS_DDL)
    # Written aside first: the folder to be replaced is among those that are read.
    found = staged(evolve.process(batch, known, order)["versions"], "batch-versions")
    append_versions(found, registry, batch_id)


def stream_versions(schemas: DataFrame, registry: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Diff each arriving batch of schemas against the registry and append it."""
    return (
        schemas.writeStream.foreachBatch(
            lambda batch, batch_id: register_batch(batch, batch_id, registry, order)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
