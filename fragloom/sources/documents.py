"""A sink of text documents: one file per name, written by tasks and committed at the end.

Rows ``(document, value)`` come range-partitioned and sorted by document.  A task writes its
rows one by one into files of its own attempt; only when all tasks are done are the files of
successful attempts moved to their names.  A document that fits a partition and a file is one
file (``orders.sql``); a larger one is several, numbered in order, each whole in itself
(``orders+00003.sql``).  A file takes no further value once it has ``file_bytes``, so that
readers who need a file as a whole can hold it.
Names are quoted as in addresses, so that no two documents share a file.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# Executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Size from which a document goes on in another file.
FILE_BYTES = 16 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    named = "://" in path or path.startswith("file:")
    return fs.FileSystem.from_uri(path) if named else (fs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    files: list[tuple[str, str]]  # document, file of the attempt


class TextDocuments(DataSource):
    """``format("text_documents")`` with options ``suffix, open, between, close, file_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "text_documents"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.suffix = options.get("suffix", "")
        self.open, self.between, self.close = (options.get(k, "") for k in ("open", "between", "close"))
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.attempts = f"_attempts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, folder = _store(self.path)
        folder = f"{folder}/{self.attempts}"
        store.create_dir(folder)
        files: list[tuple[str, str]] = []
        current = out = None
        try:
            for document, value in iterator:
                if out is None or document != current or out.tell() >= self.file_bytes:
                    if out is not None:
                        out.write(self.close.encode())
                        out.close()
                    current, name = document, uuid.uuid4().hex
                    files.append((document, name))
                    out = store.open_output_stream(f"{folder}/{name}")
                    out.write(self.open.encode())
                else:
                    out.write(self.between.encode())
                out.write((value or "").encode("utf-8", "surrogatepass"))
            if out is not None:
                out.write(self.close.encode())
        finally:
            if out is not None:
                out.close()
        return _Written(TaskContext.get().partitionId(), files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(folder)):
                if old.type == fs.FileType.File and old.base_name.endswith(self.suffix):
                    store.delete_file(old.path)
        parts: dict[str, list[str]] = {}
        for message in sorted(filter(None, messages), key=lambda m: m.partition):
            for document, name in message.files:
                parts.setdefault(document, []).append(name)
        for document, found in parts.items():
            title = quote(document, safe="") or "%"
            for i, name in enumerate(found):
                number = f"+{i:05d}" if len(found) > 1 else ""
                store.move(f"{folder}/{self.attempts}/{name}", f"{folder}/{title}{number}{self.suffix}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _store(self.path)
        attempts = f"{folder}/{self.attempts}"
        if store.get_file_info(attempts).type == fs.FileType.Directory:
            store.delete_dir(attempts)


def write_documents(df: DataFrame, path: str, document: Column, order: list[Column], value: Column, **options: str) -> None:
    """The values of each document, in order, as text files in the folder ``path``, whose
    documents of the same suffix are replaced.  No values, no files.

    The partitions are ranges of (document, order), so that a document with most of the values
    is shared out among tasks; each value is held in memory alone.  Documents of no name (null
    or empty) are one, named ``%``; null values are empty.
    """
    df.sparkSession.dataSource.register(TextDocuments)
    keys = [f"_order{i}" for i in range(len(order))]
    rows = df.select(
        F.coalesce(document.cast("string"), F.lit("")).alias("document"), value.alias("value"), *[c.alias(k) for c, k in zip(order, keys, strict=True)]
    )
    ranged = rows.repartitionByRange("document", *keys).sortWithinPartitions("document", *keys)
    ranged.select("document", "value").write.format("text_documents").options(**options).mode("overwrite").save(path)


def write_sql_documents(scripts: DataFrame, path: str, document: Column, order: list[Column], sql: str) -> None:
    """``<document>.sql`` with the scripts of each document, in order."""
    write_documents(scripts, path, document, order, F.col(sql), suffix=".sql", between="\n\n", close="\n")


def write_json_documents(rows: DataFrame, path: str, document: Column, key: Column, json: str) -> None:
    """``<document>.json``: an object whose members are the JSON texts by key, which is to be
    unique in its document."""
    name = F.to_json(F.array(key.cast("string")))
    member = F.concat(F.substr(name, F.lit(2), F.length(name) - 2), F.lit(": "), F.col(json))
    write_documents(rows, path, document, [key], member, suffix=".json", open="{\n", between=",\n", close="\n}\n")
