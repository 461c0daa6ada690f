"""One file for each document, as a Spark data source.

Each task writes the documents of its rows: a file is written under a name of
the attempt's own and then moved to its final one, which follows from the
document's id. A task that runs again, or twice at a time, leaves the same
files, and a file under its final name is whole. The commit writes
``_SUCCESS`` with the number of files. The path may be any that pyarrow's file
systems know (a shared folder, object storage); all executors must reach it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "turnstile_documents"


@dataclass
class _Written(WriterCommitMessage):
    files: int


def file_name(key: object, suffix: str) -> str:
    """The document's id, what a file name can't hold as %XX, and the suffix."""
    return f"{quote(str(key), safe='')}{suffix}"


class _Writer(DataSourceWriter):
    def __init__(self, path: str, key: str, text: str, suffix: str) -> None:
        self.path, self.key, self.text, self.suffix = path, key, text, suffix

    def _target(self) -> tuple[fs.FileSystem, str]:
        # Spark may write a local path as file:/x
        path = self.path.removeprefix("file:") if self.path.startswith("file:/") and "://" not in self.path else self.path
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, base = self._target()
        system.create_dir(base, recursive=True)
        mine, n = uuid.uuid4().hex, 0
        for row in rows:
            name = file_name(row[self.key], self.suffix)
            with system.open_output_stream(f"{base}/_{mine}-{name}") as out:
                out.write((row[self.text] or "").encode("utf-8", "replace"))
            system.move(f"{base}/_{mine}-{name}", f"{base}/{name}")
            n += 1
        return _Written(n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = self._target()
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/_SUCCESS") as out:
            out.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Whole files stay; there is no ``_SUCCESS``."""


class DocumentFiles(DataSource):
    """``df.write.format("turnstile_documents")`` with the options path, key
    (column of the id), text (column of the content), suffix."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        o = self.options
        return _Writer(o["path"], o.get("key", "page_id"), o.get("text", "markdown"), o.get("suffix", ".md"))


def write_files(docs: DataFrame, path: str, key: str = "page_id", text: str = "markdown", suffix: str = ".md") -> None:
    """One file for each row of ``docs``, named by ``key``. Ids must differ:
    of rows that share one, the last to be written stays."""
    spark = docs.sparkSession
    spark.dataSource.register(DocumentFiles)
    (docs.select(key, text).write.format(FORMAT).mode("append")
     .option("path", path).option("key", key).option("text", text).option("suffix", suffix).save())
