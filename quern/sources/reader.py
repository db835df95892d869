"""Markdown folders as a Spark data source: ``spark.read.format("quern_markdown").load(root)``, and as a stream.

A filter on ``publication`` lists that folder alone. Files are dealt to tasks by size; a stream's offset is the time of
the last change it has seen, so files come once, and a file that is changed comes again. ``root`` is a path or a URI
that pyarrow can open on driver and executors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

SCHEMA = "path string, publication string, file string, text string"
#: Bytes of files a task reads, about.
BYTES_A_TASK = 32 << 20


@dataclass
class Files(InputPartition):
    """Paths below the root that a task reads."""

    paths: list[str]

    def __post_init__(self) -> None:
        super().__init__(None)


def _store(root: str) -> tuple[fs.FileSystem, str]:
    store, top = fs.FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")
    return store, top.rstrip("/")


def listed(root: str, publication: str | None = None) -> list[tuple[str, int, int]]:
    """(path below the root, bytes, time of the last change) of the ``*.md`` files, of one publication or all; files of no bytes are left out."""
    store, top = _store(root)
    if publication is None:
        found = store.get_file_info(fs.FileSelector(top, recursive=True))
    else:
        if not publication or "/" in publication or publication in (".", ".."):
            return []
        info = store.get_file_info(f"{top}/{publication}")  # a file at the root is its own publication
        found = store.get_file_info(fs.FileSelector(info.path, recursive=True)) if info.type == fs.FileType.Directory else [info]
    return sorted((f.path[len(top) + 1 :], f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and f.path.endswith(".md") and f.size)


def dealt(files: list[tuple[str, int, int]]) -> list[Files]:
    """The files in tasks of about BYTES_A_TASK."""
    out: list[Files] = []
    held = BYTES_A_TASK
    for path, size, _ in files:
        if held + size > BYTES_A_TASK:
            out.append(Files([]))
            held = 0
        out[-1].paths.append(path)
        held += size
    return out


def read(root: str, part: Files) -> Iterator[pa.RecordBatch]:
    store, top = _store(root)
    for path in part.paths:
        with store.open_input_stream(f"{top}/{path}") as stream:
            text = stream.read().decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
        publication, _, file = path.partition("/")
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (path, publication, file or path, text)], names=["path", "publication", "file", "text"])


class MarkdownReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.publication = root, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("publication",) and self.publication is None:
                self.publication = f.value
            yield f  # Spark looks again, which costs nothing

    def partitions(self) -> list[Files]:
        return dealt(listed(self.root, self.publication)) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from read(self.root, partition)


class MarkdownStream(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        return {"changed": max((t for _, _, t in listed(self.root)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return dealt([f for f in listed(self.root) if start["changed"] < f[2] <= end["changed"]]) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from read(self.root, partition)


class MarkdownDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quern_markdown"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MarkdownReader:
        return MarkdownReader(self.options["path"])

    def streamReader(self, schema) -> MarkdownStream:
        return MarkdownStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MarkdownDataSource)
