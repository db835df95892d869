"""Markdown sources as DataFrames: a git checkout, a local folder, a crawl mirror."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import newlines


def path_metadata(relative: Column) -> tuple[Column, Column]:
    """Publication and file of a path below the root; a file at the root is both."""
    publication = F.substring_index(relative, "/", 1)
    file = F.when(F.contains(relative, F.lit("/")), F.substring(relative, F.length(publication) + 2, F.length(relative))).otherwise(relative)
    return publication, file


def git_head(folder: str) -> str:
    """The commit a checkout is at, ``unknown`` where git can't tell."""
    try:
        done = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], check=True, capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.SubprocessError):
        return "unknown"
    return done.stdout.strip()


@dataclass
class MarkdownSource:
    """Files below ``root``; subclasses say what release they belong to."""

    spark: SparkSession
    root: str

    def release(self) -> tuple[str, str, str]:
        """Repository address, branch and commit."""
        raise NotImplementedError

    def files(self, limit: int | None = None) -> DataFrame:
        """(path, publication, file, repo_url, branch, sha, text) of all ``*.md`` files; ``limit``: the first by path.

        Files of no bytes have no row: Spark's readers leave them out.
        """
        reader = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true")
        # the scan's paths are encoded URIs
        place = F.regexp_replace(F.try_url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), r"^[a-z]+:/*", "/")
        below = F.replace(place, F.lit(f"{self._plain_root()}/"), F.lit(""))
        publication, file = path_metadata(below)
        url, branch, sha = self.release()
        found = reader.load(self.root).select(
            below.alias("path"),
            publication.alias("publication"),
            file.alias("file"),
            F.lit(url).alias("repo_url"),
            F.lit(branch).alias("branch"),
            F.lit(sha).alias("sha"),
            newlines(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"),
        )
        return found if limit is None else found.orderBy("path").limit(limit)

    def _plain_root(self) -> str:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        whole = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath()
        return whole.rstrip("/")

    def release_info(self) -> DataFrame:
        """One row: branch, sha, repo_url, file_count."""
        url, branch, sha = self.release()
        count = self.files().agg(F.count("*").alias("file_count"))
        return count.select(F.lit(branch).alias("branch"), F.lit(sha).alias("sha"), F.lit(url).alias("repo_url"), "file_count")


@dataclass
class GitSource(MarkdownSource):
    """The ``markdown`` folder of a checkout."""

    repo_url: str = ""
    branch: str = "main"

    def __post_init__(self) -> None:
        self.checkout, self.root = self.root, f"{self.root.rstrip('/')}/markdown"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            raise FileNotFoundError(f"no folder markdown in {self.checkout}")

    def release(self) -> tuple[str, str, str]:
        if not hasattr(self, "_sha"):
            self._sha = git_head(self.checkout)
        return self.repo_url, self.branch, self._sha


@dataclass
class LocalSource(MarkdownSource):
    """Any folder."""

    repo_url: str = "local://docs"
    branch: str = "local"

    def release(self) -> tuple[str, str, str]:
        return self.repo_url, self.branch, "local"


@dataclass
class CrawlSource(MarkdownSource):
    """A mirror that a crawl wrote, with its record (JSON: source_url, crawled_at, crawler_sha)."""

    record: str | None = None

    def release(self) -> tuple[str, str, str]:
        url = sha = date = "unknown"
        if self.record:
            row = self.spark.read.schema("source_url string, crawled_at string, crawler_sha string").json(self.record, multiLine=True).first()
            if row:
                url, sha = row["source_url"] or "unknown", row["crawler_sha"] or "unknown"
                date = (row["crawled_at"] or "unknown")[:10]
        return url, f"crawl-{date}", sha


def write_mirror(files: DataFrame, root: str) -> int:
    """Write (publication, file, text) as one file each below ``root``, from the executors; the number of files.

    ``root`` is a URI that pyarrow can open (file, hdfs, s3 and others). A file is replaced whole, so
    a task that is tried again does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            for publication, file, text in zip(*(batch.column(c).to_pylist() for c in ("publication", "file", "text")), strict=True):
                path = f"{top}/{publication}/{file}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    written = files.select("publication", "file", "text").mapInArrow(run, "n long")
    return written.agg(F.sum("n")).first()[0] or 0


def create_source(spark: SparkSession, kind: str, root: str | None = None, repo_url: str = "", branch: str = "main", record: str | None = None) -> MarkdownSource:
    """The source of a kind (``git``, ``local``, ``web_crawl``); a missing argument raises ValueError."""
    if kind not in ("git", "local", "web_crawl"):
        raise ValueError(f"unknown kind of source: {kind}")
    if not root:
        raise ValueError(f"a {kind} source needs a root folder")
    if kind == "git":
        if not repo_url:
            raise ValueError("a git source needs its repository's address")
        return GitSource(spark, root, repo_url, branch)
    return LocalSource(spark, root) if kind == "local" else CrawlSource(spark, root, record)
