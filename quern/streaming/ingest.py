"""Structured Streaming ingest: files arrive in a folder, chunks and postings grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions.text import newlines, tokenize
from quern.operators.chunking import chunks
from quern.sources.corpus import path_metadata


def markdown_stream(spark: SparkSession, root: str) -> DataFrame:
    """(publication, file, text) of the ``*.md`` files that appear below ``root``."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace("path", rf"^.*?\Q{root.rstrip('/').split(':')[-1]}\E/", "")
    publication, file = path_metadata(below)
    return raw.select(publication.alias("publication"), file.alias("file"), newlines(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))


def ingest(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append chunks and token counts of each batch; a batch that is tried again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        made = chunks(batch)
        made.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        counted = made.select("id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
        counted.write.mode("overwrite").parquet(f"{out}/postings/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_counts(files: DataFrame) -> DataFrame:
    """Running document frequency of every term of a stream of files."""
    terms = files.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))
