"""Crawl bookkeeping: which pages of an index are to be fetched, and what came of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.urls import links, main_text, mirror_path
from quern.operators.bundle import write_text


def index_links(indexes: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(section, place, url) of the indexes (section, base_url, content); the first ``max_pages`` of each."""
    found = links(F.col("content"), F.col("base_url"))
    if max_pages:
        found = F.slice(found, 1, max_pages)
    return indexes.select("section", F.posexplode(found).alias("place", "url"))


def to_fetch(urls: DataFrame, stored: DataFrame) -> DataFrame:
    """URLs whose mirror path is not among the stored ones (path): a crawl goes on where it stopped."""
    return urls.withColumn("path", mirror_path(F.col("url"))).join(stored.select("path").distinct(), "path", "left_anti")


def outcome(urls: DataFrame, stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """One row a section: skipped, fetched, errors, bytes. ``fetched`` has url and html (null: it failed)."""
    known = urls.withColumn("path", mirror_path(F.col("url"))).join(stored.select("path", F.lit(True).alias("__there")).distinct(), "path", "left")
    body = known.join(fetched.select("url", main_text(F.col("html")).alias("__body")), "url", "left")
    skipped = F.col("__there").isNotNull()
    return body.groupBy("section").agg(
        F.count(F.when(skipped, 1)).alias("skipped"),
        F.count(F.when(~skipped & F.col("__body").isNotNull(), 1)).alias("fetched"),
        F.count(F.when(~skipped & F.col("__body").isNull(), 1)).alias("errors"),
        F.coalesce(F.sum(F.when(~skipped, F.octet_length("__body"))), F.lit(0)).alias("bytes"),
    )


def store_fetched(urls: DataFrame, stored: DataFrame, fetched: DataFrame, folder: str) -> dict[str, int]:
    """Write (section, path, text) of the pages that were fetched and not stored yet; the crawl's counters, taken in the same pass."""
    known = urls.withColumn("path", mirror_path(F.col("url"))).join(stored.select("path", F.lit(True).alias("__there")).distinct(), "path", "left")
    body = known.join(fetched.select("url", main_text(F.col("html")).alias("text")), "url", "left")
    skipped, there = F.col("__there").isNotNull(), F.col("text").isNotNull()
    seen = Observation()
    told = body.observe(
        seen,
        F.count(F.when(skipped, 1)).alias("skipped"),
        F.count(F.when(~skipped & there, 1)).alias("fetched"),
        F.count(F.when(~skipped & ~there, 1)).alias("errors"),
        F.coalesce(F.sum(F.when(~skipped, F.octet_length("text"))), F.lit(0)).alias("bytes"),
    )
    told.where(~skipped & there).select("section", "path", "text").write.mode("overwrite").parquet(folder)
    return seen.get


def write_record(spark: SparkSession, path: str, source_url: str, crawled_at: str, crawler_sha: str, sections: DataFrame | None = None, engine: str = "none", stealth: bool = False) -> dict:
    """Write the record of a crawl as JSON, which a crawl source reads; with the counters of :func:`outcome`, summed."""
    record = {"source_url": source_url, "crawled_at": crawled_at, "crawler_sha": crawler_sha, "engine": engine, "stealth": stealth}
    if sections is not None:
        counters = ["skipped", "fetched", "errors", "bytes"]
        record |= sections.agg(F.count("*").alias("sections"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters]).first().asDict()
    write_text(spark, path, json.dumps(record, indent=1, sort_keys=True))
    return record


def crawl_plan(indexes: DataFrame, max_pages: int) -> DataFrame:
    """(section, place, url) of a whole crawl of indexes (place_of_section, section, base_url, content).

    Every section gives its first ``max_pages``; sections are taken in order until those before
    have ``max_pages`` together, so the last one may go beyond.
    """
    found = index_links(indexes, max_pages)
    sizes = indexes.select("section", "place_of_section").join(found.groupBy("section").agg(F.count("*").alias("__n")), "section", "left")
    before = Window.orderBy("place_of_section").rowsBetween(Window.unboundedPreceding, -1)  # one row a section
    taken = sizes.withColumn("__before", F.coalesce(F.sum(F.coalesce("__n", F.lit(0))).over(before), F.lit(0))).where(F.col("__before") < max_pages)
    return found.join(taken.select("section"), "section", "left_semi")
