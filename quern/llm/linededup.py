"""Line dedup by site-relative frequency.

For every host the share of its pages that hold a line is the pages with the line over all
pages of the host; lines above a ratio (and on ``min_pages`` pages) are boilerplate of that host
and go from all its pages, also from a page that has no others. With ``spare`` such a page is left as it
is: it holds nothing of its own, so it is a copy of other pages, which is for the near-duplicate operators to
decide. A line whose share equals the ratio stays.

Only a 64-bit hash of each line and its host are shuffled, summed before the shuffle, so a
line that is on a third of all pages costs one row a task. At most (lines a page / ratio)
lines of a host can pass the ratio, so the lines found are few; they are broadcast when their
counted size is small, and else joined by host, where Spark can split a large host.

Defined results: lines are compared without white space at their ends; blank lines are
never boilerplate and stay. A null text stays null and counts as a page; pages without a
host form one host. A line twice on a page counts once and goes twice. Repeated rows are
pages of their own. A very long text is split whole, inside its row. An empty table gives an
empty one. Other columns pass through, whatever their names; those named n_lines or n_dropped
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, packed, unpacked

#: Found lines up to this many are broadcast (24 bytes each).
BROADCAST_LINES = 200_000


def line_key(line: Column) -> Column:
    """Hash of a line without white space at its ends; null for a blank line."""
    bare = F.trim(line, F.lit(" \t\x0b\x0c\r"))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, flagged array of line hashes) of the pages (host, text): the boilerplate of every host that has any."""
    named = pages.select("host", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    totals = named.groupBy("host").agg(F.count("*").alias("pages"))
    keys = F.array_distinct(F.filter(F.transform("lines", line_key), lambda k: k.isNotNull()))
    counts = named.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    common = counts.where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") > max_ratio * F.col("pages"))
    return common.groupBy("host").agg(F.collect_list("key").alias("flagged"))


def line_dedup(pages: DataFrame, host: str, text: str = "text", max_ratio: float = 0.05, min_pages: int = 5, spare: bool = False) -> DataFrame:
    """``pages`` with boilerplate lines dropped from ``text``; adds n_lines and n_dropped."""
    named = F.coalesce(F.concat(F.lit("h"), pages[host].cast("string")), F.lit("none"))
    flagged = cut(boilerplate(pages.select(named.alias("host"), pages[text].alias("text")), max_ratio, min_pages))
    n = flagged.agg(F.sum(F.size("flagged"))).first()[0] or 0
    found = F.broadcast(flagged) if n <= BROADCAST_LINES else flagged
    lines = F.split(F.col("row")[text], "\n")
    hit = lambda line: F.coalesce(F.array_contains("flagged", line_key(line)), F.lit(False))
    joined = packed(pages, host=named).join(found, "host", "left")
    joined = joined.withColumn("kept", F.when(F.col("flagged").isNull(), lines).otherwise(F.filter(lines, lambda x: ~hit(x))))
    if spare:
        alone = ~F.exists("kept", lambda x: line_key(x).isNotNull())
        joined = joined.withColumn("kept", F.when(alone, lines).otherwise(F.col("kept")))
    length = lambda ls: F.greatest(F.coalesce(F.size(ls), F.lit(0)), F.lit(0)).cast("long")
    counted = {"n_lines": length(lines), "n_dropped": length(lines) - length(F.col("kept"))}
    return unpacked(joined, pages.columns, **{text: F.array_join("kept", "\n")}, **counted)
