"""Precision at k and mean reciprocal rank over ranked hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(hits: DataFrame, golden: DataFrame, top_k: int) -> DataFrame:
    """(query_id, precision, mrr, file_mrr) of golden queries (query_id, expected_files, expected_publications).

    Precision counts distinct expected files over ``top_k``; mrr takes the first hit by file or
    publication, file_mrr by file alone.
    """
    found = hits.where(F.col("rank") <= top_k).select("query_id", "rank", "file", "publication")
    joined = golden.join(found, "query_id", "left")
    by_file = F.coalesce(F.array_contains("expected_files", F.col("file")), F.lit(False))
    by_publication = F.coalesce(F.array_contains("expected_publications", F.col("publication")), F.lit(False))
    rank = lambda cond: F.coalesce(1 / F.min(F.when(cond, F.col("rank"))), F.lit(0.0))
    hit_files = F.count_distinct(F.when(by_file, F.col("file")))
    return joined.groupBy("query_id").agg((hit_files / top_k).alias("precision"), rank(by_file | by_publication).alias("mrr"), rank(by_file).alias("file_mrr"))


def summary(measured: DataFrame) -> DataFrame:
    """One row: number of queries, means and population deviations."""
    cols = [F.count("*").alias("num_queries")]
    for c in ("precision", "mrr", "file_mrr"):
        cols += [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"std_{c}")]
    return measured.agg(*cols)
