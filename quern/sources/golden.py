"""Golden query sets: JSON lines of query, expected_files, expected_publications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import tokenize
from quern.operators.lexical import LexicalIndex

SCHEMA = "query string, expected_files array<string>, expected_publications array<string>"


def read_golden(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """Golden queries; blank lines are skipped, malformed ones fail, or drop out if ``lenient``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    mode = "PERMISSIVE" if lenient else "FAILFAST"
    rows = lines.select(F.from_json("value", SCHEMA, {"mode": mode}).alias("g")).select("g.*")
    rows = rows.where(F.col("query").isNotNull()) if lenient else rows
    none = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(c, none) for c in ("expected_files", "expected_publications")})


def existing_queries(spark: SparkSession, path: str) -> DataFrame:
    """The distinct queries of a set."""
    return read_golden(spark, path, lenient=True).select("query").distinct()


def write_golden(rows: DataFrame, path: str) -> None:
    rows.select("query", "expected_files", "expected_publications").write.mode("overwrite").json(path)


def build_golden(topics: DataFrame, files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Golden rows from (place, query, files, publications): files that exist, new queries, first of equals.

    A query none of whose files exist drops out.
    """
    one = topics.select("place", "query", "publications", F.posexplode("files").alias("k", "file"))
    there = one.join(files.select("file").distinct(), "file", "left_semi")
    kept = there.groupBy("place", "query", "publications").agg(F.sort_array(F.collect_list(F.struct("k", "file"))).alias("fs"))
    if existing is not None:
        kept = kept.join(existing.select("query").distinct(), "query", "left_anti")
    first = kept.groupBy("query").agg(F.min_by(F.struct(F.transform("fs", lambda f: f["file"]).alias("expected_files"), F.col("publications").alias("expected_publications")), "place").alias("g"))
    return first.select("query", "g.expected_files", "g.expected_publications")


def containing(passages: DataFrame, chunks: DataFrame, index: LexicalIndex, field: str = "text") -> DataFrame:
    """(query_id, expected_files, expected_publications): the rows of ``chunks`` that hold a passage (query_id, passage).

    A row that holds a passage holds all its words but the outer two, whose other halves may stand
    outside. So the index gives the rows with the rarest inner word, and only these are searched for
    the passage. A passage without an inner word is looked for in every row; such ones are counted
    and may be at most a thousand.
    """
    asked = passages.select("query_id", "passage", tokenize(F.col("passage")).alias("ts"))
    inner = asked.where(F.size("ts") > 2).select("query_id", F.explode(F.array_distinct(F.slice("ts", 2, F.size("ts") - 2))).alias("term"))
    known = inner.join(index.terms.where(F.col("field") == field).select("term", "df"), "term", "left")
    rarest = known.groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), F.col("term"))).alias("term"))
    pairs = index.containing(rarest.where(F.col("term").isNotNull()), field).select("query_id", "id")
    told = chunks.select("id", "file", "publication", F.col("text").alias("body"))
    found = told.join(pairs, "id").join(passages.select("query_id", "passage"), "query_id").where(F.contains("body", F.col("passage")))
    short = asked.where(F.size("ts") <= 2).select("query_id", "passage")
    if n := short.limit(1001).count():
        if n > 1000:
            raise ValueError("more than 1000 passages without an inner word")
        short = told.join(F.broadcast(short), F.contains("body", F.col("passage")))
        found = found.select("query_id", "file", "publication").unionByName(short.select("query_id", "file", "publication"))
    return found.groupBy("query_id").agg(F.sort_array(F.collect_set("file")).alias("expected_files"), F.sort_array(F.collect_set("publication")).alias("expected_publications"))
