"""Listing, reading and searching files (publication, file, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import lenient_frontmatter, simple_fields, strip


def check_path(path: str, what: str) -> str:
    """Refuse empty and absolute paths and those that climb out of their folder."""
    if not path or path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"invalid {what}: {path}")
    return path


def list_publications(files: DataFrame) -> DataFrame:
    """(name, file_count), by name."""
    return files.groupBy(F.col("publication").alias("name")).agg(F.count("*").alias("file_count")).orderBy("name")


def list_files(files: DataFrame, publication: str) -> DataFrame:
    """(file, title, product_area, last_updated) of a publication, by file; an unknown one raises FileNotFoundError."""
    own = files.where(F.col("publication") == check_path(publication, "publication"))
    if own.isEmpty():
        raise FileNotFoundError(publication)
    meta = simple_fields(lenient_frontmatter(F.col("text"))["meta"])
    field = lambda k: F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit("")).alias(k)
    return own.withColumn("meta", meta).select("file", field("title"), field("product_area"), field("last_updated")).orderBy("file")


def read_file(files: DataFrame, publication: str, file: str, max_chars: int = 50_000) -> DataFrame:
    """One row (publication, file, frontmatter, content, truncated); a missing file raises FileNotFoundError."""
    check_path(publication, "publication"), check_path(file, "file")
    own = files.where((F.col("publication") == publication) & (F.col("file") == file))
    if own.isEmpty():
        raise FileNotFoundError(f"{publication}/{file}")
    parts = lenient_frontmatter(F.col("text"))
    return own.withColumn("__p", parts).select(
        "publication",
        "file",
        simple_fields(F.col("__p.meta")).alias("frontmatter"),
        F.left(F.col("__p.body"), F.lit(max_chars)).alias("content"),
        (F.length(F.col("__p.body")) > max_chars).alias("truncated"),
    )


def preview(lines: Column, line: Column, context: int = 1) -> Column:
    """The line (numbered from 1) with its neighbours, joined, without white space at the ends."""
    start = F.greatest(F.lit(1), line - context)
    return strip(F.array_join(F.slice(lines, start, line + context - start + 1), "\n"))


def within(files: DataFrame, scope: str | None) -> DataFrame:
    """The files below a folder; FileNotFoundError if there are none."""
    if not scope:
        return files
    check_path(scope, "scope")
    own = files.where(F.concat("publication", F.lit("/"), "file").startswith(scope.rstrip("/") + "/"))
    if own.isEmpty():
        raise FileNotFoundError(scope)
    return own


def search_text(files: DataFrame, query: str, scope: str | None = None, regex: bool = False, max_results: int | None = 50) -> DataFrame:
    """(file, line, preview): the first matching line of each file, by path; a bad pattern finds nothing."""
    files = within(files, scope)
    if regex:
        try:
            files.sparkSession._jvm.java.util.regex.Pattern.compile(query)
        except Exception:  # what Java says of a bad pattern
            return files.select(F.lit("").alias("file"), F.lit(0).alias("line"), F.lit("").alias("preview")).limit(0)
    hit = (lambda x: x.rlike(query)) if regex else (lambda x: F.contains(x, F.lit(query)))
    lines = F.split(F.col("text"), "\n")
    first = F.array_position(F.transform(lines, hit), F.lit(True)).cast("int")
    found = files.where(hit(F.col("text")) if not regex else F.lit(True)).withColumn("line", first).where(F.col("line") > 0)
    out = found.select(F.concat("publication", F.lit("/"), "file").alias("file"), "line", preview(lines, F.col("line")).alias("preview"))
    return out if max_results is None else out.orderBy("file").limit(max_results)


def files_by_folder(files: DataFrame) -> DataFrame:
    """(folder, n, files): the files of each folder below the root, sorted; ``.`` is the root itself."""
    path = F.when(F.col("publication") == F.col("file"), F.col("file")).otherwise(F.concat("publication", F.lit("/"), "file"))
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))
    return files.select(folder.alias("folder"), path.alias("path")).groupBy("folder").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("path")).alias("files"))
