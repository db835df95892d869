"""The engine's text functions for use in SQL, as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

_H2 = r"(?md)^##\\s+(.+?)\\s*$"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '(?U)\\A[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+\\z', '')"


FUNCTIONS = {
    "quern_tokens": ("t STRING", "ARRAY<STRING>", "regexp_extract_all(lower(coalesce(t, '')), '[a-zA-Z0-9_#]++', 0)"),
    "quern_words": ("t STRING", "ARRAY<STRING>", "array_distinct(filter(split(lower(coalesce(t, '')), '(?U)\\\\s+'), x -> x <> ''))"),
    "quern_hits": ("t STRING, words ARRAY<STRING>", "INT", "size(filter(words, w -> coalesce(contains(t, w), false)))"),
    "quern_has_fence": ("t STRING", "BOOLEAN", "t RLIKE '(?md)^`{3}'"),
    "quern_expand": (
        "ts ARRAY<STRING>",
        "ARRAY<STRING>",
        "array_distinct(flatten(transform(ts, t -> CASE WHEN length(t) <= 3 THEN array(t) ELSE concat(array(t),"
        " CASE WHEN t LIKE '%s' THEN array(left(t, length(t) - 1)) ELSE array(concat(t, 's')) END,"
        " CASE WHEN t LIKE '%ing' AND length(t) > 4 THEN array(left(t, length(t) - 3), concat(left(t, length(t) - 3), 'e'))"
        " WHEN t LIKE '%e' THEN array(concat(left(t, length(t) - 1), 'ing'), concat(t, 'd')) ELSE array() END,"
        " CASE WHEN t LIKE '%ed' THEN array(left(t, length(t) - 2), concat(left(t, length(t) - 2), 'e')) ELSE array() END) END)))",
    ),
    "quern_sections": (
        "body STRING",
        "ARRAY<STRUCT<heading: STRING, text: STRING>>",
        f"CASE WHEN NOT body RLIKE '{_H2}' THEN array(named_struct('heading', 'Overview', 'text', {_strip('body')}))"
        f" ELSE filter(transform(concat(array('Overview'), regexp_extract_all(body, '{_H2}', 1)), (h, i) -> named_struct('heading', h,"
        f" 'text', {_strip(f"get(split(body, '{_H2}'), i)")})), x -> x.text <> '') END",
    ),
    "quern_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    return list(FUNCTIONS)
