"""Front matter with types: values, nesting, what is malformed."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import typed
from quern.operators import chunking

GOOD = {
    "a: 1\nb: -0x1F\nc: 017\nd: 0b11\ne: 1_000": {"a": 1, "b": -31, "c": 15, "d": 3, "e": 1000},
    "a: 1.5\nb: .5e+1\nc: 1e3\nd: 12:30\ne: .inf": {"a": 1.5, "b": 5.0, "c": "1e3", "d": "12:30", "e": ".inf"},
    "a: yes\nb: OFF\nc: ~\nd:\ne: 'yes'\nf: nope": {"a": True, "b": False, "c": None, "d": None, "e": "yes", "f": "nope"},
    "a: x # note\nb: x#y\nc: 'x # y'\n# all\nd: http://h/p#q": {"a": "x", "b": "x#y", "c": "x # y", "d": "http://h/p#q"},
    'a: "\\u00e9\\n\\"\\x41"\nb: \'it\'\'s\'': {"a": 'é\n"A', "b": "it's"},
    "a:\n- 1\n-\n  - 2\n  - k: v\n    l: w\n- - 3": {"a": [1, [2, {"k": "v", "l": "w"}], [3]]},
    "a:\n  b:\n    c: {d: [1, {e: f}], 'g h': , i}\n  j: []": {"a": {"b": {"c": {"d": [1, {"e": "f"}], "g h": None, "i": None}}, "j": []}},
    "a: [x,\n  y, 'z\n  w']\nb: {k:\n  1}": {"a": ["x", "y", "z w"], "b": {"k": 1}},
    "a: one\n  two\n\n  three\nb: 'one\n  two'\nc: \"one\\\n  two\"": {"a": "one two\nthree", "b": "one two", "c": "onetwo"},
    "a: |\n  x\n    y\n\n  z\nb: >\n  x\n  y\n\n  z\nc: |-\n  x\nd: |+\n  x\n\ne: >-\n  x\n   y\n  z": {"a": "x\n  y\n\nz\n", "b": "x y\nz\n", "c": "x", "d": "x\n\n", "e": "x\n y\nz"},
    "a: 1\na: 2\n1: x\ntrue: y\n'q r': z": {"a": 2, "1": "x", "true": "y", "q r": "z"},
    "": {},
    "# nothing": {},
    "{a: 1, b: [2]}": {"a": 1, "b": [2]},
}
BAD = ["- a", "text", "a: b: c", "a: [x", "a: 'x", "a: &x 1", "a: *x", "a: !!int 1", "\ta: 1", "a: 1\n  b: 2", "a: x\n---\nb: y", "a: [x] y", "a: 'x' y", 'a: "\\q"', 'a: "\\ud800"', "a: {x: [1}", "a:\n- 1\n b: 2", "a: -", "a: " + "[" * 300, "a: |x\n  y", "\n".join(" " * i + "k:" for i in range(300))]


@pytest.mark.parametrize("block", GOOD)
def test_values(block):
    assert typed.read(block) == GOOD[block]


@pytest.mark.parametrize("block", BAD)
def test_malformed(block):
    with pytest.raises(typed.Malformed):
        typed.read(block)


def test_long_lines_take_linear_time():
    for block in ("a" + " " * 400_000 + "b", "a: " + "x " * 200_000, "a: [" + "x, " * 100_000 + "x]", "a: >\n" + "  x\n" * 100_000, "a: '" + "x\n\n  " * 100_000 + "'"):
        try:
            typed.read(block)
        except typed.Malformed:
            pass


def test_variants_of_files(spark):
    rows = [(k, f"---\n{b}\n---\nbody") for k, b in enumerate([*GOOD, *BAD])] + [(100, None), (101, ""), (102, "no block"), (103, "---\na: 1\n---\n" + "x" * 3_000_000)]
    got = chunking.with_typed_frontmatter(spark.createDataFrame(rows, "k int, text string")).select("k", F.to_json("data").alias("j"), "body").collect()
    by = {r["k"]: (None if r["j"] is None else json.loads(r["j"]), r["body"]) for r in got}
    assert len(by) == len(rows)
    for k, block in enumerate(GOOD):
        assert by[k] == (GOOD[block], "body"), block
    for k, block in enumerate(BAD, len(GOOD)):
        if "\n---\n" not in block:  # where a file's block would end
            assert by[k] == (None, f"---\n{block}\n---\nbody")
    assert by[100] == (None, None) and by[101] == (None, "") and by[102] == (None, "no block") and by[103] == ({"a": 1}, "x" * 3_000_000)


def test_columns_of_clashing_names_stay(spark):
    got = chunking.with_typed_frontmatter(spark.createDataFrame([("---\nmeta: 1\n---\nx", "old", 7)], "text string, meta string, n int")).select("text", "meta", "n", "body", F.variant_get("data", "$.meta", "int").alias("got")).first()
    assert got.asDict() == {"text": "---\nmeta: 1\n---\nx", "meta": "old", "n": 7, "body": "x", "got": 1}
    assert chunking.with_typed_frontmatter(spark.createDataFrame([], "text string")).count() == 0
