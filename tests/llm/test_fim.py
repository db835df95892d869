import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import fim, queries


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=900))
def test_rank_and_select_are_those_of_the_string(text):
    raw = text.encode("utf-8", "surrogatepass")
    bounds = fim.Boundaries(np.frombuffer(raw, np.uint8))
    starts = [i for i, b in enumerate(raw) if b & 0xC0 != 0x80]
    at = np.arange(len(raw) + 1)
    assert bounds.rank(at).tolist() == [sum(s < i for s in starts) for i in range(len(raw) + 1)]
    assert bounds.select(np.arange(len(starts))).tolist() == starts


def plain(key, text):
    """The transformation from its definition."""
    t = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (key, n, "plain", None, None, t)
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < 20:
        return (key, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (key, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def rows(odd_rows):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc <>é☃𝄞́PSM") for _ in range(rng.randrange(0, 700))) for _ in range(400)]
    texts += ["<P>", "a<S>b", "x<M", "<", "<P", ">S>", "𝄞", "ab" * 600_000, "é" * 5_000_000 + "𝄞"]  # over the bytes of a slice, too
    return [(r[0], r[1]) for r in odd_rows] + [(1000 + i, t) for i, t in enumerate(texts)]


def test_outputs_are_those_of_the_definition_and_turn_back(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = fim.transform(df).withColumn("restored", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in x)
    assert sorted([(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out], key=key) == sorted([plain(*r) for r in rows], key=key)
    assert all(r["restored"] == (r["text"] or "") for r in out)
    assert {"plain", "psm", "spm"} == {r["form"] for r in out}


def test_columns_that_clash_and_empty_tables(spark, odd, nothing):
    from pyspark.sql import functions as F

    df = odd.withColumns({c: F.lit("own") for c in ("form", "n", "output", "prefix_chars", "cuts", "__row")})
    out = fim.transform(df)
    assert out.count() == odd.count() and set(out.columns) >= {*df.columns, "middle_chars"}
    assert {r["cuts"] + r["__row"] for r in out.select("cuts", "__row").collect()} == {"ownown"}
    assert {r["form"] for r in out.select("form").collect()} <= {"plain", "psm", "spm"}
    assert fim.transform(nothing).collect() == []


def test_query(spark, sf_dir):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = db.execute(queries.ORACLE["op13_fim"])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in queries.QUERIES["op13_fim"](spark, sf_dir).select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall())) and len(got) == 200
