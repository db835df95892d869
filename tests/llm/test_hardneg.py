import numpy as np
import pytest

from quern.llm import hardneg, queries


def plain(rows, k=5, share=80):
    """The definition, a pair at a time in Python's whole numbers."""
    import math

    kept = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        one = (label, [math.floor(256 * x) for x in vector])
        kept[key] = min(kept.get(key, one), one)
    out = []
    for a in (i for i in kept if i % 100 == 0):
        score = {i: sum(x * y for x, y in zip(kept[a][1], q)) for i, (_, q) in kept.items() if i != a}
        first = sorted((i for i in score if kept[i][0] == kept[a][0]), key=lambda i: (-score[i], i))[:k]
        for p in first:
            fit = sorted((i for i in score if kept[i][0] != kept[a][0] and share * score[p] <= 100 * score[i] <= 100 * score[p]), key=lambda i: (-score[i], i))
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fit[:k])]
    return sorted(out)


def mined(spark, rows, **options):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    return sorted(tuple(r) for r in hardneg.mine(df, F.col("id") % 100 == 0, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 10))
    out = []
    for i in range(1500):
        v = centres[i % 12] + rng.normal(size=10) * 0.3 if i % 3 else centres[0]  # a third share one vector
        out.append((i, [float(x) for x in v / np.linalg.norm(v)], int(rng.integers(0, 4)) if i % 2 else 1))
    return out


def test_same_as_the_definition(spark, rows):
    want = plain(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_waves_small_codebooks_and_small_blocks(spark, rows, monkeypatch):
    want = plain(rows[:900])
    assert mined(spark, rows[:900], wave=3) == want
    assert mined(spark, rows[:900], sample_rows=1) == want
    assert mined(spark, rows[:900], sample_rows=0) == want


def test_odd_rows(spark, rows):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0] * 10, 1), (2000, None, 1), (2001, [1.0, None], 1), (2002, [nan] * 10, 1), (2100, [inf] * 10, 2), (2200, [1.0] * 10, None), (2300, [], 3), (2400, [0.5], 1), (2500, [-0.0] * 10, 2)]
    odd += [(7, [0.1] * 10, 3), rows[200], (200, [0.2] * 10, 0), (-100, [-1.0] * 10, 1), (2600, [3.0] * 12, 1), (2700, [-9.0] * 12, 1)]
    every = rows[:600] + odd
    padded = [(i, None if v is None else v + [0.0] * (12 - len(v)) if v is not None else v, x) for i, v, x in every]
    assert mined(spark, every) == plain(padded)


def test_nothing(spark, rows):
    assert mined(spark, []) == [] and mined(spark, rows[1:50]) == []
    assert mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [1.0], 2)]) == [(0, 1, 1, 2, 65536, 65536)]


def test_columns_that_clash(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows[:300], "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("id", "q", "v", "score", "rank", "window", "anchor")})
    got = hardneg.mine(df, F.col("id") % 100 == 0).collect()
    assert len(got) == len(plain(rows[:300]))


def test_bounds_hold():
    rng = np.random.default_rng(4)
    v, a = rng.integers(-300, 300, (500, 13)), rng.integers(-300, 300, (40, 13))
    book = hardneg.Codebook.fit(v[:100], 13)
    score, off = hardneg.bounds(*book.encode(v), *book.tables(a))
    assert (np.abs(score - v @ a.T) <= off).all()


def test_query(compare):
    compare(queries.QUERIES["op12_hard_negatives"], queries.ORACLE["op12_hard_negatives"])
