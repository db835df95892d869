import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import linededup, mixing, queries
from quern.llm.production import mix_weight

from plain import plain_lines

def test_line_dedup_matches_a_plain_version(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["h1", "h1", "h1", "h2", None]), "\n".join(rnd.choice(["menu ", "menu", "\tfooter", "", " ", *map(str, range(30))]) for _ in range(rnd.randint(1, 8)))) for _ in range(300)] + [("h1", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, host string, text string")
    got = [r["text"] for r in linededup.line_dedup(df, "host", max_ratio=0.2, min_pages=3).orderBy("i").collect()]
    assert got == plain_lines(rows, 0.2, 3)


def test_pages_of_boilerplate_alone(spark):
    rows = [(i, "h", "menu\nnot found\nfooter" if i < 6 else f"menu\nbody of page {i}\nfooter") for i in range(60)]
    df = spark.createDataFrame(rows, "i int, host string, text string")
    got = {r["i"]: (r["text"], r["n_dropped"]) for r in linededup.line_dedup(df, "host").collect()}
    assert all(got[i] == ("", 3) for i in range(6)) and all(got[i] == (f"body of page {i}", 2) for i in range(6, 60))
    spared = {r["i"]: r["text"] for r in linededup.line_dedup(df, "host", spare=True).collect()}
    assert all(spared[i] == rows[i][2] for i in range(6)) and spared[7] == "body of page 7"


def test_rows_without_a_key_are_dealt_to_many_shards(spark):
    df = spark.createDataFrame([(None, "s", f"{i} " * 40) for i in range(3000)], "k long, source string, text string")
    got = mixing.mix(df, "k", "source", "text", mix_weight)
    assert got.agg(F.sum("taken")).first()[0] == pytest.approx(120_000, rel=0.01)
    assert df.select(F.md5(F.col("text").cast("binary")).alias("m")).distinct().count() == 3000
    spread = mixing._unit(F.md5(F.col("text").cast("binary")), 1, "shard", 1)
    assert df.select(spread).distinct().count() > 2900


def test_line_dedup_without_broadcast(spark, monkeypatch):
    rows = [(i, "h", f"menu\nbody of page {i} is long enough") for i in range(20)]
    df = spark.createDataFrame(rows, "i int, host string, text string")
    want = sorted(linededup.line_dedup(df, "host").select("i", "text").collect())
    monkeypatch.setattr(linededup, "BROADCAST_LINES", -1)
    assert sorted(linededup.line_dedup(df, "host").select("i", "text").collect()) == want
    assert all("menu" not in r["text"] for r in want)


def test_line_dedup_odd_rows(odd, nothing):
    got = linededup.line_dedup(odd, "source")
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    assert {r["n_lines"] for r in got.where("text IS NULL").collect()} == {0}
    assert linededup.line_dedup(nothing, "source").count() == 0


def plain_seats(votes, seats):
    out = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
        out[i] += 1
    return out


def test_sainte_lague():
    rnd = random.Random(9)
    for _ in range(300):
        votes = [rnd.choice([0, 1, 5, 10, rnd.randint(1, 1000)]) for _ in range(rnd.randint(1, 9))]
        seats = rnd.randint(0, 60)
        assert mixing.sainte_lague(votes, seats) == (plain_seats(votes, seats) if sum(votes) else [0] * len(votes))
    assert mixing.sainte_lague([], 5) == []


def test_targets():
    assert mixing.targets([100, 100], [1, 1], 3) == [100, 100]
    got = mixing.targets([1000, 10, 10], [1, 5, 5], 3)
    assert got == [960, 30, 30]
    assert mixing.targets([0, 0], [1, 2], 3) == [0, 0]


def test_mix(spark):
    rnd = random.Random(10)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "c", None]), " ".join(["w"] * rnd.randint(0, 300))) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    run = lambda: sorted(map(tuple, mixing.mix(df, "id", "source", "text", mix_weight).select("id", "size", "taken", "target").collect()))
    got = run()
    assert got == run()
    size = {i: len(t.split()) for i, _, t in rows}
    taken, goal = defaultdict(int), {}
    for i, s, k, g in got:
        assert s == size[i] and 0 <= k <= 3 * s
        taken[rows[i][1]] += k
        goal[rows[i][1]] = g
    own = defaultdict(int)
    for i, s, _ in rows:
        own[s] += size[i]
    names = sorted(own, key=lambda s: (s is None, s or ""))
    want = mixing.targets([own[s] for s in names], [mix_weight(k, s) for k, s in enumerate(names)], 3)
    for s, w in zip(names, want, strict=True):
        assert goal[s] == pytest.approx(w) and abs(taken[s] - w) <= 64


def test_mix_odd_rows(odd, nothing):
    got = mixing.mix(odd, "doc_id", "source", "text", mix_weight)
    rows = got.collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(got.columns)
    assert all(r["taken"] <= 3 * r["size"] for r in rows) and all(r["size"] == 0 for r in rows if r["text"] is None)
    assert mixing.mix(nothing, "doc_id", "source", "text", mix_weight).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, "doc_id", "source", "text", mix_weight, max_sources=1)
    blank = odd.withColumn("text", F.lit(None).cast("string"))
    assert {(r["target"], r["taken"]) for r in mixing.mix(blank, "doc_id", "source", "text", mix_weight).collect()} == {(0.0, 0)}


@pytest.mark.parametrize("name", ["op1_line_dedup", "op8_mixing"])
def test_query(name, compare):
    compare(queries.QUERIES[name], queries.ORACLE[name])


def test_pipeline_drops_boilerplate_from_every_document_with_a_line_of_its_own(spark):
    import corpus_pipeline

    passage = "a passage that many short documents of the site carry, much longer than their own text"
    texts = [f"{passage}\nown {i}" for i in range(12)] + [passage, f"{passage}\n \n{passage}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert [got[i] for i in range(12)] == [f"own {i}" for i in range(12)]
    # nothing but boilerplate: copies, for near-dedup
    assert [got[12], got[13]] == texts[12:]
