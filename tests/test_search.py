"""Lexical index, ranking, diversity, evaluation, rerank: pinned cases and plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import vectors
from quern.operators import embedding, evaluation, lexical, ranking, rerank
from quern.plans.retriever import Retriever

#: Recipes, notes and programs: two files that several chunks share, a heading that repeats in one, and a chunk without a title.
ROWS = [
    ("r/soup#0", 0, "peel the turnips and boil them in salted broth", "recipes", "r/soup.md", "Method", False, "Turnip soup", "kitchen", "bread"),
    ("r/soup#1", 1, "serve the broth with bread and a spoon of cream", "recipes", "r/soup.md", "Method", False, "Turnip soup", "kitchen", "bread"),
    ("r/soup#2", 2, "turnips keep in a cellar until spring", "recipes", "r/soup.md", "Storage", False, "Turnip soup", "garden", "bread"),
    ("r/bread#0", 3, "knead flour water and salt, let the dough rest", "recipes", "r/bread.md", "Overview", False, "Rye bread", "kitchen", "soup"),
    ("n/tides#0", 4, "the harbour floods when moon and storm meet", "notes", "n/tides.md", "Overview", False, None, "sea", ""),
    ("p/tides#0", 5, "def height(moon, storm): return 2 * moon + storm", "programs", "p/tides.py.md", "Height", True, "Tide heights", "sea", "curves"),
    ("p/curves#0", 6, "for x in range(7): plot(x, height(x, 0))", "programs", "p/curves.md", "Plot", True, "Tide curves", "sea", "tides"),
]
SCHEMA = "id string, ordinal int, text string, publication string, file string, heading string, is_code boolean, title string, product_area string, cluster_tags string"


@pytest.fixture(scope="module")
def retriever(spark):
    model = embedding.hashing_model(32)
    base = spark.createDataFrame(ROWS, SCHEMA).withColumns({"last_updated": F.lit(""), "canonical_url": F.lit("")})
    chunks = embedding.store_precision(embedding.embed(base, lambda: embedding.hashing_model(32), 32))
    fields = {"text": F.col("text"), "title": F.col("title"), "heading": F.col("heading")}
    return Retriever(chunks, lexical.build_index(base, fields, lexical.FIELD_WEIGHTS), model, rerank.overlap_scorer, {"chunk_count": 7})


def every_score(index, queries, docs):
    """Scores with 0 for all other rows: every query meets every row."""
    every = docs.select("id").crossJoin(queries.select("query_id"))
    return every.join(lexical.scores(index, queries), ["query_id", "id"], "left").withColumn("kw", F.coalesce("kw", F.lit(0.0)))


def test_bm25_matches_the_formula(spark):
    texts = {0: "a b b c", 1: "a a d", 2: "", 3: "e f a"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    index = lexical.build_index(df, {"text": F.col("text")})
    queries = spark.createDataFrame([(7, "b a")], "query_id int, query string")
    got = {r["id"]: r["kw"] for r in every_score(index, queries, df).collect()}
    tokens = {i: x.split() for i, x in texts.items()}
    n, avg = len(texts), sum(map(len, tokens.values())) / len(texts)
    df_of = Counter(w for ws in tokens.values() for w in set(ws))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df_of.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    for i, ws in tokens.items():
        want = sum(idf[q] * ws.count(q) * 3 / (ws.count(q) + 2 * (0.3 + 0.7 * len(ws) / avg)) for q in ("a", "b"))
        assert abs(got[i] - want) < 1e-9


def test_empty_query_scores_zero_and_empty_corpus_works(spark):
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    queries = spark.createDataFrame([(0, "...")], "query_id int, query string")
    assert [r["kw"] for r in every_score(lexical.build_index(df, {"t": F.col("text")}), queries, df).collect()] == [0.0]
    blank = spark.createDataFrame([(1, "")], "id int, text string")
    assert lexical.scores(lexical.build_index(blank, {"t": F.col("text")}), queries).count() == 0


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x y"), (2, "y z")], "id int, text string")
    index = lexical.build_index(df, {"t": F.col("text")})
    index.save(str(tmp_path))
    again = lexical.LexicalIndex.load(spark, str(tmp_path))
    assert sorted(map(tuple, again.postings.collect())) == sorted(map(tuple, index.postings.collect()))


@pytest.mark.parametrize("mode", ["vector", "keyword", "hybrid"])
def test_search_modes(retriever, mode):
    rows = retriever.search_docs("height moon storm", mode=mode, top_k=3).orderBy("rank").collect()
    assert 1 <= len(rows) <= 3 and rows[0]["id"] == "p/tides#0"


def test_filters(retriever):
    assert {r["publication"] for r in retriever.search_docs("broth", publication="recipes", min_score=-1.0).collect()} == {"recipes"}
    assert {r["id"] for r in retriever.search_docs("broth", product_area="garden", min_score=-1.0).collect()} == {"r/soup#2"}
    assert {r["is_code"] for r in retriever.search_code("height").collect()} == {True}
    assert retriever.search_docs("broth", publication="nothing").count() == 0
    assert retriever.search_docs("broth", min_score=1.0, mode="vector").count() == 0


def test_hybrid_spreads_over_files_and_headings(retriever):
    rows = retriever.search_docs("turnips broth bread", top_k=3, min_score=-1.0).orderBy("rank").collect()
    assert len({(r["file"], r["heading"]) for r in rows}) == 3


def test_sibling_words_lift_a_row(retriever):
    with_tags = {r["id"]: r["score"] for r in retriever.search_docs("curves", mode="vector", top_k=7, min_score=-1.0).collect()}
    bare = Retriever(retriever.chunks.drop("cluster_tags"), retriever.index, retriever.model)
    without = {r["id"]: r["score"] for r in bare.search_docs("curves", mode="vector", top_k=7, min_score=-1.0).collect()}
    assert {i for i in with_tags if abs(with_tags[i] - without[i]) > 1e-9} == {"p/tides#0"}
    assert with_tags["p/tides#0"] - without["p/tides#0"] == pytest.approx(0.03)


def test_one_batch_with_wordless_queries(retriever):
    batch = retriever.search_docs(["broth", "", "moon"], top_k=2, min_score=-1.0).collect()
    alone = [r for i, q in enumerate(["broth", "", "moon"]) for r in retriever.search_docs(q, top_k=2, min_score=-1.0).collect()]
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in batch) == sorted((i, r["rank"], r["id"]) for i, r in zip([0, 0, 1, 1, 2, 2], alone, strict=True))


def test_nearest_matches_the_column_expression(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, int(rnd.integers(0, 60)), rnd.normal(size=8).round(1).tolist(), str(rnd.choice(["a b", "b", "", "c a"]))) for i in range(500)]
    chunks = spark.createDataFrame(rows, "id long, ordinal long, embedding array<float>, title string").withColumn("norm", vectors.norm(F.col("embedding"), 8))
    queries = spark.createDataFrame([(q, ["a", "b c", ""][q % 3], rnd.normal(size=8).tolist()) for q in range(7)], "query_id long, query string, vector array<double>")
    o = ranking.Options(dim=8)
    plain = ranking.best(ranking.with_scores(chunks.crossJoin(ranking.prepared(queries)), o), "boosted", 11)
    got = ranking.nearest(chunks.repartition(3), queries, 11, o)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.select("query_id", "id").collect()))


@pytest.mark.parametrize("mode", ["vector", "keyword", "hybrid"])
def test_evaluator_ranks_the_whole_corpus(retriever, mode):
    queries = retriever.queries(["broth bread", "moon", "Tide"])
    got = ranking.evaluate_search(retriever.chunks, queries, retriever.index, 3, mode)
    every = ranking.with_scores(retriever.chunks.crossJoin(ranking.prepared(queries)), ranking.Options(), clusters=False)
    every = every.join(lexical.scores(retriever.index, queries), ["query_id", "id"], "left").fillna(0.0, "kw")
    want = {}
    rows = every.collect()
    for r in rows:
        top = max(x["kw"] for x in rows if x["query_id"] == r["query_id"])
        score = {"vector": r["boosted"], "keyword": r["kw"] + r["tb"], "hybrid": 0.6 * r["boosted"] + 0.4 * (r["kw"] / top if top else 0)}[mode]
        want.setdefault(r["query_id"], []).append((-round(score, 6), r["ordinal"], r["id"]))
    assert {(r["query_id"], r["rank"]): r["id"] for r in got.collect()} == {(q, k + 1): x[2] for q, xs in want.items() for k, x in enumerate(sorted(xs)[:3])}


def test_result_columns(retriever):
    assert retriever.search_docs("broth").columns == ["query_id", "rank", *ranking.FIELDS]


def test_bad_options(retriever):
    for bad in ({"mode": "magic"}, {"top_k": 0}, {"top_k": 51}, {"min_score": 2.0}):
        with pytest.raises(ValueError):
            retriever.search_docs("x", **bad)


def test_get_chunk_and_info(retriever):
    assert retriever.get_chunk("r/bread#0").first()["title"] == "Rye bread"
    assert retriever.get_chunk("none").count() == 0
    assert retriever.get_bundle_info() == {"chunk_count": 7}


def test_title_boost_is_case_sensitive_by_default(spark):
    df = spark.createDataFrame([("Rye Bread",), ("rye bread",), (None,)], "t string")
    words = F.array(F.lit("rye"), F.lit("bread"))
    got = [r[0] for r in df.select(ranking.title_boost(F.col("t"), words)).collect()]
    assert got == [0.0, pytest.approx(0.1), 0.0]
    assert df.select(ranking.title_boost(F.col("t"), words, True)).first()[0] == pytest.approx(0.1)


def test_rerank(retriever):
    rows = retriever.search_docs("moon and storm", rerank_hits=True, top_k=2, min_score=-1.0).orderBy("rank").collect()
    assert rows[0]["id"] == "n/tides#0" and all(r["reranked"] for r in rows)


def plain_diverse(pool, k, alpha=0.5):
    chosen, rest = [0], list(range(1, len(pool)))
    while len(chosen) < k and rest:
        lam = math.exp(-alpha * len(chosen))

        def worth(j):
            novelty = 1.0
            for i in chosen:
                if pool[i][1] == pool[j][1]:
                    novelty = min(novelty, 0.0 if pool[i][2] == pool[j][2] else 0.5)
            return round(lam * pool[j][0] + (1 - lam) * novelty, 12)

        best = max(rest, key=lambda j: (worth(j), -j))
        if worth(best) <= -1:
            break
        chosen.append(best)
        rest.remove(best)
    return chosen


def test_diversity_matches_a_plain_version(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for q in range(12):
        pool = sorted(((round(rnd.uniform(-0.5, 1.2), 6), f"f{rnd.randint(0, 5)}", f"h{rnd.randint(0, 2)}") for _ in range(rnd.randint(3, 40))), reverse=True)
        rows += [(q, r + 1, s, f, h, r) for r, (s, f, h) in enumerate(pool)]
        want[q] = plain_diverse(pool, 6) if len(pool) > 6 else list(range(len(pool)))
    df = spark.createDataFrame(rows, "query_id int, rank int, score double, file string, heading string, id int")
    got = {}
    for r in ranking.diverse(df, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == want


def test_evaluation(spark):
    hits = spark.createDataFrame([(0, 1, "a", "p"), (0, 2, "b", "q"), (0, 3, "a", "p"), (1, 1, "x", "p")], "query_id int, rank int, file string, publication string")
    golden = spark.createDataFrame([(0, ["b", "a"], []), (1, ["z"], ["p"]), (2, ["k"], [])], "query_id int, expected_files array<string>, expected_publications array<string>")
    got = {r["query_id"]: (r["precision"], r["mrr"], r["file_mrr"]) for r in evaluation.per_query(hits, golden, 4).collect()}
    assert got == {0: (0.5, 1.0, 1.0), 1: (0.0, 1.0, 0.0), 2: (0.0, 0.0, 0.0)}
    s = evaluation.summary(evaluation.per_query(hits, golden, 4)).first()
    assert s["num_queries"] == 3 and s["std_mrr"] == pytest.approx(np.std([1, 1, 0]))


def test_vector_functions(spark):
    v = spark.createDataFrame([([5.0, -12.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = v.select(vectors.l2_normalize(F.col("a")).alias("u"), vectors.l2_normalize(F.col("z")).alias("z"), vectors.dot(F.col("a"), F.col("a"), 2).alias("d")).first()
    assert r["u"] == [5 / 13, -12 / 13] and r["z"] == [0.0, 0.0] and r["d"] == 169
    m = spark.createDataFrame([([[6.0, 1.0, -2.0], [9.0, 9.0, 9.0], [0.0, 3.0, 2.0], [3.0, 5.0, 3.0]], [1, 0, 1, 1])], "h array<array<double>>, m array<int>")
    assert m.select(vectors.mean_pool(F.col("h"), F.col("m"))).first()[0] == [3.0, 3.0, 1.0]


def test_failing_batches_give_zero_vectors(spark):
    def broken():
        def model(texts):
            raise RuntimeError("no")

        return model

    df = spark.createDataFrame([("x",), (None,)], "text string")
    assert all(r["embedding"] == [0.0] * 4 for r in embedding.embed(df, broken, 4, wait=0.0).collect())
    with pytest.raises(ValueError):
        embedding.store_precision(df, "float8")


def test_words_are_counted_without_every_pair(spark):
    """Words within words, white space of other kinds, nulls and a long text; no query meets every text in the plan."""
    texts = ["The breadboard", "bread and salt", None, "", "ab" * 40_000 + "bread", "SALT and bread\x1cbroth", "éb", *[f"salt{i % 7} x{i}" for i in range(3000)]]
    rows = spark.createDataFrame([(i, i, x) for i, x in enumerate(texts)], "id long, ordinal long, text string")
    queries = spark.createDataFrame([(q, x, [1.0]) for q, x in enumerate(["bread salt", "BROTH board bread", "", "é", "salt3 x2 x29"])], "query_id int, query string, vector array<double>")
    every = rows.crossJoin(ranking.prepared(queries)).withColumn("hits", lexical.fallback(F.col("text"), F.col("query")))
    got = ranking.counted(rows, queries, 9)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ranking.best(every, "hits", 9).select("query_id", "id", "ordinal", "hits").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("few", [True, False])
def test_pooled_rows_keep_their_keyword_scores(spark, monkeypatch, few):
    """A row that the vectors pool has its whole keyword score, whatever ranges the keyword side leaves out."""
    rnd = np.random.default_rng(7)
    rows = [(i, i, " ".join(rnd.choice(["oat", "rye", "fig", "pea"], p=[0.6, 0.3, 0.07, 0.03], size=int(rnd.integers(1, 40)))), rnd.normal(size=4).tolist()) for i in range(1500)]
    chunks = spark.createDataFrame(rows, "id long, ordinal long, text string, embedding array<float>").withColumns({"title": F.lit(""), "norm": vectors.norm(F.col("embedding"), 4)})
    queries = ranking.prepared(spark.createDataFrame([(q, x, rnd.normal(size=4).tolist()) for q, x in enumerate(["pea fig", "rye", "none"])], "query_id long, query string, vector array<double>"))
    index = lexical.build_index(chunks, {"text": F.col("text")})
    monkeypatch.setattr(lexical, "MAX_PAIRS", 0)
    monkeypatch.setattr(lexical, "RANGE", 8)
    if not few:
        monkeypatch.setattr(lexical, "MAX_LITERALS", 0)
        monkeypatch.setattr(lexical, "MAX_BROADCAST", 1)
    got = ranking.pool(chunks, queries, index, ranking.Options(top_k=1, dim=4)).collect()
    want = {(r["query_id"], r["id"]): r["kw"] for r in lexical.scores(index, queries).collect()}
    assert len(got) > 200 and all(r["kw"] == pytest.approx(want.get((r["query_id"], r["id"]), 0.0)) for r in got)


@pytest.mark.parametrize("maxima", [False, True])
def test_first_by_groups_equals_all_scores(spark, monkeypatch, maxima):
    monkeypatch.setattr(lexical, "GROUP", 4)
    rnd = np.random.default_rng(11)
    docs = spark.createDataFrame([(f"d{i}", 400 - i, " ".join(rnd.choice(list("abcdef"), size=int(rnd.integers(0, 9))))) for i in range(400)], "id string, ordinal int, text string")
    queries = spark.createDataFrame([(0, "a b"), (1, "f"), (2, ""), (3, "zz")], "query_id int, query string")
    index = lexical.build_index(docs, {"text": F.col("text"), "more": F.reverse("text")}, {"more": 2.0})
    part = docs.where("ordinal % 3 > 0")
    rows = sorted((r["query_id"], -round(r["kw"], 6), r["ordinal"], r["id"]) for r in every_score(index, queries, part).join(part, "id").collect())
    want = {(q, x[3]) for q in range(4) for x in [r for r in rows if r[0] == q][:7]}
    assert {(r["query_id"], r["id"]) for r in lexical.top(lexical.first(index, queries, part, 7, maxima), 7).collect()} == want


@pytest.mark.parametrize("mode", ["keyword", "hybrid"])
def test_evaluator_sums_no_pairs_in_a_shuffle(retriever, monkeypatch, mode):
    def fails(*_):
        raise AssertionError("every pair of a query and a row with a term is shuffled")

    monkeypatch.setattr(lexical, "scores", fails)
    assert ranking.evaluate_search(retriever.chunks, retriever.queries(["broth", ""]), retriever.index, 3, mode).count() == 6
