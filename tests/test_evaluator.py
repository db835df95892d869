"""The evaluator over a saved bundle, against measures worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import bundle, embedding, lexical, ranking, rerank
from quern.plans import evaluator
from quern.plans.retriever import Retriever

TEXTS = {"oak": "oak trees grow tall and oak wood is hard", "elm": "elm trees line the street", "tide": "the tide rises and falls with the moon", "moon": "the moon pulls the tide twice a day", "ash": "ash trees burn well", "fir": "fir trees stay green"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(f"{k}#0", i, t, "trees" if "trees" in t else "sea", f"{k}.md", "Overview", False, k, "", "", "") for i, (k, t) in enumerate(TEXTS.items())]
    chunks = spark.createDataFrame(rows, "id string, ordinal long, text string, publication string, file string, heading string, is_code boolean, title string, product_area string, canonical_url string, last_updated string")
    whole = embedding.store_precision(embedding.embed(chunks, lambda: embedding.hashing_model(64), 64))
    index = lexical.build_index(chunks, {"text": F.col("text")}, {"text": 1.0})
    where = str(tmp_path_factory.mktemp("evaluated") / "bundle")
    bundle.write(where, whole.drop("embedding", "norm"), index, whole.select("id", "embedding", "norm"), {"repo": "woods"})
    return where


def golden_file(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_command_measures_all_modes(spark, folder, tmp_path, capsys):
    rows = [{"query": "oak wood", "expected_files": ["oak.md"]}, {"query": "tide", "expected_files": ["moon.md", "tide.md"]}, {"query": "elm", "expected_publications": ["trees"]}, {"query": "elm", "expected_publications": ["trees"]}]
    got = evaluator.main(spark, [folder, golden_file(tmp_path / "g.jsonl", rows), "--top-k", "2"])
    assert [r["mode"] for r in got] == ["vector", "keyword", "hybrid"] and {r["num_queries"] for r in got} == {4} and {r["top_k"] for r in got} == {2} and not any(r["reranked"] for r in got)
    keyword = got[1]
    assert keyword["mean_precision"] == pytest.approx((0.5 + 1.0) / 4) and keyword["mean_mrr"] == 1.0 and keyword["mean_file_mrr"] == 0.5
    assert [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")] == got


def test_reranked_and_single_mode(spark, folder, tmp_path):
    got = evaluator.main(spark, [folder, golden_file(tmp_path / "g.jsonl", [{"query": "moon pulls", "expected_files": ["moon.md"]}]), "--mode", "vector", "--top-k", "1", "--rerank"])
    assert [(r["mode"], r["reranked"], r["mean_precision"], r["mean_mrr"]) for r in got] == [("vector", True, 1.0, 1.0)]


def test_odd_requests(spark, folder):
    over = Retriever.open(spark, folder, embedding.hashing_model(64), keep=False)
    empty = spark.createDataFrame([], "query string, expected_files array<string>, expected_publications array<string>")
    got = evaluator.evaluate(over, empty).collect()
    assert [(r["num_queries"], r["mean_mrr"], r["std_mrr"]) for r in got] == [(0, 0.0, 0.0)] * 3
    one = spark.createDataFrame([("oak", ["oak.md"], [])], empty.schema)
    for wrong in ({"modes": ["fuzzy"]}, {"modes": []}, {"top_k": 0}, {"rerank_hits": True}):
        with pytest.raises(ValueError):
            evaluator.evaluate(over, one, **wrong)
    bare = Retriever(over.chunks, None, over.model, rerank.overlap_scorer, None, over.texts)
    with pytest.raises(ValueError):
        evaluator.evaluate(bare, one, ["keyword"])
    assert evaluator.evaluate(bare, one, ["vector"], 1).first()["mean_precision"] == 1.0


def test_titles_rank_without_vectors(spark):
    """Rows by title boost alone, as a product with all titles gives them, also rows without a vector."""
    rows = [(i, i, t, None) for i, t in enumerate(["red fox", "fox", None, "the red red fox", "", "blue\nfox", "red"])]
    chunks = spark.createDataFrame(rows, "id int, ordinal int, title string, embedding array<float>")
    asked = spark.createDataFrame([(0, "red fox", None), (1, "FOX", None), (2, "", None)], "query_id int, query string, vector array<double>")
    got = {(r["query_id"], r["id"]) for r in ranking.nearest(chunks, asked, 3, ranking.Options(), clusters=False, by_vector=False).collect()}
    assert got == {(0, 0), (0, 3), (0, 1), (1, 0), (1, 1), (1, 3), (2, 0), (2, 1), (2, 2)}
