"""Every registered query over a folder of odd tables, and over empty ones."""

import pytest

from quern.llm import queries


def write(folder, docs, labels, conversations, pages, embeddings):
    pages.write.parquet(f"{folder}/pages.parquet")
    embeddings.write.parquet(f"{folder}/embeddings.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    conversations.write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folders(spark, odd, tmp_path_factory):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (9, 1, 0), (10, 0, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    talks = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "assistant", "</s>")], "conv_id long, turn long, role string, text string")
    pages = odd.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "n", "kept")
    vectors = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 2), (3, [float("nan"), 1.0], 1), (4, [2.0], 1), (5, [1.0, 1.5], 2), (None, [1.0, 1.0], 1), (6, [1.0, 1.0], None)]
    embeddings = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    tables = odd, labels, talks, pages, embeddings
    return {
        "odd": write(tmp_path_factory.mktemp("odd"), *tables),
        "empty": write(tmp_path_factory.mktemp("empty"), *[t.limit(0) for t in tables]),
    }


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd(name, spark, folders, odd):
    rows = queries.QUERIES[name](spark, folders["odd"]).collect()
    if name == "op10_chat":
        assert {r["conv_id"]: r["n_turns"] for r in rows} == {-7: 2, 1: 3, None: 1}
    elif name == "op12_hard_negatives":
        # row 0 has label 2 here, so row 5 is its positive, and row 4 a negative only of a score between 80 and 100 %
        assert [tuple(r) for r in rows] == []
    elif name != "pipeline":
        assert len(rows) == odd.count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty(name, spark, folders):
    rows = queries.QUERIES[name](spark, folders["empty"]).collect()
    assert len(rows) == (1 if name == "op10_chat" else 0)
