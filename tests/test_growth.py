"""What a task holds and what is shuffled does not grow faster than the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import queries as library
from quern.functions.text import tokenize
from quern.operators import chunking, embedding, lexical


@pytest.fixture
def texts(spark):
    rnd = np.random.default_rng(3)
    return spark.createDataFrame([(i, "Every WördKB " + " ".join(rnd.choice(["oat", "r#y_e", "FIG", "日本x"], size=int(rnd.integers(0, 9))))) for i in range(3000)], "id long, text string")


@pytest.mark.parametrize("held", [lexical.HELD if hasattr(lexical, "HELD") else 0, 500])
def test_a_block_holds_a_group_and_all_postings(spark, texts, monkeypatch, held):
    monkeypatch.setattr(lexical, "HELD", held)
    monkeypatch.setattr(lexical, "GIVEN", 100)
    blocks = lexical.build_index(texts, {"text": F.col("text")}).blocks
    got = {(r["term"], r["id"], r["tf"], r["dl"]) for r in blocks.select("term", F.inline(lexical.zipped())).collect()}
    tokens = texts.select("id", tokenize(F.col("text")).alias("ts"))
    want = tokens.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("term", "id", "dl").count().collect()
    assert got == {(r["term"], r["id"], r["count"], r["dl"]) for r in want}
    if held > 500:
        assert blocks.where("term = 'every'").count() <= 16  # not one for every eight rows


def test_tasks_grow_with_the_rows(spark, texts, monkeypatch):
    monkeypatch.setattr(lexical, "SLAB", 500)
    few, many = (lexical.build_index(texts.where(f"id < {n}"), {"text": F.col("text")}).blocks.rdd.getNumPartitions() for n in (500, 3000))
    assert many == 6 * few


def _no(*_, **__):
    raise AssertionError("a search by vectors writes no index, no texts")


@pytest.mark.parametrize("name", ["vector_candidates", "code_search", "rerank_topk", "hybrid_pool", "hybrid_tagged_search"])
def test_vector_searches_write_no_texts(spark, sf_dir, monkeypatch, name):
    index = library.doc_index(spark, sf_dir)
    monkeypatch.setattr(library, "doc_index", (lambda *_: index) if name.startswith("hybrid") else _no)
    for other in ("search_bundle", "vector_chunks"):
        monkeypatch.setattr(library, other, _no)
    assert library.QUERIES[name](spark, sf_dir).count() > 0
    kind = {"chunks": library.tagged_chunks, "kind": "tagged-vectors"} if "tagged" in name else {}
    assert "text" not in library.vectored(spark, sf_dir, **kind).columns


def test_embedding_gives_out_a_batch_at_a_time(spark):
    rows = spark.createDataFrame([(i, None if i % 50 == 0 else f"w{i}") for i in range(100)], "id long, text string").coalesce(1)
    out = embedding.embed(rows, lambda: lambda texts: np.full((len(texts), 2), len(texts), np.float32), 2, batch=32)
    assert sorted(r["embedding"][0] for r in out.collect()) == [4.0] * 4 + [32.0] * 96
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()  # no frame of a whole batch of Spark's


def test_siblings_of_a_large_folder_are_no_task_s_alone(spark):
    files = spark.range(3000).select(F.lit("p").alias("publication"), F.concat(F.lit("big/n"), "id", F.lit(".md")).alias("file"), F.lit("## H\ntext").alias("text"))
    for tagged in (chunking.cluster_tags(files), chunking.chunk_table(files)):
        told = tagged.select("file", "cluster_tags", F.spark_partition_id().alias("task")).collect()
        stems = sorted(f"n{i}" for i in range(3000))
        assert len(told) == 3000 and all(r["cluster_tags"] == " ".join(s for s in stems if f"big/{s}.md" != r["file"]) for r in told)
        tasks = [r["task"] for r in told]
        assert len(set(tasks)) > 1 and max(map(tasks.count, set(tasks))) < 2500


@pytest.mark.parametrize("files, parts", [(256, 64), (2, 3), (1, 1)])
def test_siblings_of_odd_names(spark, monkeypatch, files, parts):
    """Stems with spaces, inside others, of no letters, beyond ASCII, of two files; repeated rows, nulls, files alone."""
    if hasattr(chunking, "PARTS"):
        monkeypatch.setattr(chunking, "PART_FILES", files)
        monkeypatch.setattr(chunking, "PARTS", parts)
    names = ["a/a.md", "a/a b.md", "a/b.md", "a/b b.md", "a/ab.md", "a/ab.txt", "a/é.md", "a/日本.md", "a/.md", "a/", "a/ .md", "a/z.y.md", "top.md", "", "e/", "e/x.md", "lone/a.md", "a/deep/a.md"]
    rows = [(p, f) for p in ("p", "q é") for f in names] + [("p", "a/a.md"), ("p", None), (None, "a/a.md"), ("s", "only.md")]
    got = chunking.cluster_tags(spark.createDataFrame(rows, "publication string, file string")).collect()

    def split(file):
        folder, _, name = file.rpartition("/")
        stem = name[: name.rfind(".")] if name.rfind(".") > 0 else name
        return folder, stem

    whole = {(p, f) for p, f in rows if p is not None and f is not None}
    want = {(p, f): " ".join(sorted({split(g)[1] for q, g in whole if (q, split(g)[0]) == (p, split(f)[0])} - {split(f)[1]})) for p, f in whole}
    assert len(got) == len(want) and {(r["publication"], r["file"]): r["cluster_tags"] for r in got} == want


def test_whole_tags_are_written_small(spark, tmp_path):
    files = spark.range(3000).select(F.lit("p").alias("publication"), F.concat(F.lit("big/n"), "id", F.lit(".md")).alias("file"))
    chunking.write_tags(files, str(tmp_path / "tags"))
    stems = sorted(f"n{i}" for i in range(3000))
    got = {r["file"]: r["cluster_tags"] for r in spark.read.parquet(str(tmp_path / "tags")).collect()}
    assert got == {f"big/{s}.md": " ".join(x for x in stems if x != s) for s in stems}
    assert 20 * sum(f.stat().st_size for f in (tmp_path / "tags").glob("*.parquet")) < sum(map(len, got.values()))  # snappy leaves over half
