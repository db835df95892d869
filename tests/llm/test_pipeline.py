import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import mixing, production, queries

from plain import all_pairs, plain_groups, plain_language, plain_lines


def test_stages_match_plain_versions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        new = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert new.columns == columns, name
        seen.append((docs, new))
        docs = new
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    # language: exactly those go that the plain form of the model rejects
    before, after = seen[0]
    model = production.language_model(before)
    told = {r["doc_id"]: plain_language(model, r["text"]) for r in before.collect()}
    assert {r["doc_id"]: r["lang"] for r in after.collect()} == {i: lang for i, (lang, _, rejected) in told.items() if not rejected}
    # lines: no document goes, and its lines are those of the plain version
    before, after = seen[1]
    rows = before.orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in after.collect()}
    for r, text in zip(rows, plain_lines([(r["source"], r["text"]) for r in rows], 0.05, 5, spare=True), strict=True):
        assert got[r["doc_id"]]["text"] == text and got[r["doc_id"]]["n_chars"] == len(text)
    # near duplicates: the least id of each group that all pairs of 0.8 and more make
    before, after = seen[2]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    groups = plain_groups(all_pairs([t for _, t in rows]), len(rows))
    assert ids(after) == Counter(rows[g][0] for g in set(groups))
    # mix: what the mix takes, in whole documents; what a line has left over is less than one document
    before, after = seen[3]
    mixed = mixing.mix(before, "doc_id", "source", "text", production.mix_weight).collect()
    copies, line = ids(after), Counter()
    for r in mixed:
        share = r["taken"] / r["size"] if r["size"] else 0
        assert abs(copies[r["doc_id"]] - share) < 1
        line[r["source"], r["size"].bit_length()] += copies[r["doc_id"]] - share
    assert all(abs(v) <= 1 + 1e-6 for v in line.values()) and set(copies) <= {r["doc_id"] for r in mixed}
    # tokens: as the library has them
    before, after = seen[4]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding(), t.no_truncation()
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert ids(before) == ids(after)
    for r in after.collect():
        want = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert list(r["ids"]) == want and r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_stages_leave_nothing_behind_but_the_result(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda _: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [p.name for p in tmp_path.glob("pipeline-*/*")] == ["4-bpe_encoding"]


def test_run_is_the_same_again(spark, sf_dir):
    run = lambda: sorted((r["doc_id"], r["ids_sha256"]) for r in queries.QUERIES["pipeline"](spark, sf_dir).collect())
    first = run()
    assert first and first == run()


@pytest.mark.parametrize("k", range(5))
def test_odd_rows(spark, odd, nothing, k):
    stage = corpus_pipeline.STAGES[k][1]
    got = stage(spark, odd, "")
    if k < 4:
        assert got.columns == odd.columns
        assert {r["score"] for r in got.collect()} <= {"x"}
    rows = got.count()
    assert rows <= odd.count() * 3
    assert stage(spark, nothing, "").count() == 0
    if k == 2:
        kept = [r["doc_id"] for r in got.collect()]
        assert kept.count(None) == 2 and kept.count(4) == 1 and 5 not in kept


def test_mix_takes_long_documents_as_often_as_short_ones(spark):
    rows = [(i, " ".join(["w"] * (6000 if i % 4 == 0 else 50)), "en", "abc"[i % 3], 0) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    copies = Counter(r["doc_id"] for r in corpus_pipeline.source_mix(spark, docs, "").select("doc_id").collect())
    target = {r["source"]: r["target"] for r in mixing.mix(docs, "doc_id", "source", "text", production.mix_weight).select("source", "target").distinct().collect()}
    for s in "abc":
        own = [(i, 6000 if i % 4 == 0 else 50) for i, _, _, source, _ in rows if source == s]
        rate = target[s] / sum(n for _, n in own)
        assert abs(sum(copies[i] * n for i, n in own) / target[s] - 1) < 0.2
        for size in (50, 6000):
            mean = np.mean([copies[i] for i, n in own if n == size])
            assert abs(mean - rate) < 0.2 * max(rate, 0.5), (s, size, mean, rate)


def test_near_dedup_tells_rows_of_one_id_or_none_apart(spark):
    text = lambda s: " ".join(f"{s}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("b")), (1, text("b")), (2, text("b")), (None, text("c")), (None, text("c")), (None, text("a")), (3, text("d"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"][0]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == Counter([(1, "a"), (1, "b"), (None, "c"), (3, "d")])


def test_near_dedup_tells_rows_apart_by_every_cell(spark):
    text = lambda s: " ".join(f"{s}{i}" for i in range(40))
    # a value in one column is not the same value in another; a column of maps, and columns with names of the stage's own
    rows = [(1, "en", None, {"a": 1}, "mine"), (1, None, "en", {"a": 1}, "mine"), (2, text("b"), "en", {"a": 2}, "mine"), (2, text("b"), "en", {"a": 2}, "mine"), (3, text("b") + " more", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, m map<string, int>, __row string").withColumn("__node", F.lit("own"))
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"], r["text"] or "", r["lang"] or "", r["__row"], r["__node"]) for r in got.collect())
    assert kept == sorted([(1, "en", "", "mine", "own"), (1, "", "en", "mine", "own"), (2, text("b"), "en", "mine", "own")])
