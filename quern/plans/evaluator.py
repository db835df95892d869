"""The evaluator: a saved bundle against a golden set, one row of measures a mode.

``python -m quern.plans.evaluator BUNDLE GOLDEN [--mode ...] [--top-k 10] [--rerank]`` prints them as JSON lines.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import embedding, evaluation, ranking, rerank
from quern.plans.retriever import Retriever
from quern.sources.golden import read_golden

MODES = ("vector", "keyword", "hybrid")


def numbered(golden: DataFrame) -> DataFrame:
    """The golden queries with ``query_id``, their place in the order of their columns; a repeated row counts each time.

    A set is at most as large as a query set may be, which is counted first.
    """
    if golden.limit(ranking.MAX_QUERIES + 1).count() > ranking.MAX_QUERIES:
        raise ValueError(f"more than {ranking.MAX_QUERIES} queries at once")
    order = Window.orderBy("query", "expected_files", "expected_publications")
    return golden.withColumn("query_id", F.row_number().over(order) - 1)


def measure(over: Retriever, asked: DataFrame, golden: DataFrame, modes: Sequence[str] = MODES, top_k: int = 10, rerank_hits: bool = False, dim: int | None = None) -> DataFrame:
    """A row for each mode: mode, num_queries, top_k, reranked, means and deviations of the measures.

    ``golden`` has the ``query_id`` of ``asked``. With ``rerank_hits`` the retriever's scorer orders
    the first hundred hits anew. An empty set measures nothing: no queries, means of 0.
    """
    if unknown := set(modes) - set(MODES):
        raise ValueError(f"unknown mode: {', '.join(sorted(unknown))}")
    if not modes or top_k < 1:
        raise ValueError("at least one mode and one hit")
    if rerank_hits and over.scorer is None:
        raise ValueError("no scorer to rerank with")
    asked = ranking.prepared(asked)  # counted and worked out once for all modes
    texts = None if over.texts is None else over.texts.select("id", "text")
    rows = None
    for mode in modes:
        hits = ranking.evaluate_search(over.chunks, asked, None if mode == "vector" else over.index, rerank.CANDIDATES if rerank_hits else top_k, mode, dim)
        if rerank_hits:
            hits = rerank.rerank(ranking.with_texts(hits, texts), asked, over.scorer, top_k)
        one = evaluation.summary(evaluation.per_query(hits, golden, top_k))
        told = one.select(F.lit(mode).alias("mode"), "num_queries", F.lit(top_k).alias("top_k"), F.lit(rerank_hits).alias("reranked"), *one.columns[1:])
        rows = told if rows is None else rows.unionByName(told)
    return rows


def evaluate(over: Retriever, golden: DataFrame, modes: Sequence[str] = MODES, top_k: int = 10, rerank_hits: bool = False, dim: int | None = None) -> DataFrame:
    """:func:`measure` for a golden set (query, expected_files, expected_publications), whose queries the retriever's model embeds."""
    held = numbered(golden)
    texts = [r["query"] for r in held.orderBy("query_id").select("query").collect()]
    return measure(over, over.queries(texts), held, modes, top_k, rerank_hits, dim)


def main(spark: SparkSession, arguments: list[str] | None = None, model: embedding.Model | None = None, scorer: Callable[[], rerank.Scorer] | None = None) -> list[dict]:
    """The command: opens the bundle, reads the golden set, prints and returns the rows.

    Models are ONNX files named on the command line, or given by the caller; where there are none, the
    hashing model of the bundle's dimension and the word-overlap scorer stand in.
    """
    takes = argparse.ArgumentParser(prog="evaluator", description="Precision and reciprocal ranks of a bundle over a golden set.")
    takes.add_argument("bundle")
    takes.add_argument("golden")
    takes.add_argument("--mode", action="append", choices=MODES, help="may be repeated; all of them by default")
    takes.add_argument("--top-k", type=int, default=10)
    takes.add_argument("--rerank", action="store_true")
    for name in ("model", "scorer"):
        takes.add_argument(f"--{name}", nargs=2, metavar=("ONNX", "TOKENIZER"))
    said = takes.parse_args(arguments)
    if said.scorer:
        scorer = lambda: rerank.onnx_scorer(*said.scorer)
    over = Retriever.open(spark, said.bundle, model, scorer or rerank.overlap_scorer)
    try:
        if said.model:
            over.model = embedding.onnx_model(*said.model)
        elif model is None:
            over.model = embedding.hashing_model(int(over.get_bundle_info().get("embedding_dim") or 64))
        rows = [r.asDict() for r in evaluate(over, read_golden(spark, said.golden), said.mode or MODES, said.top_k, said.rerank).collect()]
    finally:
        over.close()
    for row in rows:
        print(json.dumps(row))
    return rows


if __name__ == "__main__":
    from quern.session import session

    main(session())
