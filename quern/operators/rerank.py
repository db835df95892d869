"""Second-stage ranking of candidates by a scorer of (query, text) pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ranking import prepared

Scorer = Callable[[list[str], list[str]], np.ndarray]
CANDIDATES = 100


def overlap_scorer() -> Scorer:
    """Share of the query's words that the text has: a stand-in where no trained model is at hand."""

    def score(queries: list[str], texts: list[str]) -> np.ndarray:
        out = []
        for q, t in zip(queries, texts, strict=True):
            words = set(q.lower().split())
            out.append(len(words & set(t.lower().split())) / len(words) if words else 0.0)
        return np.array(out)

    return score


def onnx_scorer(model_path: str, tokenizer_path: str, max_tokens: int = 512) -> Scorer:
    """A cross-encoder in an ONNX file; one logit a pair, which it reads as one text with a separator between."""
    import onnxruntime
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(tokenizer_path)
    tok.enable_truncation(max_tokens)
    tok.enable_padding()
    run = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])
    takes = {i.name for i in run.get_inputs()}

    def score(queries: list[str], texts: list[str]) -> np.ndarray:
        enc = tok.encode_batch([f"{q} [SEP] {t}" for q, t in zip(queries, texts, strict=True)])
        feed = {"input_ids": [e.ids for e in enc], "attention_mask": [e.attention_mask for e in enc], "token_type_ids": [e.type_ids for e in enc]}
        return run.run(None, {k: np.array(v, np.int64) for k, v in feed.items() if k in takes})[0].reshape(-1)

    return score


def rerank(hits: DataFrame, queries: DataFrame, make: Callable[[], Scorer], top_k: int = 5) -> DataFrame:
    """The best ``top_k`` hits of each query by the scorer, which replaces ``score``; adds ``reranked``.

    Equal scores keep the order of their rank.
    """

    @F.pandas_udf("double")
    def judge(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = make()
        for q, t in pairs:
            yield pd.Series(np.asarray(scorer(q.fillna("").tolist(), t.fillna("").tolist()), float))

    asked = prepared(queries).select("query_id", "query")  # counted: small enough to broadcast
    told = hits.join(F.broadcast(asked), "query_id")
    new = told.withColumn("score", judge("query", "text")).drop("query")
    by = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), F.col("rank"))
    return new.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_k).withColumn("reranked", F.lit(True))
