"""Embedding columns: models as vectorised functions, a hashing model, storage precision."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.vectors import norm

Model = Callable[[list[str]], np.ndarray]


def hashing_model(dim: int = 64) -> Model:
    """Signed hashed word counts, of length 1: a stand-in where no trained model is at hand."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for token in re.findall(r"[a-zA-Z0-9_#]+", text.lower()):
                h = hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()
                out[i, int(h[:8], 16) % dim] += 1 if h[8] > "7" else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def onnx_model(model_path: str, tokenizer_path: str, max_tokens: int = 512) -> Model:
    """A sentence model in an ONNX file: tokens padded and cut, mean of the hidden states, length 1."""
    import onnxruntime
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(tokenizer_path)
    tok.enable_truncation(max_tokens)
    tok.enable_padding()
    run = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])
    takes = {i.name for i in run.get_inputs()}

    def embed(texts: list[str]) -> np.ndarray:
        enc = tok.encode_batch(texts)
        ids, mask = np.array([e.ids for e in enc], np.int64), np.array([e.attention_mask for e in enc], np.int64)
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        hidden = run.run(None, {k: v for k, v in feed.items() if k in takes})[0]
        pooled = (hidden * mask[..., None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1e-9)
        return pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12)

    return embed


def embed(df: DataFrame, make: Callable[[], Model], dim: int, text: str = "text", batch: int = 32, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """Add ``embedding``; a model is made once a task, a batch that keeps failing gives zero vectors. A task holds the texts of one batch as strings at a time."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name != "embedding"], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for rows in (b.slice(at, batch) for b in batches for at in range(0, b.num_rows, batch)):
            texts = [x or "" for x in rows.column(text).to_pylist()]
            vectors = pa.array(_attempt(model, texts, dim, retries, wait).reshape(-1))
            ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in schema.names[:-1]] + [pa.ListArray.from_arrays(ends, vectors)], names=schema.names)

    return df.mapInArrow(run, schema)


def _attempt(model: Model, texts: list[str], dim: int, retries: int, wait: float) -> np.ndarray:
    for k in range(retries):
        try:
            return np.asarray(model(texts), np.float32)
        except Exception:  # whatever a model raises; the batch is tried again, then given up
            if k + 1 < retries:
                time.sleep(wait * 2**k)
    return np.zeros((len(texts), dim), np.float32)


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, arrays or packed halves, as one matrix."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], np.float16)[ends[0] // 2 : ends[-1] // 2].reshape(len(column), -1)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _halves(vectors: pd.Series) -> list[np.ndarray | None]:
    """Each vector rounded to half precision; all of a batch at once."""
    there = vectors.notna().to_numpy()
    ends = np.cumsum([len(v) for v in vectors[there]])
    flat = np.concatenate(list(vectors[there])).astype(np.float16) if there.any() else np.zeros(0, np.float16)
    parts = iter(np.split(flat, ends[:-1]) if len(ends) else [])
    return [next(parts) if t else None for t in there]


def packed(vector: str) -> Column:
    """The vectors of a column as bytes, two a value (half precision)."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else x.tobytes() for x in _halves(v)], dtype=object)

    return pack(vector)


def unpacked(vector: str) -> Column:
    """The vectors of a column of packed halves."""

    @F.pandas_udf("array<float>")
    def unpack(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.frombuffer(x, np.float16).astype(np.float32) for x in v], dtype=object)

    return unpack(vector)


def store_precision(df: DataFrame, kind: str = "float16") -> DataFrame:
    """Round ``embedding`` to its stored precision and add ``norm`` of what is stored."""
    if kind not in ("float16", "float32"):
        raise ValueError(f"unknown precision: {kind}")
    if kind == "float16":

        @F.pandas_udf("array<float>")
        def half(v: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else x.astype(np.float32) for x in _halves(v)], dtype=object)

        df = df.withColumn("embedding", half("embedding"))
    return df.withColumn("norm", norm(F.col("embedding")).cast("float"))
