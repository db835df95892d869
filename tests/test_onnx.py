"""The ONNX paths, run with models small enough to be written here byte by byte."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import embedding, rerank

WORDS = ["[PAD]", "[UNK]", "[SEP]", "red", "green", "blue", "stone", "leaf"]
TABLE = np.arange(len(WORDS) * 3, dtype=np.float32).reshape(-1, 3) % 7 - 2


def field(number, value):
    """One protocol buffer field: whole number, or bytes with their length."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def node(kind, inputs, output, **attributes):
    body = b"".join(field(1, i) for i in inputs) + field(2, output) + field(4, kind)
    for name, value in attributes.items():
        held = b"".join(field(8, v) for v in value) + field(20, 7) if isinstance(value, list) else field(3, value) + field(20, 2)
        body += field(5, field(1, name) + held)
    return field(1, body)


def told(number, name, kind, dims):
    shape = b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims)
    return field(number, field(1, name) + field(2, field(1, field(1, kind) + field(2, shape))))


def model(nodes, inputs, output, dims):
    table = b"".join(field(1, d) for d in TABLE.shape) + field(2, 1) + field(8, "table") + field(9, struct.pack(f"<{TABLE.size}f", *TABLE.ravel()))
    graph = b"".join(nodes) + field(2, "g") + field(5, table) + b"".join(told(11, i, 7, ["b", "s"]) for i in inputs) + told(12, output, 1, dims)
    return field(1, 8) + field(8, field(1, "") + field(2, 13)) + field(7, graph)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    from tokenizers import Tokenizer, models, pre_tokenizers

    folder = tmp_path_factory.mktemp("onnx")
    tok = Tokenizer(models.WordLevel({w: i for i, w in enumerate(WORDS)}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    tok.save(f"{folder}/tok.json")
    hidden = [node("Gather", ["table", "input_ids"], "hidden", axis=0)]
    (folder / "embed.onnx").write_bytes(model(hidden, ["input_ids"], "hidden", ["b", "s", 3]))
    # a pair's logit: the greatest cell of all its words' rows
    top = [*hidden, node("ReduceMax", ["hidden"], "logit", axes=[1, 2], keepdims=0)]
    (folder / "cross.onnx").write_bytes(model(top, ["input_ids"], "logit", ["b"]))
    return folder


def test_embedding(spark, files):
    texts = ["red leaf", "blue", "green green stone", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    path, tok = f"{files}/embed.onnx", f"{files}/tok.json"
    got = {r["i"]: r["embedding"] for r in embedding.embed(df, lambda: embedding.onnx_model(path, tok), 3).collect()}
    for i, x in enumerate(texts):
        rows = np.array([TABLE[WORDS.index(w)] for w in x.split()]).reshape(-1, 3)
        mean = rows.mean(axis=0) if len(rows) else np.zeros(3)
        assert np.allclose(got[i], mean / max(np.linalg.norm(mean), 1e-12), atol=1e-6)


def test_rerank(spark, files):
    hits = spark.createDataFrame([(0, k + 1, x, 0.5) for k, x in enumerate(["red", "stone leaf", "blue green", "leaf"])], "query_id int, rank int, text string, score double")
    queries = spark.createDataFrame([(0, "red", [0.0])], "query_id int, query string, vector array<double>")
    path, tok = f"{files}/cross.onnx", f"{files}/tok.json"
    got = rerank.rerank(hits, queries, lambda: rerank.onnx_scorer(path, tok), 3).orderBy("rank").collect()
    top = lambda x: max(TABLE[WORDS.index(w)].max() for w in ["red", "[SEP]", *x.split()])
    want = sorted(enumerate(["red", "stone leaf", "blue green", "leaf"]), key=lambda kx: (-top(kx[1]), kx[0]))[:3]
    assert [(r["text"], r["score"]) for r in got] == [(x, top(x)) for _, x in want] and all(r["reranked"] for r in got)
    assert hits.select(F.max("rank")).first()[0] == 4
