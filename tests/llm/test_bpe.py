import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_fuzz_against_the_library(library):
    rnd = random.Random(zlib.crc32(b"bpe"))
    alphabet = "aAbZé 'strevlmd\n\t\x1c\x1f́　Σσİ1²½ß漢字🙂😀.,!#  ​Ᲊ\x85"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["x <|endoftext|>y<|startoftext|>", "<|endoftext|>", "<|endoftext|", "", "aaaaaaaaaaa'LL", "I'LL DON'T ababababab", "a" * 5000, " ".join("w%d" % i for i in range(30_000))]
    coder = bpe.Encoder(PATH)
    for (raw, said), want in zip(coder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == want.ids
        assert said == library.decode(want.ids, skip_special_tokens=False)


def test_cache_overflow_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    texts = ["one two three four five six one two nine", "nine ten one"]
    got = bpe.Encoder(PATH).encode(texts)
    assert [np.frombuffer(r, "<u4").tolist() for r, _ in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_query(spark, sf_dir, library):
    rows = {r["doc_id"]: r for r in queries.op5_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
        assert tuple(rows[d["doc_id"]][1:]) == want


def test_odd_rows(odd, nothing, library):
    got = bpe.encode(odd, PATH, with_decoded=True)
    rows = got.collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(got.columns)
    for r in rows:
        assert list(r["ids"]) == library.encode(r["text"] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    assert bpe.encode(nothing, PATH).count() == 0
