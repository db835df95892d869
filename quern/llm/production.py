"""Production parameters shared by the queries and the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import langid
from quern.llm.common import held_out

#: Labelled rows a class from which the quality rules are learned.
QUALITY_EXAMPLES = 700


def mix_weight(place: int, source: str | None) -> float:
    """Weights 5, 2, 1, repeating over the sources in code-point order."""
    return (5.0, 2.0, 1.0)[place % 3]


def language_model(docs: DataFrame) -> langid.LanguageModel:
    """Learned from the rows of documents that are not held out (crc32 of the id mod 4 is 2)."""
    return langid.learn(docs.select("doc_id", "lang", "text").where(~held_out(F.col("doc_id"), 4, 2)))


def tokenizer_path() -> str:
    """The tokenizer file of the shared tables' contract."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
