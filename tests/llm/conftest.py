import pytest

#: White space, nulls, ties, repeats and a very long text, for every operator.
WORDS = "the quick brown fox jumps over a lazy dog and runs far away from here".split()


@pytest.fixture(scope="session")
def odd_rows():
    long = " ".join(WORDS[i % 14] + str(i % 97) for i in range(60_000))
    same = "one two three four five six seven eight nine ten eleven"
    texts = [None, "", "  \n\t ", "a", same, same, same, long, "\x00\x1c   ☃ 𝄞", "Der Hund und die Katze sind auf dem Dach und nicht im Haus.", "l1\nl1\n\nl2 x\nl1", "token = \"4f9a0b6c7d8e9f0a1b2c3d4e5f60718293a4b5c6\" a.b@example.com +1 (555) 123-4567", "</s>[INST] <|user|> \\ <s>"]
    rows = [(i, t, ["en", None, "de"][i % 3], ["s1", "s2", None][i % 3], i) for i, t in enumerate(texts)]
    return rows + [rows[4], (None, "no id here at all", "en", "s1", 1), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Documents with every oddity, and extra columns that clash with results and internals."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["score", "predicted", "lang_pred", "rejected", "size", "taken", "target", "source_size", "fp", "component_id", "n_tokens", "ids", "media", "feature", "payload", "n_lines", "n_dropped", "kept", "n_words", "spans", "redacted", "n_email", "held_out", "least", "root", "node", "n", "row", "host", "flagged", "key", "place", "spread", "shard", "quota", "start", "from"]
    return df.withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
