import re
import time
from collections import Counter

from quern.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics_of_odd_rows(odd, nothing):
    rows = quality.with_statistics(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == plain(r["text"])
    assert quality.with_statistics(nothing).count() == 0


def test_repeats(spark):
    texts = ["a b c d e a b c d e", "a a a a a a a", "a a a a a", "a b c d e x a b c d e f a b c d e f", "w " * 5000]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for r in quality.with_statistics(df).collect():
        assert r["n_repeat_words"] == plain(r["text"])[4]


def test_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in queries.op6_quality(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == len(docs)
    good = 0
    for d in docs:
        r, want = rows[d["doc_id"]], plain(d["text"])
        assert tuple(r[c] for c in COLUMNS) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
        good += d["doc_id"] in labels and not r["base_failed"] and r["kept"] == bool(labels[d["doc_id"]])
    assert good >= 0.95 * sum(i in labels and not rows[i]["base_failed"] for i in rows)


def test_learning():
    bad = [({"a": 0.5 + i / 100, "b": 1.0}, True) for i in range(40)]
    good = [({"a": i / 100, "b": float(i % 3)}, False) for i in range(40)]
    mixed = [x for pair in zip(bad, good, strict=True) for x in pair]
    found = quality.cover(mixed)
    assert found.rules and all(len(r) <= 4 for r in found.rules)
    hit = lambda x: any(quality._holds(r, x) for r in found.rules)
    assert sum(hit(x) == b for x, b in mixed) >= 78
    assert quality.cover([]).rules == [] and quality.cover(good).rules == [] and quality.cover(bad).rules == []


def test_no_labels_keeps_all_that_pass(spark, odd):
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    rules = quality.learn(odd, labels)
    assert rules.rules == []
    assert all(r["kept"] != r["base_failed"] for r in quality.judge(odd, rules).collect())


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op6_quality(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_a_filter_on_the_result_costs_no_more_than_a_few_passes(spark):
    """A filter that Spark pushes below the statistics must not make them again for every word."""
    long = " ".join(f"w{i % 9000}" for i in range(40_000))
    df = spark.createDataFrame([(long,)] * 4, "text string")
    began = time.time()
    got = quality.judge(df, quality.DecisionList()).where("base_failed").select("n_repeat_words").collect()
    assert len(got) == 4 and time.time() - began < 30


def test_repeated_labelled_rows_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "EXAMPLES", 50)
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l")] * 5000 + [(2, "x " * 40)] * 10, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "cover", lambda examples: seen.append(len(examples)) or quality.DecisionList())
    quality.learn(docs, labels)
    assert seen == [50]
