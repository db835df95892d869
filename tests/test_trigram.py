"""Text search through the trigram index gives the rows of the plain search."""

import random
import re

import pytest

from quern.operators import catalog, trigram

PATTERNS = [r"ab+c", r"(abc|bcd)x?", r"a.c", r"[ab]c[ab]{2}", r"abc{2,}", r"(?i)ABC", r"^abc", r"c$", r"(ab){3}", r"abc|", r"\bca\b", r"[^a]bc", r"a(?=bc)bca", r"(a|b|c)(a|b|c)cc", r"x{9}", r"\d{3}", r"(", r"[a-c]{3}-[0-9]", r"(?:abc)?cba", r"a\.b", r"[a&&b]bc", r"(ab(c|d))+"]
LITERALS = ["abc", "ab", "abcab", "é☃a", "--", "a\nb", "", "zzzz", "(ab"]


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcabc \n-x9é☃(.") for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    return spark.createDataFrame([(f"p{i % 7}", f"f{i}.md", t) for i, t in enumerate(texts)] + [("p0", "null.md", None)], "publication string, file string, text string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, files, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("grams"))
    trigram.build(files, folder)
    return trigram.TrigramIndex.load(spark, folder)


def test_every_match_satisfies_its_plan(files):
    texts = [r["text"] or "" for r in files.collect()]
    for pattern in PATTERNS:
        try:
            compiled = re.compile(pattern)
        except re.error:
            continue
        for clause in trigram.plan(pattern, regex=True):
            assert all(any(g in t for g in clause) for t in texts if any(compiled.search(line) for line in t.split("\n"))), pattern
    assert trigram.plan("[0-9]{3}-", regex=True) and trigram.plan("needle-[ab]", regex=True)[0] == {"nee"}
    assert trigram.plan("(?i)abc", regex=True) == [] == trigram.plan("a.b", regex=True) == trigram.plan("ab")


@pytest.mark.parametrize(("query", "regex"), [(p, True) for p in ("(abc|bcd)x", "[a-c]{3}-[0-9]", "a.c", "(", "(ab){3}")] + [(x, False) for x in ("abc", "ab", "é☃a", "zzzz", "")])
def test_same_rows(files, index, query, regex):
    got = index.search(files, query, "p1", regex, None)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, catalog.search_text(files, query, "p1", regex, None).collect()))


def test_few_files_are_checked(files, index):
    texts = [r["text"] or "" for r in files.collect()]
    assert index.matching(files, "abcab").count() == sum(all("abcab"[i : i + 3] in t for i in range(3)) for t in texts) < 60
    plan = index.candidates([{"abc"}])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "gram" in plan.split("PushedFilters")[1]
    with pytest.raises(FileNotFoundError):
        index.search(files, "abc", "none")


def test_a_folder_of_the_index_is_sorted_by_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    files = spark.range(300).select(F.lit("p").alias("publication"), F.col("id").cast("string").alias("file"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        trigram.build(files, str(tmp_path / "index"))
    finally:
        spark.conf.unset(name)
    assert max(len(list(f.glob("*.parquet"))) for f in (tmp_path / "index").glob("bucket=*")) > 1
