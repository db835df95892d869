import random

import numpy as np

from quern.llm import similar
from quern.llm.simhash import fingerprint, shingle_hashes

from plain import all_pairs, jaccard, plain_groups


def corpus(seed=1):
    """Unrelated texts, and copies of some of them with more and more words changed."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(150):
        base = [word() for _ in range(rnd.randint(80, 400))]
        if i % 5 == 0:
            base[20:20] = passage
        texts.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 3])):
            ws = list(base)
            for _ in range(rnd.randint(1, max(1, len(ws) // 30))):
                ws[rnd.randrange(len(ws))] = word()
            texts.append(" ".join(ws))
    return texts


def test_groups_are_those_of_all_pairs_at_any_shard_size(spark):
    texts = corpus()
    j = all_pairs(texts)
    assert sum(v >= 0.8 for v in j.values()) > 30
    want = plain_groups(j, len(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for shard_rows in (512, 5):
        got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(df, shard_rows=shard_rows).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_a_hot_shard_of_near_copies(spark):
    """A third of all texts are near copies of one; parts of 20 and whole shards give the groups of all pairs."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    base = [word() for _ in range(600)]
    texts = []
    for i in range(360):
        ws = list(base) if i % 3 == 0 else [word() for _ in range(120)]
        for _ in range(rnd.randint(0, 6)):
            ws[rnd.randrange(len(ws))] = word()
        texts.append(" ".join(ws))
    want = plain_groups(all_pairs(texts), len(texts))
    assert sum(w == 0 for w in want) > 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for shard_rows in (2048, 20):
        got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(df, shard_rows=shard_rows).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_repeats_do_not_make_unlike_texts_alike(spark):
    """Over half of all shingles are one shingle, so SimHash of all repeats is the same; the sets differ."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    ruler = "= " * 100
    texts = [ruler + " ".join(word() for _ in range(60)) for _ in range(2)]
    texts += [texts[0], texts[0] + " end", ruler, ruler + "= " * 50]
    assert fingerprint(texts[0], 5) == fingerprint(texts[1], 5) and jaccard(*(np.unique(shingle_hashes(t, 5)) for t in texts[:2])) < 0.01
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(df).collect()}
    assert [got[i] for i in range(6)] == [0, 1, 0, 0, 4, 4]


def test_sketch_estimates_similarity():
    a, b = (shingle_hashes(t, 5) for t in (corpus()[0], corpus()[0] + " and a few more words at the end of it"))
    x, y = (np.frombuffer(similar.sketch(h), np.uint8) for h in (a, b))
    est = np.count_nonzero((x == y) & (x > 0)) / np.count_nonzero(x | y)
    assert abs(est - jaccard(np.unique(a), np.unique(b))) < 0.15
    assert similar.sketch(a[:0]) == bytes(128) and similar.band_keys(a[:0], 3).tolist() == [0, 0, 0]


def test_odd_rows(odd, nothing):
    rows = similar.near_duplicates(odd).collect()
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == odd.count()
    assert {by[i] for i in (0, 1, 2)} == {0} and {by[i] for i in (4, 5, 6)} == {4}
    assert similar.near_duplicates(nothing).count() == 0


def test_pairs_just_above_the_threshold_link_and_those_below_do_not(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    rows, j = [], []
    while len(j) < 400:  # pairs at 0.74 to 0.83, unrelated to each other
        base = [word() for _ in range(rnd.randint(150, 500))]
        copy = list(base)
        for _ in range(max(1, len(base) // 40)):
            copy[rnd.randrange(len(copy))] = word()
        a, b = " ".join(base), " ".join(copy)
        s = jaccard(*(np.unique(shingle_hashes(t, 5)) for t in (a, b)))
        if 0.74 <= s < 0.83:
            rows += [(2 * len(j), a), (2 * len(j) + 1, b)]
            j.append(s)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(df).collect()}
    linked, s = np.array([got[2 * k] == got[2 * k + 1] for k in range(len(j))]), np.array(j)
    for low, high in ((0.8, 0.81), (0.81, 0.82), (0.82, 0.83)):
        band = (s >= low) & (s < high)
        assert band.sum() > 15 and linked[band].mean() >= 0.98, (low, linked[band].mean())
    assert (s < 0.8).sum() > 80 and not linked[s < 0.8].any()
