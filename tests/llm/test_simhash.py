import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quern.llm import components, queries, simhash


def plain_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    p = np.array(prints, np.uint64)
    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= radius).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_trees_find_all_within_the_radius():
    rnd = random.Random(2)
    values = np.array([rnd.getrandbits(16) for _ in range(400)], np.uint64)
    shard = np.array([rnd.randrange(3) for _ in range(400)])
    trees = simhash.BKTrees(values, shard)
    for radius in (0, 3, 20):
        got = sorted((q, hit) for a, b in trees.within(values[:50], radius, shard[:50]) for q, hit in zip(a.tolist(), b.tolist(), strict=True))
        assert got == [(q, i) for q in range(50) for i in range(400) if shard[i] == shard[q] and int(values[i] ^ values[q]).bit_count() <= radius]
    assert not list(simhash.BKTrees(np.zeros(0, np.uint64)).within(values, 3))


def test_a_child_is_keyed_by_its_distance_and_only_edges_in_the_radius_are_followed():
    rnd = random.Random(5)
    values = np.array([rnd.getrandbits(64) for _ in range(2000)], np.uint64)
    trees = simhash.BKTrees(values)
    parent, distance = trees.edge // 65, trees.edge % 65
    for i in range(1, 2000):
        assert int(values[i] ^ values[parent[i]]).bit_count() == distance[i]
    assert len(set(trees.edge.tolist())) == 2000  # no two children of a node at one distance
    assert trees.edge[0] == -1 and (trees.edge[1:] >= 0).all()


def test_connect_and_chains():
    label = np.arange(6)
    simhash.connect(label, np.array([4, 5, 1]), np.array([3, 4, 1]))
    assert label.tolist() == [0, 1, 2, 3, 3, 3]
    a, b = simhash.chains(label, np.array([9, 8, 7, 1, 3, 2]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(2, 1), (3, 2)]


def test_more_runs_for_more_fingerprints():
    assert [simhash.run_count(n, 4, 2048) for n in (0, 10**6, 10**9, 10**11)] == [6, 6, 7, 8]
    for blocks in (6, 7, 8):
        assert all(m.bit_count() >= (64 // blocks) * (blocks - 4) for m in simhash.masks(4, blocks))


def clustered(n, seed):
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(max(1, n // 40))]
    return [c ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 6))) & (1 << 64) - 1 for c in rnd.choices(centres, k=n)]


def test_links_join_what_is_near(spark):
    prints = sorted(set(clustered(1500, 4)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = plain_components(prints, 4)
    for shard_rows, wave_bytes in ((2048, 1 << 20), (7, 1 << 20), (7, 2000)):  # the last two split every larger shard, the last in many waves
        links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 4, shard_rows, wave_bytes)
        for a, b in links.collect():
            assert ((a ^ b) & (1 << 64) - 1) > 0
        roots = {r["node"]: r["root"] for r in components.components(links).collect()}
        groups = {}
        for s, w in zip(signed, want, strict=True):
            groups.setdefault(w, set()).add(roots.get(s, s))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(components, "BROADCAST_LABELS", 0)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 160)} == {100}


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert {got[i] for i in range(301)} == {0} and got[1001] == 1000 and len(got) == 303
    assert components.components(edges.limit(0)).count() == 0


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.op4_simhash(spark, sf_dir).collect()}
    ids = sorted(docs)
    prints = [plain_print(docs[i]) for i in ids]
    assert [rows[i]["fingerprint"] for i in ids] == [f"{p:016x}" for p in prints]
    assert [rows[i]["component_id"] for i in ids] == [ids[r] for r in plain_components(prints, 4)]


def test_odd_rows(odd, nothing):
    got = simhash.near_duplicates(odd)
    rows = got.collect()
    assert len(rows) == odd.count() and set(odd.columns) - {"text"} <= set(got.columns)
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["fp"] == by[1]["fp"] == by[2]["fp"] == 0 and {by[i]["component_id"] for i in (0, 1, 2)} == {0}
    assert {by[i]["component_id"] for i in (4, 5, 6)} == {4}
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_group_of_a_third(spark):
    texts = ["copy of one and the same text again and again"] * 200 + [f"text {i} of its own with number {i * 7} and {i * 13} words" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    want = plain_components([plain_print(t) for t in texts], 4)
    assert [got[i] for i in range(600)] == want
    assert simhash.near_duplicates(df).select(F.max("component_id")).first()[0] < 600
