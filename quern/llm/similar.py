"""SimHash near-duplicates at a given similarity, beyond the few bits that bit runs can find.

Texts are compared as sets of word shingles, and texts of one set are one node from the start.
At a Jaccard similarity of 0.8 the fingerprints of two sets differ in about ten of 64 bits, too
many for shards of agreeing bit runs. So the shards are dealt another way: a set has ``bands``
keys, each made of the two least shingle hashes under two hash functions, and a shard holds the
sets of one key. Sets of similarity s share a key with probability s * s, so at 0.8 all but
0.36 ** bands of the pairs (4 in 100,000) meet in some shard; sets that merely share a passage
rarely do. Each shard is searched with BK-trees: pairs within ``radius`` bits are candidates if
their similarity, estimated from a sketch of ``SKETCH`` hashed shingle classes, is not three
standard errors below the threshold; a pair links if the exact Jaccard similarity of its sets
reaches the threshold. A pair that shares several keys is looked at in the first one's shard.

The sets go only to the shards in which a text has a candidate. There a pair that is joined
already is left out, so a shard gives a forest of links, never all pairs. A set holds 32 bits of
each shingle hash; sets are told apart by 64 bits of a hash of all their shingles.

A shard of more than ``shard_rows`` sets is cut into parts, and each part is searched in the
tree of each earlier part, so no task holds more than two parts and no pair is left out.

Defined results: as for :mod:`quern.llm.simhash`; texts without words are one group, texts of
fewer words than a shingle link if their words are equal; a very long text is hashed in blocks.
Columns named fp, component_id or like the working columns (``__node``, ``__h``, ``__bands``,
``__sketch``) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.llm.common import cut, over_batches, strings
from quern.llm.components import components
from quern.llm.simhash import BKTrees, chains, connect, shingle_hashes, vote

SKETCH = 128
SHARD = ["mask", "part", "tree", "query"]
#: Standard errors of the sketch below the threshold at which a pair is no candidate.
LOOSE = 3.0
#: Sets with candidates up to this many are broadcast to fetch their texts (16 bytes each).
BROADCAST_TEXTS = 200_000
#: Shingles that are hashed for the band keys at a time.
HASHES_AT_ONCE = 1 << 15


def _mixers(n: int) -> np.ndarray:
    """Odd multipliers of the hash family, always the same."""
    return np.random.default_rng(5).integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    x = h * by
    x ^= x >> np.uint64(31)
    return x * np.uint64(0x9E3779B97F4A7C15)


def band_keys(hashes: np.ndarray, bands: int) -> np.ndarray:
    """``bands`` keys, each of two least shingle hashes; zeros without shingles."""
    if not len(hashes):
        return np.zeros(bands, np.int64)
    by, least = _mixers(2 * bands)[:, None], np.full(2 * bands, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        least = np.minimum(least, _mixed(hashes[at : at + HASHES_AT_ONCE], by).min(axis=1))
    return (_mixed(least[::2], np.uint64(0xC2B2AE3D27D4EB4F)) ^ least[1::2]).view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """For each of SKETCH classes of shingles a byte of the class's least hash, 0 for an empty class."""
    out = np.zeros(SKETCH, np.uint8)
    if len(hashes):
        x = np.sort(_mixed(hashes, np.uint64(0xC2B2AE3D27D4EB4F)))
        place, first = np.unique(x % np.uint64(SKETCH), return_index=True)  # the first in order is the least
        out[place.astype(np.int64)] = 1 + (x[first] >> np.uint64(40)) % np.uint64(255)
    return out.tobytes()


#: What a set of shingles gives.
WORKING = [("__node", T.LongType()), ("fp", T.LongType()), ("__bands", T.ArrayType(T.LongType())), ("__sketch", T.BinaryType())]


def with_signature(df: DataFrame, text: str, shingle: int, bands: int) -> DataFrame:
    """Replace ``text`` by what its set of shingles gives: __node (its hash), fp (fingerprint), __bands, __sketch."""
    kept = [f for f in df.schema.fields if f.name not in (text, *dict(WORKING))]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in WORKING]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (np.unique(shingle_hashes(t, shingle)) for t in strings(batch.column(text)))
            rows = [(xxhash.xxh64_intdigest(s.tobytes()), vote(s), band_keys(s, bands), sketch(s)) for s in sets]
            node, fp = (pa.array(np.array([r[k] for r in rows], np.uint64).view(np.int64)) for k in (0, 1))
            keys = pa.ListArray.from_arrays(np.arange(0, bands * len(rows) + 1, bands, dtype=np.int32), np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], node, fp, keys, pa.array([r[3] for r in rows], pa.binary())], names=schema.names)

    return over_batches(df, run, schema)


def _pairs(fp: np.ndarray, left: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), j < i, of pairs within the radius: all of them if ``left`` is all, else those of a later and one of the first ``left``."""
    # sets may share a fingerprint; the tree holds each once
    held, first, group = np.unique(fp[:left], return_index=True, return_inverse=True)
    order = np.argsort(first)  # in the order they came: a sorted list makes a poor tree
    rank = np.empty(len(held), np.int64)
    rank[order] = np.arange(len(held))
    group = rank[group]
    members = np.argsort(group, kind="stable")
    begin = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=len(held)))))
    asked = np.arange(len(fp)) if left == len(fp) else np.arange(left, len(fp))
    for q, hit in BKTrees(held[order]).within(fp[asked], radius, block=256):
        n = begin[hit + 1] - begin[hit]
        ends = np.cumsum(n)
        j = members[np.arange(ends[-1]) + np.repeat(begin[hit] - (ends - n), n)]
        i = asked[np.repeat(q, n)]
        yield (i[j < i], j[j < i]) if left == len(fp) else (i, j)


class Shard:
    """Sets of one shard: fingerprints, earlier band keys and sketches, of which the first ``left`` make the tree."""

    def __init__(self, items: list[dict], left: int, radius: int, similarity: float):
        self.fp = np.array([r["fp"] for r in items], np.int64).view(np.uint64)
        self.earlier = np.array([r["__bands"] for r in items], np.int64).reshape(len(items), -1)
        self.classes = np.frombuffer(b"".join(r["__sketch"] for r in items), np.uint8).reshape(len(items), SKETCH)
        self.left, self.radius, self.similarity = left, radius, similarity

    def candidates(self, skip) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs to confirm, likeliest of a block first; ``skip`` tells of pairs (i, j) which need no look."""
        loose = LOOSE * (self.similarity * (1 - self.similarity)) ** 0.5
        for every in _pairs(self.fp, self.left, self.radius):
            for lo in range(0, len(every[0]), 8192):
                i, j = (x[lo : lo + 8192] for x in every)
                new = ~skip(i, j)
                i, j = i[new], j[new]
                new = ~(self.earlier[i] == self.earlier[j]).any(axis=1)  # else they meet in the shard of that key
                i, j = i[new], j[new]
                a, b = self.classes[i], self.classes[j]
                either = np.maximum(np.count_nonzero(a | b, axis=1), 1)
                over = (np.count_nonzero((a == b) & (a > 0), axis=1) / either - self.similarity) * either**0.5
                order = np.argsort(-over, kind="stable")
                order = order[over[order] >= -loose]
                yield i[order], j[order]

    def members(self) -> np.ndarray:
        """Places of the sets that have a candidate."""
        found = np.zeros(len(self.fp), bool)
        for i, j in self.candidates(lambda i, j: found[i] & found[j]):
            found[i] = found[j] = True
        return np.flatnonzero(found)

    def joined(self, shingles: list[np.ndarray]) -> np.ndarray:
        """A label for each set; those joined by pairs whose sets are similar have the same."""
        label = np.arange(len(self.fp))
        sizes = np.array([len(s) for s in shingles])
        for i, j in self.candidates(lambda i, j: label[i] == label[j]):
            fit = np.minimum(sizes[i], sizes[j]) >= self.similarity * np.maximum(sizes[i], sizes[j])
            for x, y in zip(i[fit].tolist(), j[fit].tolist(), strict=True):
                if label[x] != label[y]:
                    a, b = shingles[x], shingles[y]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if both >= self.similarity * (len(a) + len(b) - both):
                        connect(label, np.array([x]), np.array([y]))
        return label



def proposed(nodes: DataFrame, radius: int, similarity: float, shard_rows: int) -> DataFrame:
    """The members (mask, part, tree, query, left and a node's columns) of shards that have a candidate there."""
    of = F.transform("__bands", lambda v, i: F.struct(i.alias("mask"), v.alias("part")))
    item = [n for n, _ in WORKING]
    earlier = F.slice("__bands", F.lit(1), F.col("k.mask"))  # the keys that come before the shard's own
    sharded = nodes.select(*item, F.explode(of).alias("k")).select(*item, "k.mask", "k.part", earlier.alias("__earlier")).drop("__bands")
    sharded = sharded.withColumnRenamed("__earlier", "__bands").select(*item, "mask", "part")
    hot = cut(sharded.groupBy("mask", "part").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows))
    few = hot.limit(10_001).count()
    if few:
        wide = sharded.join(F.broadcast(hot) if few <= 10_000 else hot, ["mask", "part"], "left")
        n = F.ceil(F.coalesce("n", F.lit(1)) / shard_rows).cast("int")
        own = F.pmod(F.xxhash64("__node"), n).cast("int")
        # a set of part o meets the parts before it as "query" and those after it as "tree"
        others = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.least(i, own).alias("tree"), F.greatest(i, own).alias("query")))
        parts = wide.select(*item, "mask", "part", own.alias("own"), F.explode(others).alias("o"))
        parts = parts.select(*item, "mask", "part", "o.tree", "o.query", (F.col("own") == F.col("o.tree")).alias("left"))
    else:
        parts = sharded.select(*item, "mask", "part", F.lit(0).alias("tree"), F.lit(0).alias("query"), F.lit(True).alias("left"))
    grouped = _shards(parts, F.struct(*item))
    schema = T.StructType([*[grouped.schema[c] for c in SHARD], T.StructField("left", T.BooleanType()), *[T.StructField(n, t) for n, t in WORKING]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                items, left = row["first"] + row["second"], len(row["first"])
                found = Shard(items, left, radius, similarity).members().tolist()
                out += [{**{c: row[c] for c in SHARD}, "left": k < left, **items[k]} for k in found]
            yield pa.RecordBatch.from_pylist(out, arrow)

    return over_batches(grouped, run, schema, rows=200)


def _shards(parts: DataFrame, item: Column) -> DataFrame:
    """The items of each shard, those of its tree and those that are looked up in it."""
    grouped = parts.groupBy(*SHARD).agg(F.collect_list(F.when(F.col("left"), item)).alias("first"), F.collect_list(F.when(~F.col("left"), item)).alias("second"))
    return grouped.where((F.size("first") > 0) & (F.size("first") + F.size("second") > 1) & ((F.col("tree") == F.col("query")) | (F.size("second") > 0)))


def with_shingles(df: DataFrame, text: str, shingle: int) -> DataFrame:
    """Replace ``text`` by __set, 32 bits of each of its distinct shingle hashes."""
    kept = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField("__set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle).astype(np.uint32)).tobytes() for t in strings(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(sets, pa.binary())], names=schema.names)

    return over_batches(df, run, schema)


def links(members: DataFrame, stands: DataFrame, texts: DataFrame, shingle: int, radius: int, similarity: float) -> DataFrame:
    """Links (a, b) between the nodes of ``members`` whose sets have at least ``similarity``.

    ``stands`` (__node, __h) names a text of a node by its hash among ``texts`` (__h, __text).
    """
    nodes = cut(members.select("__node").distinct().join(stands, "__node"))
    few = nodes.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    # of equal texts the first met: they have one set
    found = texts.join(F.broadcast(nodes) if few else nodes, "__h").groupBy("__node").agg(F.first("__text").alias("__text"))
    item = [n for n, _ in WORKING]
    grouped = _shards(members.join(with_shingles(found, "__text", shingle), "__node"), F.struct(*item, "__set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                first, second = (batch.column(c)[row].as_py() for c in ("first", "second"))
                items = first + second
                label = Shard(items, len(first), radius, similarity).joined([np.frombuffer(r["__set"], np.uint32) for r in items])
                a, b = chains(label, np.array([r["__node"] for r in items], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return over_batches(grouped.select("first", "second"), run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 20, bands: int = 10, shard_rows: int = 2048) -> DataFrame:
    """``df`` without ``text``, with the signed fingerprint ``fp`` of the text's set and ``component_id``, the least key it reaches."""
    signed = cut(with_signature(df.drop("component_id").withColumn("__h", F.xxhash64(text)), text, shingle, bands))
    least = cut(signed.groupBy("__node").agg(F.min(key).alias("least"), F.min(F.struct("__h", "fp", "__bands", "__sketch")).alias("s")))
    members = cut(proposed(least.select("__node", "s.fp", "s.__bands", "s.__sketch"), radius, similarity, shard_rows))
    texts = df.select(F.xxhash64(text).alias("__h"), F.col(text).alias("__text"))
    roots = components(links(members, least.select("__node", "s.__h"), texts, shingle, radius, similarity))
    of = cut(roots.join(least.select("__node", "least"), F.col("node") == F.col("__node")).select("__node", "root", "least"))
    best = of.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = of.join(best, "root").select("__node", "component_id")
    named = cut(least.select("__node", "least").join(linked, "__node", "left").select("__node", F.coalesce("component_id", "least").alias("component_id")))
    return signed.drop("__bands", "__sketch", "__h").join(named, "__node").drop("__node")
