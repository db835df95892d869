"""SimHash near-duplicates: fingerprints, BK-trees over shards, and their components.

A fingerprint bit is set if more than half the hashes of a text's word shingles have it.
Rows of one fingerprint meet before the search. Two fingerprints that differ in at most
``radius`` bits agree on at least ``blocks - radius`` of ``blocks`` runs of bits, so the
fingerprints are sharded by every choice of so many runs, and each shard is searched with a
BK-tree: children are keyed by their integer Hamming distance to the parent, and a search
follows only the edges within the radius of its distance. :func:`run_count` takes as many runs
as keep chance shards small, whatever the number of fingerprints.

A shard of up to ``shard_rows`` fingerprints is searched in the task it meets in. A larger one
(a tight cluster can hold a third of all rows) is cut into parts by hash; the trees of its parts
are broadcast in waves of at most ``wave_bytes``, and the shard's fingerprints, which stay where
they are, search them. So no task holds a whole large shard and no pair is left out. A batch
of searches gives a forest of its links, never all pairs.

Defined results: null and empty texts have no words and fingerprint zero, which links like
any other; a very long text is read whole, in blocks of its shingles; repeated rows and equal
fingerprints share a component, and of equal keys any is the least; an empty table gives an empty
result. The key must be an integer; rows without a key get the least key of their component, or
null. Other columns pass through, those named like a result (fp, component_id) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import cut, over_batches, strings
from quern.llm.components import components

BITS = 64
#: Fixed value: seed of the shingle hash.
SEED = 42
#: Words of a text that are hashed at a time.
WORDS_AT_ONCE = 1 << 18
#: Fingerprints of small shards that are searched at a time.
AT_ONCE = 50_000


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included; a shorter text is one shingle."""
    words = text.encode().lower().split()  # bytes: only A-Z change, and words end at ASCII white space
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    out = []
    for at in range(0, len(words) - shingle + 1, WORDS_AT_ONCE):
        part = words[at : at + WORDS_AT_ONCE + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate(([0], ends[: len(part) - shingle])).tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        out.append(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))
    return out[0] if len(out) == 1 else np.concatenate(out)


def vote(hashes: np.ndarray) -> int:
    """The bits that more than half the hashes have."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):  # bit 63 first
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str, shingle: int) -> int:
    """SimHash of a text; without words zero."""
    return vote(shingle_hashes(text, shingle))


def with_fingerprint(df: DataFrame, text: str, shingle: int, name: str) -> DataFrame:
    """Replace ``text`` by the signed 64-bit fingerprint ``name``."""
    kept = [f for f in df.schema.fields if f.name not in (text, name)]
    schema = T.StructType([*kept, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in strings(batch.column(text))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(prints)], names=schema.names)

    return over_batches(df, run, schema)


class BKTrees:
    """Metric trees over integers under Hamming distance, one for each shard, held in arrays.

    The first value of a shard is the root of its tree. Every other value goes down from the root:
    to the child keyed by its distance to the node, or becomes that child. All values of all shards
    go down at once, one level a round, and so do all searches.
    """

    def __init__(self, values: np.ndarray, shard: np.ndarray | None = None):
        self.values = np.asarray(values, np.uint64)
        n = len(self.values)
        at = np.zeros(n, np.int64) if shard is None else np.asarray(shard, np.int64).copy()
        #: For each value but a root its parent and its distance to it, as parent * 65 + distance.
        self.edge = np.full(n, -1, np.int64)
        self.roots = np.full(int(at.max()) + 1 if n else 0, -1, np.int64)
        live, level = np.arange(n), 0
        while len(live):
            live = live[np.argsort(at[live], kind="stable")]
            group = at[live]
            first = np.concatenate(([True], group[1:] != group[:-1]))
            heads = live[first]
            if level:
                self.edge[heads] = at[heads]
            else:
                self.roots[group[first]] = heads
            node, rest = heads[np.cumsum(first) - 1][~first], live[~first]
            at[rest] = node * (BITS + 1) + np.bitwise_count(self.values[rest] ^ self.values[node])
            live, level = rest, level + 1
        self._index()

    def _index(self) -> None:
        inner = np.flatnonzero(self.edge >= 0)
        self.child = inner[np.argsort(self.edge[inner], kind="stable")].astype(np.int32)
        counted = np.bincount(self.edge[inner], minlength=(BITS + 1) * len(self.values) + 1)
        self.first = np.concatenate(([0], np.cumsum(counted))).astype(np.int32)

    def __getstate__(self) -> dict:
        return {"values": self.values, "edge": self.edge, "roots": self.roots}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._index()

    def within(self, queries: np.ndarray, radius: int, shard: np.ndarray | None = None, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (query, value) of what is at most ``radius`` bits apart in the tree of the query's shard."""
        for lo in range(0, len(queries) if len(self.values) else 0, block):
            q = np.arange(lo, min(len(queries), lo + block))
            at = self.roots[np.zeros(len(q), np.int64) if shard is None else shard[q]]
            while len(q):
                d = np.bitwise_count(self.values[at] ^ queries[q]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], at[hit]
                begin = self.first[at * (BITS + 1) + np.maximum(d - radius, 0)]
                n = self.first[at * (BITS + 1) + np.minimum(d + radius, BITS) + 1] - begin
                ends = np.cumsum(n)
                place = np.arange(ends[-1]) + np.repeat(begin - (ends - n), n)
                q, at = np.repeat(q, n), self.child[place].astype(np.int64)


def connect(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all that the links (a, b) join one label, in place; a label is the least place that has it."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def chains(label: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the values that have one label, each to the next lesser one."""
    order = np.lexsort((values, label))
    same = label[order][1:] == label[order][:-1]
    return values[order][1:][same], values[order][:-1][same]


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of every choice of ``blocks - radius`` of the runs of bits."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    runs = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(runs, blocks - radius)]


def run_count(n: int, radius: int, shard_rows: int) -> int:
    """The least number of runs (of at least radius + 2) with which chance alone fills no shard to an eighth of ``shard_rows``."""
    blocks = radius + 2
    while n >> min(m.bit_count() for m in masks(radius, blocks)) > shard_rows // 8 and comb(blocks + 1, radius) <= 500:
        blocks += 1
    return blocks


def links(prints: DataFrame, radius: int, shard_rows: int = 2048, wave_bytes: int = 1 << 26) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that join all within ``radius`` bits."""
    as_long = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    blocks = run_count(prints.count(), radius, shard_rows)
    parts = [F.struct(F.lit(k).cast("short").alias("mask"), F.col("fp").bitwiseAND(F.lit(as_long(m))).alias("part")) for k, m in enumerate(masks(radius, blocks))]
    sharded = prints.select("fp", F.explode(F.array(*parts)).alias("k")).select("fp", "k.mask", "k.part")
    large = cut(sharded.groupBy("mask", "part").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows))
    few = large.limit(10_001).count()
    if not few:
        return _in_tasks(sharded, radius).distinct()
    named = F.broadcast(large) if few <= 10_000 else large
    slice_of = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / shard_rows)).cast("int")
    hot = cut(sharded.join(named, ["mask", "part"]).select("fp", "mask", "part", slice_of.alias("slice")))
    found = _in_waves(hot, radius, wave_bytes)
    return _in_tasks(sharded.join(named, ["mask", "part"], "left_anti"), radius).unionByName(found).distinct()


def _in_tasks(sharded: DataFrame, radius: int) -> DataFrame:
    """Links inside small shards, each with its tree in the task where it meets."""
    grouped = sharded.groupBy("mask", "part").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            ends = np.cumsum(np.diff(column.offsets.to_numpy()))
            values = unsigned(column.flatten())
            shard = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
            at = 0
            while at < len(ends):
                lo = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, lo + AT_ONCE, "right")))
                own, of = values[lo : ends[stop - 1]], shard[lo : ends[stop - 1]] - at
                trees, label = BKTrees(own, of), np.arange(len(own))
                for q, hit in trees.within(own, radius, of):
                    connect(label, q, hit)
                a, b = chains(label, own)
                yield pa.RecordBatch.from_arrays([signed(a), signed(b)], names=["a", "b"])
                at = stop

    return over_batches(grouped, run, "a long, b long")


def _in_waves(hot: DataFrame, radius: int, wave_bytes: int) -> DataFrame:
    """Links inside large shards (fp, mask, part, slice): trees of slices, broadcast a wave at a time."""
    grouped = hot.groupBy("mask", "part", "slice").agg(F.collect_list("fp").alias("fps"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                values = unsigned(batch.column("fps")[k].values)
                tree, label = BKTrees(values), np.arange(len(values))
                for q, hit in tree.within(values, radius):
                    connect(label, q, hit)
                row = batch.slice(k, 1)
                held = [pa.array([x.tobytes()], pa.binary()) for x in (values, tree.edge, label.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*[row.column(c) for c in ("mask", "part", "slice")], *held], names=["mask", "part", "slice", "values", "edge", "label"])

    trees = cut(over_batches(grouped, build, "mask short, part long, slice int, values binary, edge binary, label binary"))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, label in zip(batch.column("values"), batch.column("label"), strict=True):
                a, b = chains(np.frombuffer(label.as_py(), np.int64), np.frombuffer(values.as_py(), np.uint64))
                yield pa.RecordBatch.from_arrays([signed(a), signed(b)], names=["a", "b"])

    out = over_batches(trees.select("values", "label"), inside, "a long, b long")
    wave, held = {}, 0
    for row in trees.toLocalIterator():
        wave.setdefault((row["mask"], row["part"]), []).append((row["slice"], row["values"], row["edge"], row["label"]))
        held += sum(map(len, (row["values"], row["edge"], row["label"])))
        if held >= wave_bytes:
            out = out.unionByName(_wave(hot, wave, radius))
            wave, held = {}, 0
    return out.unionByName(_wave(hot, wave, radius)) if wave else out


def _wave(hot: DataFrame, wave: dict[tuple[int, int], list[tuple[int, bytes, bytes, bytes]]], radius: int) -> DataFrame:
    """Links between the trees of a wave and the fingerprints of their shards in later slices."""
    spark = hot.sparkSession
    shared = spark.sparkContext.broadcast(wave)
    shards = spark.createDataFrame(list(wave), "mask short, part long")

    def opened(parts: list[tuple[int, bytes, bytes, bytes]]) -> Iterator[tuple[int, BKTrees, np.ndarray]]:
        for part, values, edge, label in parts:
            tree = BKTrees.__new__(BKTrees)
            tree.__setstate__({"values": np.frombuffer(values, np.uint64), "edge": np.frombuffer(edge, np.int64), "roots": np.zeros(1, np.int64)})
            yield part, tree, np.frombuffer(label, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, part, own = (batch.column(c).to_numpy() for c in ("mask", "part", "slice"))
            values = unsigned(batch.column("fp"))
            order = np.lexsort((part, mask))
            turn = np.flatnonzero((mask[order][1:] != mask[order][:-1]) | (part[order][1:] != part[order][:-1])) + 1
            for rows in np.split(order, turn):
                asked, later = values[rows], own[rows]
                everything, label, size = [asked], np.arange(len(asked)), len(asked)
                for place, tree, inner in opened(shared.value[(int(mask[rows[0]]), int(part[rows[0]]))]):
                    reps, group = np.unique(inner, return_inverse=True)  # a tree takes part with one value of each of its groups
                    everything.append(tree.values[reps])
                    label = np.concatenate((label, size + np.arange(len(reps))))
                    which = np.flatnonzero(later > place)
                    for q, hit in tree.within(asked[which], radius):
                        connect(label, which[q], size + group[hit])
                    size += len(reps)
                a, b = chains(label, np.concatenate(everything))
                yield pa.RecordBatch.from_arrays([signed(a), signed(b)], names=["a", "b"])

    found = cut(over_batches(hot.join(F.broadcast(shards), ["mask", "part"], "left_semi"), run, "a long, b long", rows=10_000).where("a <> b").distinct())
    shared.unpersist()
    return found


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, shard_rows: int = 2048, wave_bytes: int = 1 << 26) -> DataFrame:
    """``df`` without ``text``, with the signed fingerprint ``fp`` and ``component_id``, the least key it reaches."""
    prints = cut(with_fingerprint(df.drop("component_id"), text, shingle, "fp"))
    least = cut(prints.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(least, radius, shard_rows, wave_bytes))
    # the least key of each component, for the fingerprints that have links; the others stand alone
    of = cut(roots.join(least, roots["node"] == least["fp"]).select("fp", "root", "least"))
    best = of.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = of.join(best, "root").select("fp", "component_id")
    # written once more, so that rows and names are both dealt by fingerprint and Spark can split a large group of copies
    named = cut(least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return prints.join(named, "fp")


def hexadecimal(fp: Column) -> Column:
    """16 lowercase hexadecimal digits of a signed 64-bit number."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
