"""Hard-negative mining by product quantisation with stored residual norms, exact by a last look.

Vectors are whole numbers, a row's score for an anchor is their inner product. A vector is cut into parts of a
few dimensions; each part is stored as the number of the nearest of up to 256 centroids, with the length of what
is left over (its residual). For an anchor a table holds the product of each of its parts with each
centroid, so the sum of the entries a row's codes name is the row's score but for the residuals, and
by Cauchy and Schwarz these are off by at most the sum over the parts of anchor length times residual
length. So a row is left out only where its score, whatever the residuals are, can't be among the best;
all others are counted in whole numbers. The result does not depend on the codebook: that is fitted on a
bounded sample (``sample_rows``), and every row is encoded and searched.

Two passes. The first gives each anchor its positives, the first ``positives`` other rows of its label. Each positive
opens a window, scores of at least ``percent`` hundredths of its own and at most its own, and the second pass gives
each window its first ``negatives`` rows of another label. Encoded rows lie in blocks in the shared
folder; anchors are broadcast in waves of at most ``wave`` rows (about 300 bytes each at 64 dimensions, and 400 a task
for what it holds), and each task looks up its blocks for all of a wave, keeps the first few of each
window, and only these are shuffled. Anchors are a stated share of the rows, so with n rows and w waves
the blocks are read 2 w times. No two rows ever meet in a join, and no label is a key: one label can have any
share of the rows.

Defined results: a row without key or label, without a vector, or with a component that is null or
not finite takes no part. Components become floor(scale * x) in double precision, at most 2**24 either way
(beyond that exact sums need more than 64 bits). Vectors of unlike length are filled up with zeros. Of
rows that share a key the one with the least label, then vector, takes part. Ties go to the smaller
key, however many rows share a vector. A window whose positive scores below 0 is empty. An empty table, or one
without anchors, gives no rows. Columns but the three named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut, over_batches

LIMIT = 1 << 24
#: Dimensions of a part; centroids of a part at most.
PART, CENTROIDS = 4, 256
BLOCK_ROWS = 4096
#: Anchors looked up in a block at a time; pairs counted exactly at a time.
ANCHORS_AT_ONCE, PAIRS_AT_ONCE = 256, 1 << 15
NONE = np.iinfo(np.int64).min
BLOCK = "ids binary, labels binary, codes binary, residuals binary, vectors binary"


@dataclass
class Codebook:
    """``centroids``: parts x centroids x PART, in double precision."""

    centroids: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, dim: int, rounds: int = 8) -> Codebook:
        """Lloyd's rounds on each part of the rows of a sample."""
        parts = max(1, -(-dim // PART))
        x = np.zeros((max(1, len(sample)), parts * PART))
        x[: len(sample), : sample.shape[1]] = sample
        k = max(1, min(CENTROIDS, len(x) // 4))
        out, rng = np.empty((parts, k, PART)), np.random.default_rng(1)
        for m in range(parts):
            own = x[:, m * PART : (m + 1) * PART]
            c = own[rng.choice(len(own), k, replace=False)].copy()
            for _ in range(rounds):
                near = cls._nearest(own, c)
                n = np.bincount(near, minlength=k)
                for d in range(PART):
                    total = np.bincount(near, own[:, d], minlength=k)
                    c[n > 0, d] = total[n > 0] / n[n > 0]
            out[m] = c
        return cls(out)

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)

    def parts(self, v: np.ndarray) -> np.ndarray:
        """Rows x parts x PART."""
        out = np.zeros((len(v), len(self.centroids) * PART))
        out[:, : v.shape[1]] = v
        return out.reshape(len(v), len(self.centroids), PART)

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each row's parts, and the lengths of their residuals, rounded up."""
        x = self.parts(v)
        codes = np.stack([self._nearest(x[:, m], c) for m, c in enumerate(self.centroids)], axis=1)
        rest = x - self.centroids[np.arange(len(self.centroids)), codes]
        length = np.sqrt((rest * rest).sum(axis=2)).astype(np.float32)
        return codes.astype(np.uint8), np.nextafter(length, np.float32(np.inf))

    def tables(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For anchors: parts x centroids x anchors products, and the lengths of their parts."""
        x = self.parts(v)
        return np.einsum("amd,mkd->mka", x, self.centroids), np.sqrt((x * x).sum(axis=2))


def bounds(codes: np.ndarray, residuals: np.ndarray, tables: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows x anchors: a score from the tables, and how far it is off at most (with room for rounding)."""
    score = tables[0][codes[:, 0]]
    for m in range(1, len(tables)):
        score += tables[m][codes[:, m]]
    off = residuals.astype(float) @ lengths.T
    return score, off * (1 + 1e-9) + 1e-9 * (1 + np.abs(score).max(initial=0.0))


class Best:
    """For each window the first ``k`` rows by score, then key, of those offered so far."""

    def __init__(self, windows: int, k: int):
        self.score = np.full((windows, k), NONE)
        self.key = np.full((windows, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """What a row must score to count."""
        return self.score[:, -1]

    def offer(self, window: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        if not len(window):
            return
        k = self.score.shape[1]
        touched = np.unique(window)
        w = np.concatenate((window, np.repeat(touched, k)))
        s = np.concatenate((score, self.score[touched].ravel()))
        i = np.concatenate((key, self.key[touched].ravel()))
        order = np.lexsort((i, -s, w))  # NONE is its own negative, so what is missing comes first
        order = order[np.argsort(s[order] == NONE, kind="stable")]
        order = order[np.argsort(w[order], kind="stable")]
        w, s, i = w[order], s[order], i[order]
        place = np.arange(len(w)) - np.searchsorted(w, w)
        kept = place < k
        self.score[w[kept], place[kept]], self.key[w[kept], place[kept]] = s[kept], i[kept]


@dataclass
class Block:
    ids: np.ndarray
    labels: np.ndarray
    codes: np.ndarray
    residuals: np.ndarray
    vectors: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Block:
        ids = np.frombuffer(row["ids"], np.int64)
        rows = lambda name, kind: np.frombuffer(row[name], kind).reshape(len(ids), -1)
        return cls(ids, np.frombuffer(row["labels"], np.int64), rows("codes", np.uint8), rows("residuals", np.float32), rows("vectors", np.int32))

    def exact(self, r: np.ndarray, anchors: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Whole scores of the rows ``r`` for the anchors ``a``."""
        out = np.empty(len(r), np.int64)
        for at in range(0, len(r), PAIRS_AT_ONCE):
            part = slice(at, at + PAIRS_AT_ONCE)
            out[part] = np.einsum("pd,pd->p", self.vectors[r[part]].astype(np.int64), anchors[a[part]])
        return out


def prepared(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, q) of the rows that take part, one a key."""
    whole = F.transform(F.col("v"), lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    fit = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(F.forall("v", fit)).select("id", "label", whole.alias("q"))
    again = cut(rows.groupBy("id").count().where("count > 1").select("id"))
    if not again.limit(1).count():
        return rows
    first = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "q")).alias("f")).select("id", "f.*")
    return rows.join(again, "id", "left_anti").unionByName(first)


def encoded(rows: DataFrame, book: Codebook, dim: int) -> DataFrame:
    """The rows in blocks: keys, labels, codes, residual lengths and whole vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.zeros((batch.num_rows, max(1, dim)), np.int32)
            q = batch.column("q")
            n = np.diff(q.offsets.to_numpy())
            inside = np.arange(v.shape[1]) < n[:, None]
            v[inside] = q.flatten().to_numpy(zero_copy_only=False)
            codes, rest = book.encode(v)
            parts = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label")]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (*parts, codes, rest, v)], names=["ids", "labels", "codes", "residuals", "vectors"])

    return over_batches(rows, run, BLOCK, rows=BLOCK_ROWS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Block.read(row)


def _collected(rows: DataFrame, book: Codebook, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, labels and vectors of a wave of anchors, in order of their keys."""
    got = [Block.read(r.asDict()) for r in encoded(rows, book, dim).select("ids", "labels", "codes", "residuals", "vectors").collect()]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, max(1, dim)), np.int64)
    ids, labels, vectors = (np.concatenate([getattr(b, c) for b in got]) for c in ("ids", "labels", "vectors"))
    order = np.argsort(ids)
    return ids[order], labels[order], vectors[order].astype(np.int64)


def _kth(low: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th largest value of each column; minus infinity where there are fewer rows."""
    return np.partition(low, len(low) - k, axis=0)[len(low) - k] if len(low) >= k else np.full(low.shape[1], -np.inf)


def _positives(blocks: DataFrame, anchors, book: Codebook, k: int) -> DataFrame:
    """(anchor, score, id): the first ``k`` other rows of each anchor's label, of each task."""
    shared = blocks.sparkSession.sparkContext.broadcast((anchors, book))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, labels, vectors), book = shared.value
        best = Best(len(ids), k)
        of = {int(x): np.flatnonzero(labels == x) for x in np.unique(labels)}
        tables = {x: [(a[at : at + ANCHORS_AT_ONCE], *book.tables(vectors[a[at : at + ANCHORS_AT_ONCE]])) for at in range(0, len(a), ANCHORS_AT_ONCE)] for x, a in of.items()} if len(ids) <= 16 * ANCHORS_AT_ONCE else None
        for block in _blocks(batches):
            for x in np.unique(block.labels).tolist():
                rows = np.flatnonzero(block.labels == x)
                a = of.get(x, np.zeros(0, np.int64))
                made = tables[x] if tables is not None and len(a) else ((a[at : at + ANCHORS_AT_ONCE], *book.tables(vectors[a[at : at + ANCHORS_AT_ONCE]])) for at in range(0, len(a), ANCHORS_AT_ONCE))
                for own, table, lengths in made:
                    score, off = bounds(block.codes[rows], block.residuals[rows], table, lengths)
                    least = np.maximum(best.least()[own].astype(float), _kth(score - off, k + 1))  # one more: the anchor itself may be a row
                    r, c = np.nonzero(score + off >= least)
                    r, c = rows[r], own[c]
                    other = block.ids[r] != ids[c]
                    r, c = r[other], c[other]
                    whole = block.exact(r, vectors, c)
                    fit = whole >= best.least()[c]
                    best.offer(c[fit], whole[fit], block.ids[r[fit]])
        w, place = np.nonzero(best.score > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(ids[w]), pa.array(best.score[w, place]), pa.array(best.key[w, place])], names=["anchor", "score", "id"])

    return over_batches(blocks, run, "anchor long, score long, id long", rows=8)


def _negatives(blocks: DataFrame, anchors, windows: tuple[np.ndarray, np.ndarray, np.ndarray], book: Codebook, k: int) -> DataFrame:
    """(window, score, id): the first ``k`` rows of another label within each window, of each task.

    ``windows`` are anchor (a place among the anchors, in order), least and most score.
    """
    shared = blocks.sparkSession.sparkContext.broadcast((anchors, windows, book))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, labels, vectors), (of, low, high), book = shared.value
        best = Best(len(of), k)
        begin = np.searchsorted(of, np.arange(len(ids) + 1))
        wide = int((begin[1:] - begin[:-1]).max(initial=0))
        used = np.flatnonzero(begin[1:] > begin[:-1])
        for block in _blocks(batches):
            for at in range(0, len(used), ANCHORS_AT_ONCE):
                own = used[at : at + ANCHORS_AT_ONCE]
                # windows of each anchor, the last one repeated up to the same number
                slot = np.minimum(begin[own][:, None] + np.arange(wide), begin[own + 1][:, None] - 1)
                least, most = np.maximum(low[slot], best.least()[slot]), high[slot]
                score, off = bounds(block.codes, block.residuals, *book.tables(vectors[own]))
                below, above = score - off, score + off
                alike = block.labels[:, None] == labels[own]
                told = least.astype(float)
                for s in range(wide if (best.least()[slot] == NONE).any() else 0):
                    sure = (below >= least[:, s]) & (above <= most[:, s]) & ~alike
                    told[:, s] = np.maximum(told[:, s], _kth(np.where(sure, below, -np.inf), k))
                hit = (above >= told.min(axis=1)) & (below <= most.max(axis=1)) & ~alike
                r, c = np.nonzero(hit)
                whole = block.exact(r, vectors, own[c])
                fit = (whole[:, None] >= told[c]) & (whole[:, None] <= most[c])
                fit[:, 1:] &= slot[c][:, 1:] != slot[c][:, :-1]
                p, s = np.nonzero(fit)
                best.offer(slot[c[p], s], whole[p], block.ids[r[p]])
        w, place = np.nonzero(best.score > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(best.score[w, place]), pa.array(best.key[w, place])], names=["window", "score", "id"])

    return over_batches(blocks, run, "window long, score long, id long", rows=8)


def _first(found: DataFrame, by: str, k: int) -> DataFrame:
    """The first ``k`` of each group with their rank; Spark keeps no more of a task's rows."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, sample_rows: int = 4096, wave: int = 32_768) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows of which ``anchor`` (over ``id``) holds."""
    spark = df.sparkSession
    rows = cut(prepared(df, key, vector, label, scale))
    dim, n = rows.agg(F.max(F.size("q")), F.count(F.when(anchor, 1))).first()
    dim = dim or 0
    taken = rows.select("id", "q").orderBy(F.xxhash64(F.lit("codebook"), "id"), "id").limit(sample_rows).collect()
    sample = np.zeros((len(taken), dim))
    for i, r in enumerate(taken):
        sample[i, : len(r["q"])] = r["q"]
    book = Codebook.fit(sample, dim)
    blocks = cut(encoded(rows, book, dim))
    waves = max(1, -(-n // wave))
    out = None
    for k in range(waves):
        own = rows.where(anchor & (F.pmod(F.xxhash64("id"), F.lit(waves)) == k))
        ids, labels, vectors = anchors = _collected(own, book, dim)
        told = _first(_positives(blocks, anchors, book, positives), "anchor", positives).orderBy("anchor", "rank").collect()
        pairs = [(w, r["anchor"], r["id"], r["score"]) for w, r in enumerate(told)]
        high = np.array([p[3] for p in pairs], np.int64)
        # whole scores s with percent * high <= 100 * s; none below 0
        low = -(-percent * high // 100)
        of = np.searchsorted(ids, np.array([p[1] for p in pairs], np.int64))
        found = _first(_negatives(blocks, anchors, (of, low, high), book, negatives), "window", negatives)
        named = spark.createDataFrame(pairs, "window long, anchor_id long, positive_id long, positive_score long")
        part = found.join(F.broadcast(named), "window").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        part = part if waves == 1 else cut(part)
        out = part if out is None else out.unionByName(part)
    return out
