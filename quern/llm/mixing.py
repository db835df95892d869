"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of all rows are the words of the mix. Sources share them by weight; no source
gets more than ``max_repeat`` times its own words, and what it cannot take is shared again
by weight. The mix is counted in equal blocks of ``block`` words. Blocks go to sources by
highest quotients of the targets, and each source's blocks go to its shards by highest
quotients of the shards' words. A shard lays its rows end to end in seeded order and takes
its blocks from a seeded place on, round and round; so a row is taken whole times and, at
the two ends, in part.

Shards have ``shard_words`` words, or a 65536th of all words if that is more: the driver
handles one row a source and at most 65536 shards more, and a window never holds more than
a shard, however large a source is. More than ``max_sources`` sources raise ValueError.

Defined results: a null text has no words and is never taken; null is a source of its own,
ordered last; repeated rows are rows of their own, rows of one place follow each other by key and
size; with no words at all every target is 0; rows without a key
are dealt to shards by their texts. A very long text counts whole. An empty table gives
an empty one. Other columns pass through, whatever their names; those named size, source_size,
target or taken are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut, n_words, packed, unpacked

MAX_SHARDS = 65536


def sainte_lague(votes: Sequence[float], seats: int) -> list[int]:
    """Seats by the highest quotients votes / 1, 3, 5, ...; ties go to the earlier party."""
    v = np.asarray(votes, float)
    if not len(v) or v.sum() <= 0 or seats <= 0:
        return [0] * len(v)
    k = np.floor(v / (v.sum() / seats) + 0.5).astype(np.int64)  # the highest quotients, of about as many seats
    k[v <= 0] = 0
    short = seats - int(k.sum())
    if short > 0:
        heap = [(-v[i] / (2 * k[i] + 1), i) for i in range(len(v)) if v[i] > 0]
        heapq.heapify(heap)
        for _ in range(short):
            _, i = heap[0]
            k[i] += 1
            heapq.heapreplace(heap, (-v[i] / (2 * k[i] + 1), i))
    elif short < 0:
        heap = [(v[i] / (2 * k[i] - 1), -i) for i in range(len(v)) if k[i] > 0]
        heapq.heapify(heap)
        for _ in range(-short):
            _, i = heapq.heappop(heap)
            k[-i] -= 1
            if k[-i] > 0:
                heapq.heappush(heap, (v[-i] / (2 * k[-i] - 1), i))
    return k.tolist()


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeat: float) -> list[float]:
    """Each source's share of all sizes by weight, none above ``max_repeat`` times its size."""
    total, caps = sum(sizes), [max_repeat * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i))
    left, weight = float(total), float(sum(weights))
    out = [0.0] * len(sizes)
    for n, i in enumerate(order):
        level = left / weight
        if caps[i] / weights[i] >= level:
            for j in order[n:]:
                out[j] = level * weights[j]
            break
        out[i] = float(caps[i])
        left -= caps[i]
        weight -= weights[i]
    return out


def _unit(key: Column, seed: int, what: str, first: int) -> Column:
    """Whole number below 2**28 from eight hexadecimal digits of a hash."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{what}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, first, 7), 16, 10).cast("long")


def _shard() -> Column:
    return F.shiftright(F.col("spread") * F.col("shards"), 28)


def mix(
    df: DataFrame,
    key: str,
    source: str,
    text: str,
    weight_of: Callable[[int, str | None], float],
    max_repeat: int = 3,
    block: int = 16,
    shard_words: int = 4096,
    seed: int = 1,
    max_sources: int = 50_000,
    keep_text: bool = True,
) -> DataFrame:
    """Add size, source_size, target and taken (words the mix takes of the row, repeats counted).

    ``weight_of`` gives the weight of a source from its place in code-point order and its name.
    Without ``keep_text`` the texts are read once, and what was counted is written for the rest.
    """
    # rows without a key are dealt by their texts
    name = F.coalesce(df[key].cast("string"), F.md5(F.coalesce(df[text], F.lit("")).cast("binary")))
    counted = {
        "source": df[source].cast("string"),
        "spread": _unit(name, seed, "shard", 1),
        "place": _unit(name, seed, "row", 1),
        "key": df[key],
        "size": n_words(df[text]),
    }
    columns = [c for c in df.columns if keep_text or c != text]
    rows = packed(df, **counted) if keep_text else cut(packed(df, **counted).withColumn("row", F.col("row").dropFields(text) if len(columns) else F.struct()))
    slim = cut(rows.select("source", "spread", "size")) if keep_text else rows.select("source", "spread", "size")
    plan, quota = _apportioned(slim, weight_of, max_repeat, block, shard_words, max_sources)

    rows = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("p_source"))).withColumn("shard", _shard())
    rows = rows.join(F.broadcast(quota), F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    line = Window.partitionBy("source", "shard").orderBy("place", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("from", F.coalesce(F.sum("size").over(line), F.lit(0)))
    # the shard's line of q_size words; left words from start on, beyond the end from the beginning
    cell = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("shard").cast("string"))
    start = F.when(F.col("q_size") > 0, _unit(cell, seed, "start", 1) % F.col("q_size")).otherwise(F.lit(0))
    whole = F.when(F.col("q_size") > 0, F.floor(F.col("quota") / F.col("q_size"))).otherwise(F.lit(0))
    rows = rows.withColumns({"start": start, "whole": whole, "left": F.col("quota") - whole * F.col("q_size")})

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("from") + F.col("size"), hi) - F.greatest(F.col("from"), lo))

    stop = F.col("start") + F.col("left")
    taken = F.col("whole") * F.col("size") + overlap(F.col("start"), F.least(stop, F.col("q_size"))) + overlap(F.lit(0), F.greatest(stop - F.col("q_size"), F.lit(0)))
    return unpacked(rows, columns, size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"), taken=taken.cast("long"))


def _apportioned(slim: DataFrame, weight_of: Callable[[int, str | None], float], max_repeat: int, block: int, shard_words: int, max_sources: int) -> tuple[DataFrame, DataFrame]:
    """The plan of each source and the quota of each of its shards, from (source, spread, size) of all rows."""
    rows = slim.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    names, sizes = [r[0] for r in rows], [r[1] for r in rows]
    total = sum(sizes)
    goal = targets(sizes, [weight_of(i, s) for i, s in enumerate(names)], max_repeat)
    blocks = sainte_lague(goal, (2 * total + block) // (2 * block))
    per_shard = max(shard_words, -(-total // MAX_SHARDS))
    spark = slim.sparkSession
    plan = spark.createDataFrame([(s, n, g, max(1, -(-n // per_shard))) for s, n, g in zip(names, sizes, goal, strict=True)], "p_source string, source_size long, target double, shards long")
    sharded = slim.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("p_source"))).select("source", _shard().alias("shard"), "size")
    cells = sharded.groupBy("source", "shard").agg(F.sum("size").alias("n")).collect()
    at = {s: i for i, s in enumerate(names)}
    by_source: list[list[tuple[int, int]]] = [[] for _ in names]
    for s, k, n in cells:
        by_source[at[s]].append((k, n))
    quotas = []
    for i, own in enumerate(by_source):
        own.sort()
        for (k, n), q in zip(own, sainte_lague([n for _, n in own], blocks[i]), strict=True):
            quotas.append((names[i], k, n, min(q * block, max_repeat * n)))
    return plan, spark.createDataFrame(quotas, "q_source string, q_shard long, q_size long, quota long")
