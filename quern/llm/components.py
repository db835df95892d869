"""Connected components of a graph that is kept in tables, by spreading the least label.

Each round every node takes the least label among its own and its neighbours' (one join, one
least value before the shuffle), and then the label of the node its label names, so labels jump
along paths and the rounds grow with the logarithm of a component's length. The state is
written to the shared checkpoint folder each round, and nothing but counts comes to the driver.

One label can stand at a third of all nodes, so no join of nodes is keyed by their label: the
labels that move are found among the distinct labels, and their table is broadcast while its
counted size is small (``BROADCAST_LABELS`` of 16 bytes); beyond that the nodes are salted and the
table is repeated for each salt. Callers give links as chains, so no node has many neighbours.

Defined results: links of a node with itself are no links, but name the node; repeated links
count once; links without an end are left out; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut

#: Labels that move in a round up to this many are broadcast.
BROADCAST_LABELS = 1_000_000
SALTS = 32


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the component's least node."""
    ways = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(edges.select(F.inline(ways)).dropna().distinct())
    # a table of the neighbours that are less than the node is all the first round needs
    state = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        known = state.select(F.col("node").alias("b"), F.col("root").alias("near"))
        offered = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = cut(state.join(offered, "node").select("node", F.least("root", "near").alias("next"), "root"))
        labels = step.select(F.col("next").alias("node")).distinct()
        moved = cut(labels.join(step.where("next <> node"), "node").select(F.col("node").alias("next"), F.col("next").alias("far")))
        new = cut(_jump(step, moved).select("node", F.col("new").alias("root"), (F.col("new") != F.col("root")).alias("changed")))
        state = new.select("node", "root")
        if not new.where("changed").limit(1).count():
            return state


def _jump(step: DataFrame, moved: DataFrame) -> DataFrame:
    """``step`` (node, next, root) with ``new``, the label that ``next`` itself has by now."""
    n = moved.limit(BROADCAST_LABELS + 1).count()
    if not n:
        return step.withColumn("new", F.col("next"))
    if n <= BROADCAST_LABELS:
        met = step.join(F.broadcast(moved), "next", "left")
    else:
        salted = moved.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = step.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["next", "salt"], "left")
    return met.withColumn("new", F.coalesce("far", "next"))
