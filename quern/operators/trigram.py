"""Text search through an index of trigrams: only files that can match are read and checked.

The index has for each three characters in a row the files that hold them, as hashes of their paths, in
lists of the files of one batch; it lies in folders by a hash of the trigram. A query, a literal or a
pattern, becomes clauses: a file must have one trigram of each. Files that do are searched as without an
index, so the rows are the same; a query that asks for no trigram is looked for in all files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import catalog
from quern.operators.lexical import small

#: Folders of trigrams, and parts of a folder that are sorted apart, so that no task sorts a whole folder.
BUCKETS, PARTS = 32, 16
#: Files whose trigrams are put together in one list; characters of a class, and trigrams of a clause, up to which it is written out.
FILES_AT_ONCE, CLASS, CLAUSE = 2000, 16, 512


def key(publication: Column, file: Column) -> Column:
    return F.xxhash64(publication, file)


def code(gram: str) -> int:
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(files: DataFrame, folder: str) -> None:
    """Write the index of (publication, file, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, FILES_AT_ONCE) for b in batches for at in range(0, b.num_rows, FILES_AT_ONCE)):
            keys, grams, rows = batch.column("key").to_numpy(), [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                x = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                own = np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:]) if len(x) > 2 else np.zeros(0, np.int64)
                grams.append(own)
                rows.append(np.full(len(own), k))
            every, of = np.concatenate(grams), np.concatenate(rows)
            order = np.argsort(every, kind="stable")
            every, of = every[order], of[order]
            starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
            held = pa.ListArray.from_arrays(pa.array(np.append(starts, len(every)).astype(np.int32)), pa.array(keys[of]))
            yield pa.RecordBatch.from_arrays([pa.array(every[starts]), held], names=["gram", "keys"])

    rows = files.select(key(F.col("publication"), F.col("file")).alias("key"), "text").mapInArrow(run, "gram long, keys array<long>")
    part = F.pmod(F.shiftright(F.xxhash64("gram"), 8), F.lit(PARTS))
    placed = rows.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket", part).sortWithinPartitions("bucket", "gram")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def _windows(run: list[set[str]]) -> list[set[str]]:
    """Clauses of characters in a row, each known up to a set."""
    out = []
    for a, b, c in zip(run, run[1:], run[2:], strict=False):
        if len(a) * len(b) * len(c) <= CLAUSE:
            out.append({"".join(x) for x in product(a, b, c)})
    return out


def _members(items: list) -> set[str] | None:
    """The characters of a small class, None if it is large, negated or has categories."""
    found: set[str] = set()
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL":
            found.add(chr(value))
        elif name == "RANGE" and value[1] - value[0] < CLASS:
            found |= {chr(x) for x in range(value[0], value[1] + 1)}
        else:
            return None
    return found if 0 < len(found) <= CLASS else None


def _required(tree) -> list[set[str]]:
    """Clauses that every match of a parsed pattern satisfies."""
    clauses: list[set[str]] = []
    run: list[set[str]] = []

    def close() -> None:
        clauses.extend(_windows(run))
        run.clear()

    def walk(items) -> None:
        for kind, value in items:
            name = str(kind)
            if name == "LITERAL":
                run.append({chr(value)})
            elif name == "IN" and (found := _members(value)):
                run.append(found)
            elif name == "SUBPATTERN" and not value[1] and not value[2]:
                walk(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                least, most, inner = value
                for _ in range(min(int(least), 8)):
                    walk(inner)
                if int(least) > 8 or most != least:
                    close()
            elif name == "BRANCH":
                close()
                each = [_required(b) for b in value[1]]
                if all(each):  # a match has one of the branches, so one trigram of any
                    clauses.append(set().union(*(min(c, key=len) for c in each)))
            elif name in ("AT", "ASSERT", "ASSERT_NOT"):
                continue  # nothing is read
            else:
                close()

    walk(tree)
    close()
    return clauses


def plan(query: str, regex: bool = False) -> list[set[str]]:
    """Clauses of trigrams: a file with a match has one of each. None if nothing is known.

    A pattern is read by Python's parser; where the two languages differ, or case doesn't count, nothing is taken to be known.
    """
    if not regex:
        return [{query[i : i + 3]} for i in range(len(query) - 2)]
    if re.search(r"&&|\[\^?\]|\[[^\]]*\[|\\0|\\[QERGXhHvVpPNkcez]|\(\?[a-zA-Z<#-]|[^\x00-\x7f]", query):
        return []
    try:
        tree = re._parser.parse(query)
    except (re.error, RecursionError, OverflowError):
        return []
    return _required(tree)


@dataclass
class TrigramIndex:
    table: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> TrigramIndex:
        return cls(spark.read.parquet(folder))

    def candidates(self, clauses: list[set[str]]) -> DataFrame:
        """(key) of the files that have a trigram of each clause."""
        spark = self.table.sparkSession
        rows = [(code(g), k) for k, c in enumerate(clauses) for g in sorted(c)]
        asked = spark.createDataFrame(rows, "gram long, clause int").withColumn("bucket", _bucket(F.col("gram")))
        buckets = sorted({r[0] for r in asked.select("bucket").distinct().collect()})
        codes = sorted({g for g, _ in rows})
        within = lambda c, of: f"{c} IN ({', '.join(map(str, of))})"
        table = self.table.where(within("bucket", buckets)).where(within("gram", codes))
        found = table.join(F.broadcast(asked), ["bucket", "gram"]).select("clause", F.explode("keys").alias("key"))
        return found.distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(clauses)).select("key")

    def matching(self, files: DataFrame, query: str, regex: bool = False) -> DataFrame:
        """The files that can match."""
        clauses = plan(query, regex)
        if not clauses:
            return files
        return files.withColumn("__key", key(F.col("publication"), F.col("file"))).join(small(self.candidates(clauses).withColumnRenamed("key", "__key")), "__key", "left_semi").drop("__key")

    def search(self, files: DataFrame, query: str, scope: str | None = None, regex: bool = False, max_results: int | None = 50) -> DataFrame:
        """The rows of :func:`catalog.search_text`."""
        own = catalog.within(files, scope)
        return catalog.search_text(self.matching(own, query, regex), query, None, regex, max_results)
