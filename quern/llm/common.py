"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: A word everywhere in the training-data operators: no space, no ASCII control that counts as white space.
WORD = r"[^\x20\x09-\x0D]++"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a session that runs on this machine alone and names none (tests) gets a temporary one;
    on a cluster that is an error, as a machine-local folder would lose data there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def packed(df: DataFrame, **needed: Column) -> DataFrame:
    """The rows of ``df`` as one column ``row`` beside the columns that an operator works with, so no names clash."""
    whole = F.struct(*[df[c] for c in df.columns]) if df.columns else F.struct()
    return df.select(whole.alias("row"), *[c.alias(n) for n, c in needed.items()])


def unpacked(df: DataFrame, columns: list[str], **results: Column) -> DataFrame:
    """The rows again; ``results`` take the place of columns of their name or stand behind."""
    old = [results[c].alias(c) if c in results else F.col("row")[c].alias(c) for c in columns]
    return df.select(*old, *[v.alias(n) for n, v in results.items() if n not in columns])


def slices(texts: list[str], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters; a longer text is a range of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def stratified(rows: DataFrame, key: str, stratum: str, cap: int, total: int = 10_000) -> DataFrame:
    """About ``cap`` rows of each stratum, at most twice as many in all, the same ones in every run.

    A row is taken when the hash of its key is below ``cap`` / the rows of its stratum, so
    each stratum gives ``cap`` rows on average and all its rows if it has no more; of the rows
    taken the first 2 * ``cap`` for each stratum, in order of the hash, stay, however often a key is
    repeated. ``cap`` is at most ``total`` / the strata. The counts are an aggregate of one row per stratum; strata are class labels, and more than
    1000 of them raise ValueError.
    """
    counts = rows.groupBy(stratum).count().limit(1001).collect()
    if len(counts) > 1000:
        raise ValueError(f"more than 1000 values of {stratum}")
    cap = min(cap, total // max(1, len(counts)))
    chosen = F.lit(False)
    unit = F.pmod(F.xxhash64(F.lit("stratified"), F.col(key)), F.lit(1 << 40)) / float(1 << 40)
    for value, count in counts:
        chosen = chosen | (F.col(stratum).eqNullSafe(F.lit(value)) & (unit < cap / count))
    return rows.where(chosen).orderBy(unit, key, stratum).limit(2 * cap * max(1, len(counts)))


def middle(text: str, longest: int) -> Column:
    """A text of up to ``longest`` characters, or so many from the middle of a longer one; null counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    start = F.floor((F.length(body) - longest) / 2).cast("int") + 1
    return F.when(F.length(body) <= longest, body).otherwise(F.substring(body, start, F.lit(longest)))


def within_budget(rows: list[Row], stratum: str, text: str, chars: int) -> list[Row]:
    """Of a sample's rows in their order those whose texts fit an even share of ``chars`` for each stratum."""
    share = chars // max(1, len({r[stratum] for r in rows}))
    held: Counter = Counter()
    out = []
    for r in rows:
        if held[r[stratum]] + len(r[text]) <= share:
            held[r[stratum]] += len(r[text])
            out.append(r)
    return out


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves ``remainder``."""
    return F.crc32(key.cast("string").cast("binary")) % modulus == remainder


Batches = Iterator[pa.RecordBatch]


def over_batches(df: DataFrame, run: Callable[[Batches], Batches], schema: object, rows: int = 1000) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for rows that are whole texts.

    ``run`` sees at most ``rows`` rows at a time (Spark bounds the bytes of a batch), and a Python
    worker gives back the memory a task took before it takes the next: several workers share an
    executor's memory with its JVM.
    """

    def tidy(batches: Batches) -> Batches:
        yield from run(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return df.mapInArrow(tidy, schema)
