"""The corpus pipeline: language ID, line dedup, near-dedup, source mix, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all the stage before it kept; :func:`run`
writes each stage as Parquet to the folder the session shares and reads it again, so a stage
never depends on the executors that made the one before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import bpe, langid, linededup, mixing, production, similar
from quern.llm.common import shared_folder

#: Language ID and BPE can't be said in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def _aside(docs: DataFrame, needed: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage with the columns it doesn't need under names that none of its own can clash with."""
    hidden = {c: f"__doc_{i}" for i, c in enumerate(docs.columns) if c not in needed}
    out = stage(docs.withColumnsRenamed(hidden)).select(*needed, *hidden.values())
    return out.withColumnsRenamed({v: k for k, v in hidden.items()}).select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected; ``lang`` becomes the predicted language.

    A null or empty text, or one without a letter, has no language and goes. Very long texts are
    counted whole; equal texts fare alike; with no labelled rows nothing is learned and all goes.
    An empty table stays empty; other columns pass, whatever their names.
    """
    model = production.language_model(docs)
    return _aside(docs, ["doc_id", "text", "lang"], lambda d: langid.identify(d, model).where(~F.col("rejected")).withColumn("lang", F.col("lang_pred")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the boilerplate lines of each source from its documents that have a line of their own; the others are left whole, for the next stage.

    Rows without a source are one site; a null text stays null; repeated rows count as pages each.
    ``n_chars`` becomes the new length (null for a null text). An empty table stays empty; other
    columns pass, whatever their names.
    """

    def lines(d: DataFrame) -> DataFrame:
        return linededup.line_dedup(d, host="source", spare=True).withColumn("n_chars", F.length("text").cast("long"))

    return _aside(docs, ["doc_id", "text", "source", "n_chars"], lines)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each near-duplicate group (five-word shingles, similarity 0.8).

    Rows are told apart by all they hold (128 bits of a hash of their cells with their names; null cells have none), so
    rows of one id and different texts are documents of their own, and of equal rows one stays. Rows without an id
    come last in a group; a row with neither id nor text always stays. Texts without a word are one group; a very long
    text is hashed in blocks. An empty table stays empty; other columns pass, whatever their names and kinds.
    """

    def least(d: DataFrame) -> DataFrame:
        blank = F.col("doc_id").isNull() & F.col("text").isNull()
        told = F.to_json(F.struct(*d.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
        rows = d.withColumn("__row", F.unhex(F.left(F.sha2(told.cast("binary"), 256), F.lit(32))))
        groups = similar.near_duplicates(rows.where(~blank).select("doc_id", "__row", "text"), "__row")
        best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("best")
        first = groups.groupBy("component_id").agg(best).select(F.col("best.__row").alias("__row"))
        kept = rows.where(~blank).join(first, "__row", "left_semi").dropDuplicates(["__row"])
        return kept.unionByName(rows.where(blank))

    return _aside(docs, ["doc_id", "text"], least)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, a whole number of times.

    What a document is taken beyond whole times is carried to the next one of its source and about
    its length (a power of two), in seeded order, so documents of any length come as often as their
    source asks for. A line of more than about 256 documents is dealt into several by hash.
    A document without words is never taken; rows without a source are a source of their own;
    repeated rows are documents of their own. An empty table stays empty; other columns pass.
    """

    def mixed(d: DataFrame) -> DataFrame:
        d = mixing.mix(d, "doc_id", "source", "text", production.mix_weight)
        # fixed point: shares of a line add up without loss
        share = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size") * (1 << 32))).otherwise(F.lit(0)).cast("long")
        order = F.xxhash64(F.lit("copies"), "doc_id", "text")
        length = F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(F.lit(0)).cast("int")
        n = F.ceil(F.col("source_size") / F.pow(F.lit(2.0), "__length") / 256)
        d = d.withColumns({"__share": share, "__order": order, "__length": length}).withColumn("__line", F.pmod(F.xxhash64("__order"), F.greatest(n, F.lit(1)).cast("long")))
        start = F.pmod(F.xxhash64(F.lit("start"), "source", "__length", "__line"), F.lit(1 << 32))
        before = Window.partitionBy("source", "__length", "__line").orderBy("__order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn("__from", start + F.coalesce(F.sum("__share").over(before), F.lit(0)))
        copies = F.shiftright(F.col("__from") + F.col("__share"), 32) - F.shiftright("__from", 32)
        return d.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))

    return _aside(docs, ["doc_id", "text", "source"], mixed)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them.

    Keeps doc_id, lang and source; any other column drops out. A null or empty text has no ids; a very long text is
    encoded whole; repeated rows give equal rows. An empty table stays empty.
    """
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), production.tokenizer_path(), keep_text=False)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents.

    The stages lie below the folder the session shares. What a stage wrote is removed when the next
    one is written; what the last one wrote is the result and stays.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
