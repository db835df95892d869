"""Bundles: chunk table, embeddings, lexical index and manifest in one folder."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import embedding, lexical

VERSION = 1
#: Names within a folder: the pointer to the version that counts, the versions, and a snapshot's list of files.
CURRENT, VERSIONS, LISTING = "CURRENT", "versions", "FILES.json"
#: Stored precisions of the vectors, the preferred one first.
PRECISIONS = ["float16", "float32"]
PARTS = ["chunks", *[f"embeddings/{p}" for p in PRECISIONS], "index/postings", "index/terms", "index/fields"]


def row_digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest): a SHA-256 over the count and the sums of row hashes, in any order.

    A row is its cells in order of their names, each as name, length and text (JSON for what is
    no string, whole number or boolean), or as name and a dash where it is null.
    """

    def cell(name: str) -> Column:
        plain = df.schema[name].dataType.typeName() in ("string", "byte", "short", "integer", "long", "boolean")
        value = F.col(name).cast("string") if plain else F.to_json(F.struct(name))
        told = F.concat(F.lit(f"{name}="), F.length(value).cast("string"), F.lit(":"), value)
        return F.coalesce(told, F.lit(f"{name}=-"))

    row = F.sha2(F.concat(*map(cell, sorted(df.columns))), 256)
    part = lambda at: F.sum(F.conv(F.substring(row, at, 8), 16, 10).cast("decimal(38,0)"))
    sums = df.agg(F.count("*").alias("rows"), *[part(1 + 8 * i).alias(f"s{i}") for i in range(4)])
    return sums.select("rows", F.sha2(F.concat_ws(":", "rows", *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4)]), 256).alias("digest"))


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, sha256) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, store = _path(spark, name)
    return store.exists(path)


def write_text(spark: SparkSession, name: str, text: str) -> None:
    path, store = _path(spark, name)
    out = store.create(path, True)
    out.write(bytearray(text.encode()))
    out.close()


def write(folder: str, chunks: DataFrame, index: lexical.LexicalIndex, embeddings: DataFrame | None = None, source: dict[str, str] | None = None, model: str = "hashing", precision: str = "float16") -> dict:
    """Write a bundle; the manifest comes last and has a digest of every part.

    ``precision`` says to what the vectors have been rounded (float16, stored as two bytes a value, or float32).
    The chunks lie in order of their ids, so that one is found in one row group.
    """
    if precision not in PRECISIONS:
        raise ValueError(f"unknown precision: {precision}")
    spark = chunks.sparkSession
    chunks.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{folder}/chunks")
    index.save(f"{folder}/index")
    if embeddings is not None:
        stored = embeddings.withColumn("packed", embedding.packed("embedding")).drop("embedding") if precision == "float16" else embeddings
        # beside its vector a row has all that a search looks at before it reads texts
        told = spark.read.parquet(f"{folder}/chunks").drop("text")
        told.join(stored, "id").write.mode("overwrite").parquet(f"{folder}/embeddings/{precision}")
    parts = {}
    for part in PARTS:
        if exists(spark, f"{folder}/{part}"):
            rows, digest = row_digest(spark.read.parquet(f"{folder}/{part}")).first()
            parts[part] = {"rows": rows, "sha256": digest}
    first = embeddings.select(F.size("embedding")).first() if embeddings is not None else None
    manifest = {"schema_version": VERSION, **{f"source_{k}": v for k, v in (source or {}).items()}, "built_at": datetime.now(timezone.utc).isoformat(), "chunk_count": parts["chunks"]["rows"], "embedding_model": model if embeddings is not None else None, "embedding_dim": first[0] if first else None, "postings": spark.read.parquet(f"{folder}/index/postings").agg(F.sum("n")).first()[0] or 0, "artifacts": parts}
    write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, indent=1, sort_keys=True))
    if exists(spark, f"{folder}/{CURRENT}"):  # what was written now counts, not what was restored before
        path, store = _path(spark, f"{folder}/{CURRENT}")
        store.delete(path, False)
    return manifest


@dataclass
class Bundle:
    """``chunks`` are without texts, and with vectors, if the bundle has vectors; ``texts`` are then the chunks as written."""

    manifest: dict
    chunks: DataFrame
    index: lexical.LexicalIndex | None
    texts: DataFrame | None = None

    def info(self, spark: SparkSession) -> DataFrame:
        """The manifest as one row."""
        told = F.lit(json.dumps(self.manifest))
        return spark.range(1).select(F.from_json(told, F.schema_of_json(told)).alias("m")).select("m.*")


def read_manifest(spark: SparkSession, folder: str) -> dict:
    folder = current(spark, folder)
    if not exists(spark, f"{folder}/manifest.json"):
        raise FileNotFoundError(f"no manifest in {folder}")
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/manifest.json").collect()))


def load_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors of a bundle, in the preferred of the precisions that are there; FileNotFoundError without any."""
    folder = current(spark, folder)
    for precision in PRECISIONS:
        if exists(spark, f"{folder}/embeddings/{precision}"):
            return spark.read.parquet(f"{folder}/embeddings/{precision}")
    raise FileNotFoundError(f"no embeddings in {folder}")


def open_bundle(spark: SparkSession, folder: str) -> Bundle:
    """Manifest and chunks must be there; index, embeddings and cluster tags may be missing."""
    manifest, folder = read_manifest(spark, folder), current(spark, folder)
    if not exists(spark, f"{folder}/chunks"):
        raise FileNotFoundError(f"no chunks in {folder}")
    chunks, texts = spark.read.parquet(f"{folder}/chunks"), None
    if exists(spark, f"{folder}/embeddings"):
        chunks, texts = load_embeddings(spark, folder), chunks
    index = lexical.LexicalIndex.load(spark, f"{folder}/index") if exists(spark, f"{folder}/index/postings") else None
    return Bundle(manifest, chunks, index, texts)


def validate(spark: SparkSession, folder: str) -> DataFrame:
    """A row a part: (part, present, rows_ok, digest_ok) against the manifest."""
    told, folder = read_manifest(spark, folder)["artifacts"], current(spark, folder)
    out = []
    for part in PARTS:
        there = exists(spark, f"{folder}/{part}")
        rows, digest = row_digest(spark.read.parquet(f"{folder}/{part}")).first() if there else (None, None)
        said = told.get(part, {})
        out.append((part, there, there and rows == said.get("rows"), there and digest == said.get("sha256")))
    return spark.createDataFrame(out, "part string, present boolean, rows_ok boolean, digest_ok boolean")


def check_source(manifest: dict, expected: str) -> bool:
    """Whether a bundle was built from the expected repository; warns if not."""
    told = manifest.get("source_repo")
    if told == expected:
        return True
    warnings.warn(f"the bundle was built from {told}, not from {expected}", stacklevel=2)
    return False


def _uri(spark: SparkSession, name: str) -> str:
    """A path as a URI that pyarrow can open on any executor."""
    path, store = _path(spark, name)
    whole = store.makeQualified(path).toUri()
    return f"{whole.getScheme()}://{whole.getAuthority() or ''}{whole.getPath()}".rstrip("/")


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of all files below a folder, relative to it."""
    path, store = _path(spark, folder)
    top, found, out = store.makeQualified(path).toUri().getPath().rstrip("/"), store.listFiles(path, True), []
    while found.hasNext():
        out.append(found.next().getPath().toUri().getPath()[len(top) + 1 :])
    return sorted(out)


def copy_files(spark: SparkSession, source: str, target: str, files: list[str]) -> DataFrame:
    """Copy files between two folders, a task a few files; (file, length, sha256) of what was read, which is what the copy reads back as."""
    a, b = _uri(spark, source), _uri(spark, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(store: fs.FileSystem, path: str, out=None) -> tuple[int, str]:
            digest, size = hashlib.sha256(), 0
            with store.open_input_stream(path) as stream:
                while part := stream.read(1 << 20):
                    digest.update(part)
                    size += len(part)
                    if out is not None:
                        out.write(part)
            return size, digest.hexdigest()

        (old, top), (new, to) = fs.FileSystem.from_uri(a), fs.FileSystem.from_uri(b)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                new.create_dir(f"{to}/{name}".rpartition("/")[0], recursive=True)
                with new.open_output_stream(f"{to}/{name}") as out:
                    told = read(old, f"{top}/{name}", out)
                if read(new, f"{to}/{name}") != told:
                    raise OSError(f"{name} was not copied whole")
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, *told)], names=["file", "length", "sha256"])

    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 200)))
    return names.mapInArrow(run, "file string, length long, sha256 string")


def _point(spark: SparkSession, folder: str, version: str) -> None:
    """Make a version the bundle of a folder: one rename, which happens or doesn't."""
    write_text(spark, f"{folder}/{CURRENT}.{version}", version)
    jvm = spark._jvm
    (a, _), (b, _) = _path(spark, f"{folder}/{CURRENT}.{version}"), _path(spark, f"{folder}/{CURRENT}")
    over = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    over[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    store = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(_uri(spark, folder)), spark._jsc.hadoopConfiguration())
    store.rename(a.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(a), b.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(b), over)


def current(spark: SparkSession, folder: str) -> str:
    """Where the parts of a bundle lie: the folder itself, or the version its pointer names."""
    if not exists(spark, f"{folder}/{CURRENT}"):
        return folder
    return f"{folder}/{VERSIONS}/{spark.read.text(f'{folder}/{CURRENT}').first()[0]}"


def snapshot(spark: SparkSession, folder: str, store: str) -> str:
    """Copy a bundle to ``store/v=<build time>``, outside the bundle, and give that path.

    Executors copy the files; the list of their digests comes last, so a snapshot that has one is whole.
    """
    if f"{store.rstrip('/')}/".startswith(f"{folder.rstrip('/')}/"):
        raise ValueError("snapshots don't belong inside the bundle")
    built = read_manifest(spark, folder)["built_at"]
    target, own = f"{store.rstrip('/')}/v={re.sub('[^0-9]', '', built)}", current(spark, folder)
    files = [f for f in _files(spark, own) if not f.startswith((VERSIONS, CURRENT))]
    told = copy_files(spark, own, target, files).collect()  # a row a file
    write_text(spark, f"{target}/{LISTING}", json.dumps({r["file"]: [r["length"], r["sha256"]] for r in told}, indent=1, sort_keys=True))
    return target


def restore(spark: SparkSession, saved: str, folder: str) -> None:
    """Make a snapshot the bundle of a folder.

    Executors copy the files into a version of their own and compare digests with the snapshot's list; only when all
    agree the folder's pointer moves to it. Until then, and if anything fails, readers have the bundle that was there;
    it stays behind as it is. A folder that holds something other than a bundle is left alone (ValueError).
    """
    listing = f"{saved}/{LISTING}"
    if not exists(spark, listing):
        raise ValueError(f"the snapshot {saved} is not whole")
    told = {k: tuple(v) for k, v in json.loads("\n".join(r[0] for r in spark.read.text(listing).collect())).items()}
    if exists(spark, folder) and not exists(spark, f"{current(spark, folder)}/manifest.json"):
        raise ValueError(f"{folder} is no bundle")
    version = uuid.uuid4().hex
    target = f"{folder}/{VERSIONS}/{version}"
    missing = sorted(set(told) - set(_files(spark, saved)))
    got = {} if missing else {r["file"]: (r["length"], r["sha256"]) for r in copy_files(spark, saved, target, sorted(told)).collect()}
    if got != told:
        path, store = _path(spark, target)
        store.delete(path, True)
        raise ValueError(f"the snapshot {saved} does not match its list of files")
    _point(spark, folder, version)


def versions(spark: SparkSession, folder: str, remove: bool = False) -> list[str]:
    """The versions of a bundle that its pointer does not name; ``remove`` deletes them."""
    top, kept = f"{folder}/{VERSIONS}", current(spark, folder).rpartition("/")[2]
    if not exists(spark, top):
        return []
    path, store = _path(spark, top)
    old = sorted(f.getPath().getName() for f in store.listStatus(path) if f.getPath().getName() != kept)
    for name in old if remove else []:
        store.delete(_path(spark, f"{top}/{name}")[0], True)
    return old
