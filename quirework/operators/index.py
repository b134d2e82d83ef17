"""The index as a table: incremental upsert and what an ingest run would do."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import chunks as C


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing with the rows of new in place of those with the same key. A null key is never replaced."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def unindexed(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key isn't indexed; parts of split chunks count by the chunk's key."""
    base = existing.select(base_id(F.col(key)).alias(key)).distinct()
    return new.join(base, key, "left_anti")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, that with the greatest order; pre-aggregated, so a hot key costs no large group."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def plan_ingest(papers: DataFrame, processed: DataFrame, source: str) -> DataFrame:
    """source, action: skip where a processed paper has that source, else process."""
    done = processed.select(source).where(F.col(source) != "").distinct().withColumn("_done", F.lit(True))
    return papers.join(done, source, "left").withColumn("action", F.when(F.col("_done"), "skip").otherwise("process")).drop("_done")


#: Folders into which an index is divided by chunk; an upsert writes those it concerns.
BUCKETS = 64


def base_id(id: Column) -> Column:
    """The chunk an index row belongs to: parts of a split chunk count as it."""
    return F.regexp_replace(id, r"__p\d+$", "")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def manifests(spark: SparkSession, path: str) -> list[int]:
    """The versions of an index, in order."""
    fs, P = _fs(spark, path)
    at = P(f"{path.rstrip('/')}/_versions")
    return sorted(int(x.getPath().getName()[1:7]) for x in fs.listStatus(at) if x.getPath().getName().endswith(".json")) if fs.exists(at) else []


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path.rstrip('/')}/_versions/v{version:06d}.json", wholetext=True).first()[0])


def read_index(spark: SparkSession, path: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The rows of an index, of its latest version if none is named; None where there is no index yet."""
    have = manifests(spark, path)
    if not have:
        return None
    parts = _manifest(spark, path, version or have[-1])["parts"]
    at = [f"{path.rstrip('/')}/{p}" for b, p in sorted(parts.items()) if buckets is None or int(b) in buckets]
    return spark.read.parquet(*at) if at else None


def upsert_version(spark: SparkSession, path: str, rows: DataFrame, tag: str, embedder=None, force: bool = False) -> dict:
    """A new version of an index with the rows in place of those of the same chunks; gives its manifest: version, tag,
    parts, n_rows, n_new (chunks that had no row before).

    Only the buckets concerned are written; the others stay where an earlier version put them. A tag names the batch: the
    version of the last tag is written again from the version before it, so that a batch that is run twice counts once.
    A version is there once its manifest is. With an embedder, only rows that are new or whose text changed are embedded.
    force leaves all earlier rows out.
    """
    have = manifests(spark, path)
    last = _manifest(spark, path, have[-1]) if have else None
    again = last is not None and last["tag"] == tag
    version = last["version"] if again else (last["version"] if last else 0) + 1
    before = [v for v in have if v < version]
    old_parts = {} if force or not before else _manifest(spark, path, before[-1])["parts"]
    root = path.rstrip("/")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(base_id(F.col("id"))), F.lit(BUCKETS)).cast("int")).persist()
    try:
        touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # at most BUCKETS
        old = [f"{root}/{old_parts[str(b)]}" for b in touched if str(b) in old_parts]
        old = spark.read.parquet(*old).withColumn("bucket", F.pmod(F.xxhash64(base_id(F.col("id"))), F.lit(BUCKETS)).cast("int")) if old else None
        if embedder is not None:
            from quirework.operators.providers import embedded

            if old is None or "embedding" not in old.columns:
                rows = embedded(rows, "document", embedder)
            else:
                known = old.select("id", F.xxhash64("document").alias("_h"), F.col("embedding").alias("_e"))
                rows = rows.withColumn("_h", F.xxhash64("document")).join(known, ["id", "_h"], "left")
                rows = embedded(rows.withColumn("_ask", F.when(F.col("_e").isNull(), F.col("document"))), "_ask", embedder).withColumn("embedding", F.coalesce("_e", "embedding")).drop("_h", "_e", "_ask")
        base = rows.select(base_id(F.col("id")).alias("_b")).distinct()
        out = rows
        if old is not None:
            out = old.withColumn("_b", base_id(F.col("id"))).join(base, "_b", "left_anti").drop("_b").unionByName(rows, allowMissingColumns=True)
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/v{version:06d}")
        gone = base if old is None else base.join(old.select(base_id(F.col("id")).alias("_b")), "_b", "left_anti")
        made = {"version": version, "tag": tag, "n_rows": rows.count(), "n_new": gone.count(), "parts": old_parts | {str(b): f"data/v{version:06d}/bucket={b}" for b in touched}}
    finally:
        rows.unpersist()
    fs, P = _fs(spark, path)
    at, tmp = P(f"{root}/_versions/v{version:06d}.json"), P(f"{root}/_versions/.v{version:06d}.tmp")
    f = fs.create(tmp, True)
    f.write(bytearray(json.dumps(made).encode()))
    f.close()
    fs.delete(at, False)
    fs.rename(tmp, at)
    return made


def build_index(spark: SparkSession, chunks: DataFrame, path: str, embedder=None, force: bool = False, tag: str | None = None) -> int:
    """Chunks that aren't indexed yet go into an index, all of them anew with force; gives how many chunks are new.

    A chunk in parts is indexed if one of its parts is. Of rows with the same chunk_id one counts, with a row_id the last.
    """
    have = None if force else read_index(spark, path)
    new = latest(chunks, "chunk_id", "row_id") if "row_id" in chunks.columns else chunks.dropDuplicates(["chunk_id"])
    if have is not None:
        new = new.join(have.select(base_id(F.col("id")).alias("chunk_id")).distinct(), "chunk_id", "left_anti")
    rows = C.index_rows(new)
    if have is not None and rows.isEmpty():
        return 0
    return upsert_version(spark, path, rows, tag or uuid.uuid4().hex, embedder, force)["n_new"]


def index_file(spark: SparkSession, file: str, path: str, embedder=None) -> int:
    """build_index for one chunk file; a file that was indexed before adds nothing."""
    from quirework.sources.files import read_chunks

    return build_index(spark, read_chunks(spark, file), path, embedder)


def init_index(spark: SparkSession, source: str, path: str, embedder=None) -> DataFrame | None:
    """The index at path, built from a folder of chunk files where there is none yet."""
    from quirework.sources.files import read_chunks

    if not manifests(spark, path):
        build_index(spark, read_chunks(spark, source), path, embedder)
    return read_index(spark, path)
