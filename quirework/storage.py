"""The folder all executors share, and tables written there to cut lineages."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables of fewer bytes are spread over the cores where their files give fewer partitions than there are.
SMALL = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, of the session or the context. Only on one machine (tests) a
    folder of our own stands in for it; on a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = own.get() if own.isDefined() else None
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="quirework-")
        shared_dir.own = at
    return at.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table over all cores; a large one as its files divide it, so that only a few MB are ever moved for this."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SMALL or df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n)
