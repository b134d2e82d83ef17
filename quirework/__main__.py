"""python -m quirework: plan, build and stream an index of chunk files.

    plan   SOURCE INDEX             which papers of the chunk files are indexed already
    build  SOURCE INDEX [--force]   index what isn't there yet (everything with --force)
    stream SOURCE INDEX CHECKPOINT  index files as they arrive, until none is left
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quirework.operators import index
from quirework.operators.providers import HashedWords
from quirework.sources import files
from quirework.streaming import pipelines


def main(args: list[str] | None = None) -> int:
    """Gives what was counted: papers to process, new chunks, versions of the index."""
    a = argparse.ArgumentParser(prog="quirework", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    a.add_argument("what", choices=["plan", "build", "stream"])
    a.add_argument("source")
    a.add_argument("index")
    a.add_argument("checkpoint", nargs="?")
    a.add_argument("--force", action="store_true")
    a.add_argument("--vectors", type=int, default=0, metavar="SIZE", help="embed with the offline stand-in")
    o = a.parse_args(args)
    spark = SparkSession.builder.appName("quirework").getOrCreate()
    embedder = HashedWords(o.vectors) if o.vectors else None
    if o.what == "plan":
        have = index.read_index(spark, o.index)
        chunks = files.read_chunks(spark, o.source)
        papers = chunks.select(F.col("paper_id").alias("source")).distinct()
        done = have.select(F.col("paper_id").alias("source")) if have is not None else papers.limit(0)
        n = index.plan_ingest(papers, done, "source").where("action = 'process'").count()
        print(f"{n} papers to process")
    elif o.what == "build":
        n = index.build_index(spark, files.read_chunks(spark, o.source), o.index, embedder, o.force)
        print(f"{n} new chunks")
    else:
        if not o.checkpoint:
            a.error("stream needs a checkpoint")
        pipelines.ingest(spark, o.source, o.index, o.checkpoint, embedder=embedder).awaitTermination()
        n = len(index.manifests(spark, o.index))
        print(f"{n} versions")
    return n


if __name__ == "__main__":
    main()
