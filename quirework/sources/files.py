"""Sources: chunk files, manifests, loose JSON, binary documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework import schemas


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a folder's *__chunks.json files (arrays) or of one file, with source_path and, in it, each chunk's
    place. A missing path or a folder without such a file is an error. Missing fields are null."""
    r = spark.read.schema(schemas.CHUNK).option("multiLine", True)
    if not path.endswith(".json"):
        r = r.option("pathGlobFilter", "*__chunks.json")
    df = r.json(path).withColumn("source_path", F.col("_metadata.file_path"))
    if not df.inputFiles():
        raise FileNotFoundError(f"no *__chunks.json in {path}")
    return df


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Extraction manifests with the source's name at the top, by which a processed source is found again."""
    df = spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)
    return df.withColumn("source", F.coalesce("metadata.source", F.lit("")))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file; missing or broken gives no rows, and so does an object with none of the fields."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path).dropna("all")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_documents(spark: SparkSession, path: str, parse: Callable[[bytes], list[dict]], glob: str = "*.pdf") -> DataFrame:
    """Pages of binary documents: path, page_number, text, word_count, has_figures, error. parse gives the pages of one
    document; a document it fails on gives one row with the error and stops nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for at, content in zip(d["path"], d["content"]):
                try:
                    out += [{"path": at, "error": None, **p} for p in parse(content)]
                except Exception as e:  # noqa: BLE001
                    out.append({"path": at, "error": str(e)})
            yield pd.DataFrame(out, columns=["path", "page_number", "text", "word_count", "has_figures", "error"], dtype=object)

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInPandas(run, schemas.EXTRACTED)
