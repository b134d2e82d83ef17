"""Sinks: chunks, extracted text, manifests, dumps. All write in parallel, a folder for each call."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework import schemas


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines, a folder for each chunk type, so that one paper with most chunks is no single file's."""
    chunks.write.mode("overwrite").partitionBy("chunk_type").json(path)


def extracted_text(papers: DataFrame) -> DataFrame:
    """paper_id, value: a header of the paper's data, a rule, and the text. papers: paper_id, title, authors, doi, year,
    source, extraction_method, quality_score, page_count, word_count, full_text."""
    names = ["title", "authors", "doi", "year", "source", "extraction_method", "quality_score", "page_count", "word_count"]
    head = [F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names]
    return papers.select("paper_id", F.concat_ws("\n", *head, F.repeat(F.lit("="), F.lit(60)), F.col("full_text")).alias("value"))


def manifests(papers: DataFrame, pages: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """paper_id, value: a paper's data, its pages and its figures as JSON; papers without pages or figures have empty lists."""
    listed = lambda df, order, *cols: df.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("l"))
    page = ("word_count", "has_figures", "extraction_method")
    j = papers.join(listed(pages, "page_number", *page).withColumnRenamed("l", "pages"), "paper_id", "left")
    none = F.array().cast("array<struct<figure_id:string,page_number:int,image_path:string,caption:string,width_px:int,height_px:int>>")
    if figures is None:
        j = j.withColumn("figures", none)
    else:
        own = ("page_number", "image_path", "caption", "width_px", "height_px")
        j = j.join(listed(figures, "figure_id", *own).withColumnRenamed("l", "figures"), "paper_id", "left").withColumn("figures", F.coalesce("figures", none))
    j = j.withColumn("pages", F.coalesce("pages", F.array().cast("array<struct<page_number:int,word_count:int,has_figures:boolean,extraction_method:string>>")))
    meta = F.struct("title", F.col("authors").alias("author"), "doi", "year", "source").alias("metadata")
    return j.select("paper_id", F.to_json(F.struct("paper_id", "pdf_path", meta, "extraction_method", "quality_score", "page_count", "word_count", "pages", "figures")).alias("value"))


def paper_arrays(chunks: DataFrame, most: int = 10_000) -> DataFrame:
    """paper_id, part, value: a paper's chunks as one JSON array, as the form of a file for each paper has it.

    A paper of more than `most` chunks is divided into parts by the hash of the chunk's id, so that no task holds them all.
    """
    cols = [f.split()[0] for f in schemas.CHUNK.split(", ")]
    n = chunks.groupBy("paper_id").agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))
    c = chunks.join(n, "paper_id").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("_parts")).cast("int"))
    g = c.groupBy("paper_id", "part").agg(F.array_sort(F.collect_list(F.struct("chunk_id", *(x for x in cols if x != "chunk_id")))).alias("l"))
    return g.select("paper_id", "part", F.to_json("l", {"ignoreNullFields": "false"}).alias("value"))


def write_paper_arrays(chunks: DataFrame, path: str, most: int = 10_000) -> None:
    """paper_arrays as text files, one array a line, in a folder for each paper."""
    paper_arrays(chunks, most).select("paper_id", "value").write.mode("overwrite").partitionBy("paper_id").text(path)


def write_figures(figures: DataFrame, path: str) -> DataFrame:
    """Writes images (paper_id, figure_no, image) as files named by paper and figure; gives paper_id, figure_no, image_path.

    Lazy: the files are written by the tasks when the result is used; a task that runs twice writes the same file. Of
    images with the same paper and number the last written stays; a null image gives a null path.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
        store.create_dir(root, recursive=True)
        for d in batches:
            at = []
            for paper, no, image in zip(d["paper_id"], d["figure_no"], d["image"]):
                name = f"{root.rstrip('/')}/{paper}__figure_{no}.png"
                if image is not None:
                    with store.open_output_stream(name) as f:
                        f.write(bytes(image))
                at.append(None if image is None else name)
            yield d[["paper_id", "figure_no"]].assign(image_path=at)

    return figures.select("paper_id", "figure_no", "image").mapInPandas(run, "paper_id string, figure_no int, image_path string")


def write_values(values: DataFrame, path: str) -> None:
    values.select("value").write.mode("overwrite").option("lineSep", "\n\f\n").text(path)
