"""Chunks of papers: assembly, filter, windows of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.functions import vocabularies as V

LEAST_WORDS = 20


def build(papers: DataFrame, merged: DataFrame, key: str, repaired: DataFrame | None = None) -> DataFrame:
    """key, chunk_type, chunk_id, content, word_count, confidence.

    Every paper gets its core types, empty ones too; the optional ones only from LEAST_WORDS words. The number in
    chunk_id counts the paper's chunks. merged: key, canonical, content, confidence; repaired: key, results, the results
    sections that take the place of the merged ones.
    """
    types = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(t).alias("chunk_type")) for i, t in enumerate(V.CHUNK_TYPES))))
    p = papers.select(key, types.alias("t")).select(key, "t.*")
    m = merged.withColumnRenamed("canonical", "chunk_type")
    c = p.join(m, [key, "chunk_type"], "left")
    if repaired is not None:
        c = c.join(repaired.select(key, F.lit("results").alias("chunk_type"), "results"), [key, "chunk_type"], "left").withColumn("content", F.coalesce("results", "content"))
    c = c.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("word_count", T.word_count(F.col("content")))
    c = c.where(~F.col("chunk_type").isin(V.OPTIONAL_TYPES) | (F.col("word_count") >= LEAST_WORDS))
    no = F.row_number().over(W.partitionBy(key).orderBy("place")) - 1
    return c.withColumn("no", no).select(
        key, "chunk_type", F.concat_ws("__", F.col(key).cast("string"), "chunk_type", F.format_string("%03d", "no")).alias("chunk_id"),
        "content", "word_count", F.coalesce("confidence", F.lit("unknown")).alias("confidence"),
    )


def figure_content(caption: Column, figure_id: Column) -> Column:
    """A figure chunk's content: the caption or a placeholder."""
    return F.when(F.coalesce(caption, F.lit("")) != "", caption).otherwise(F.concat(F.lit("[Figure "), F.coalesce(figure_id, F.lit("")), F.lit(" — no caption detected]")))


def with_figures(chunks: DataFrame, figures: DataFrame, key: str) -> DataFrame:
    """chunks, and figures numbered on from each paper's last chunk. figures: key, figure_id, caption.

    Counts per paper are aggregated before they are joined, so a paper with very many figures only needs its figures in
    one order.
    """
    n = chunks.groupBy(key).agg(F.count("*").alias("n"))
    no = F.row_number().over(W.partitionBy(key).orderBy("figure_id", "caption")) - 1
    f = figures.withColumn("no", no).join(n, key, "left").withColumn("no", F.col("no") + F.coalesce("n", F.lit(0)))
    content = figure_content(F.col("caption"), F.col("figure_id"))
    f = f.select(
        key, F.lit("figure").alias("chunk_type"), F.concat_ws("__", F.col(key).cast("string"), F.lit("figure"), F.format_string("%03d", "no")).alias("chunk_id"),
        content.alias("content"), T.word_count(content).alias("word_count"), F.lit("figure").alias("confidence"),
    )
    return chunks.unionByName(f)


def skip_reason(chunk_type: Column, content: Column, known: Column) -> Column:
    """Why a chunk isn't indexed: type, empty or dup, the first that holds; null if it is."""
    words = T.word_count(F.coalesce(content, F.lit("")))
    return F.when(~F.coalesce(chunk_type, F.lit("")).isin(V.CHUNK_TYPES), "type").when(words < LEAST_WORDS, "empty").when(known, "dup")


def split_windows(df: DataFrame, keys: list[str], text: str, max_words: int = 4000, overlap: int = 100) -> DataFrame:
    """keys, sub_chunk, n_parts, part, part_words: windows of max_words words that step by max_words - overlap.

    A text of at most max_words words is one part and keeps its white space.
    """
    t = T.trim_ws(F.coalesce(F.col(text), F.lit("")))
    d = df.select(*keys, F.col(text).alias("_text"), F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, rf"{T.WS}+")).alias("_w"))
    n = F.size("_w")
    step = max_words - overlap
    parts = F.when(n > max_words, 1 + F.ceil((n - max_words) / step)).otherwise(1).cast("int")
    d = d.withColumn("n_parts", parts).select("*", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("sub_chunk"))
    piece = F.slice("_w", F.col("sub_chunk") * step + 1, F.lit(max_words))
    return d.select(*keys, "sub_chunk", "n_parts", F.when(F.col("n_parts") == 1, F.col("_text")).otherwise(F.array_join(piece, " ")).alias("part"), F.size(piece).alias("part_words"))


def index_rows(chunks: DataFrame, max_words: int = 4000, overlap: int = 100) -> DataFrame:
    """Rows of the index, metadata with defaults and as text: id, document, paper_id ... sub_chunk."""
    meta = ["paper_id", "chunk_type", "title", "authors", "year", "doi", "source_file"]
    c = chunks.where(skip_reason(F.col("chunk_type"), F.col("content"), F.lit(False)).isNull())
    p = split_windows(c, ["chunk_id", *meta], "content", max_words, overlap)
    return p.select(
        F.when(F.col("n_parts") > 1, F.concat("chunk_id", F.lit("__p"), F.col("sub_chunk").cast("string"))).otherwise(F.col("chunk_id")).alias("id"),
        F.col("part").alias("document"), *(F.coalesce(m, F.lit("")).alias(m) for m in meta),
        F.col("part_words").cast("string").alias("word_count"), F.col("sub_chunk").cast("string").alias("sub_chunk"),
    )


def report(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chunk_type, word_count, flag, preview."""
    n = T.word_count(F.coalesce("content", F.lit("")))
    return chunks.select(*keys, "chunk_type", n.alias("word_count"), F.when(n < LEAST_WORDS, "EMPTY").otherwise("").alias("flag"), T.preview(F.coalesce("content", F.lit("")), 60).alias("preview"))
