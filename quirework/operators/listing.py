"""Counts and listings of a collection of chunks. All groups are aggregated before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirework.functions import text as T


def stats(chunks: DataFrame) -> DataFrame:
    """kind, name, n: total chunks, distinct papers, chunks of each type and of each paper."""
    count = lambda kind, name: chunks.groupBy(F.coalesce(name, F.lit("")).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    t = chunks.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("chunks").alias("name"), "n")
    p = chunks.agg(F.countDistinct("paper_id").alias("n")).select(F.lit("total").alias("kind"), F.lit("papers").alias("name"), "n")
    return t.unionByName(p).unionByName(count("type", "chunk_type")).unionByName(count("paper", "paper_id"))


def publications(chunks: DataFrame, order: str) -> DataFrame:
    """paper_id, title, authors, year, doi of each paper's first row, first_row, place: by year, the latest first.

    Years are text: an empty one comes last. Papers of a year stand by their first row. The place is the number of
    papers of later years and the place in the year, so that no task orders all papers.
    """
    cols = ["title", "authors", "year", "doi"]
    first = F.min_by(F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in cols)), order)
    p = chunks.where(F.coalesce("paper_id", F.lit("")) != "").groupBy("paper_id").agg(first.alias("f"), F.min(order).alias("first_row")).select("paper_id", "f.*", "first_row")
    years = p.groupBy("year").agg(F.count("*").alias("c")).select("year", (F.sum("c").over(W.orderBy(F.desc("year"))) - F.col("c")).alias("_later"))
    own = F.row_number().over(W.partitionBy("year").orderBy("first_row"))
    return p.withColumn("place", own).join(years, "year").select("paper_id", *cols, "first_row", (F.col("_later") + F.col("place")).alias("place"))


def count_of(df: DataFrame) -> Column:
    """The number of df's rows, as a scalar subquery of whatever it is used in."""
    return df.agg(F.count("*")).scalar()


def listing(chunks: DataFrame, chunk_type: str | None = None, paper: str | None = None, order: str | None = None) -> DataFrame:
    """Rows of a type whose paper_id contains the text, without regard to case. With order: `place` within the paper, by
    type and order, and the rows sorted by paper and place."""
    out = chunks
    if chunk_type:
        out = out.where(F.col("chunk_type") == chunk_type)
    if paper:
        out = out.where(F.lower("paper_id").contains(paper.lower()))
    if order:
        out = out.withColumn("place", F.row_number().over(W.partitionBy("paper_id").orderBy("chunk_type", order))).orderBy("paper_id", "place")
    return out


def bars(counts: DataFrame, n: str, per: int) -> DataFrame:
    """counts with a text bar of one block for every `per`."""
    return counts.withColumn("bar", F.repeat(F.lit("█"), F.floor(F.col(n) / per).cast("int")))


def catalogue_line(title: Column, year: Column, doi: Column) -> Column:
    return F.format_string('- **"%s"** (%s) — DOI: %s', title, year, doi)


def quality(pages: DataFrame, key: str, words: str) -> DataFrame:
    """key, quality_score: 0.6 for long pages and 0.4 for the share of pages with 20 words or more."""
    w = F.coalesce(F.col(words), F.lit(0))
    q = pages.groupBy(key).agg(F.sum(w).alias("s"), F.sum(F.when(w >= 20, 1).otherwise(0)).alias("good"), F.count("*").alias("n"))
    return q.select(key, F.round(0.6 * F.least(F.col("s") / F.col("n") / 300.0, F.lit(1.0)) + 0.4 * F.col("good") / F.col("n"), 3).alias("quality_score"))


def assembled(chunks: DataFrame, key: str, order: str, text: str, most: int = 10_000) -> DataFrame:
    """key, part, full_text, word_count: each paper's texts in order, with a blank line between.

    A paper of at most `most` rows is one part. One of more is divided by equal ranges of `order` (a number), as many as
    its rows ask for, so that no task and no value holds a whole volume; parts joined in order are the text.
    """
    n = chunks.groupBy(key).agg(F.ceil(F.count("*") / most).alias("_n"), F.min(order).alias("_low"), F.max(order).alias("_high"))
    c = chunks.join(n, key).withColumn("part", F.floor((F.col(order) - F.col("_low")) * F.col("_n") / (F.col("_high") - F.col("_low") + 1)).cast("int"))
    g = c.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("p"), F.sum(T.word_count(F.col(text))).alias("word_count"))
    return g.select(key, "part", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("full_text"), "word_count")


def repair_weak_pages(primary: DataFrame, fallback: DataFrame, key: str, weak: int = 50) -> DataFrame:
    """key, page_number, word_count, replaced: pages of fewer than `weak` words from the fallback if it has more."""
    f = fallback.select(key, "page_number", F.col("word_count").alias("_f"))
    p = primary.join(f, [key, "page_number"], "left")
    w = F.coalesce("word_count", F.lit(0))
    use = (w < weak) & (F.coalesce("_f", F.lit(0)) > w)
    return p.select(key, "page_number", F.when(use, F.col("_f")).otherwise(w).alias("word_count"), use.alias("replaced"))
