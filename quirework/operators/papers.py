"""What a paper is called and who wrote it, from its file, its data and its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.functions import vocabularies as V


def first_lines(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, line_no (from 0), s: the first n lines of each text, trimmed; the rest of a text is never exploded."""
    l = df.select(key, F.posexplode(F.slice(F.split(F.col(text), "\n"), 1, n)).alias("line_no", "line"))
    return l.select(key, "line_no", T.trim_ws(F.col("line")).alias("s"))


def page_title(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, title: the longest of the first 15 lines, among the first 30, that may be a title; of equals the first.

    A text without such a line gives no row.
    """
    s = F.col("s")
    commas = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
    loud = (s == F.upper(s)) & (s != F.lower(s)) & (T.word_count(s) > 3)
    ok = (F.length(s) >= 15) & ~T.is_boilerplate(s) & ~s.rlike("(?i)^https?://|^doi:") & (commas <= 4) & ~loud & ~s.rlike("(?i)" + V.any_of(V.NOT_IN_TITLE))
    k = first_lines(df, key, text, 30).where(ok).withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("line_no"))).where("r <= 15")
    return k.groupBy(key).agg(F.min_by("s", F.struct(-F.length(s), "line_no")).alias("title"))


def title_from_data(metadata_title: Column, stem: Column) -> Column:
    """The title in a document's data; without one the stem less its year, or in title case if that is under four words."""
    named = T.title_case(F.replace(F.replace(stem, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")))
    return F.coalesce(F.nullif(metadata_title, F.lit("")), T.title_from_stem(stem), named)


def resolve_titles(papers: DataFrame) -> DataFrame:
    """papers with `resolved`, the best title there is. papers: paper_id, stem, title, page_title, overview, introduction.

    In this order: the file's stem (four words without its year), the title in the data (without a year), the title found
    on the page (25 words at most), the first sentence of the overview, then of the introduction (30 words at most), the
    id in title case. Nulls count as empty.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    fits = lambda t, most: F.when(T.looks_like_title(t) & (T.word_count(t) <= most), t)
    data = T.trim_ws(F.regexp_replace(T.trim_ws(some("title")), rf"^\d{{4}}{T.WS}+", ""))
    sentence = lambda c: T.trim_ws(F.split(some(c), r"\.")[0])
    best = F.coalesce(
        T.title_from_stem(some("stem")), F.when(T.looks_like_title(data), data), fits(T.trim_ws(some("page_title")), 25),
        fits(sentence("overview"), 30), fits(sentence("introduction"), 30), T.title_case(F.replace("paper_id", F.lit("_"), F.lit(" "))),
    )
    return papers.withColumn("resolved", best)


def resolve_authors(df: DataFrame, key: str, text: str, metadata: str) -> DataFrame:
    """key, authors of every row: those in the data, else the first of the first 50 lines that lists names, else ''."""
    s = F.col("s")
    l = first_lines(df, key, text, 50)
    l = l.where(s.contains(" and ") & (F.length(s) - F.length(F.replace(s, F.lit(","), F.lit(""))) >= 2) & ~F.lower(s).rlike("|".join(V.INSTITUTIONS)))
    c = F.regexp_replace(T.trim_ws(F.regexp_replace(F.regexp_replace(s, r"\d+,?\d*", ""), r"\s+", " ")), "^,+|,+$", "")
    found = l.withColumn("c", c).where("length(c) > 10").groupBy(key).agg(F.min_by("c", "line_no").alias("_c"))
    own = F.nullif(T.trim_ws(F.coalesce(F.col(metadata), F.lit(""))), F.lit(""))
    return df.select(key, own.alias("_own")).join(found, key, "left").select(key, F.coalesce("_own", "_c", F.lit("")).alias("authors"))


def paper_doi(pages: DataFrame, key: str, page: str, text: str, last: int = 2) -> DataFrame:
    """key, doi: the first DOI on the first pages of each paper; papers without one give no row."""
    p = pages.where((F.col(page) >= 1) & (F.col(page) <= last)).withColumn("_d", T.doi(F.col(text))).where("_d <> ''")
    return p.groupBy(key).agg(F.min_by("_d", page).alias("doi"))
