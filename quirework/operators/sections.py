"""Segmentation of texts into canonical sections, by windows over their lines.

Keys are document keys; every window is partitioned by one, so its size is that of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.functions import vocabularies as V


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 0), line."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def canonical(header: Column) -> Column:
    """The first canonical name with a matching alias, else other."""
    h = T.trim_ws(T.unspaced(header))
    out = None
    for name, patterns in V.SECTION_ALIASES.items():
        hit = h.rlike("(?i)" + V.any_of(patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def is_header(line: Column, boilerplate: Column | None = None) -> Column:
    """Gates in order of cost: a known alias is taken at once, the rest must look like a header and not like text.
    boilerplate: whether the line is that, where it is known."""
    s = T.trim_ws(line)
    norm = T.unspaced(s)
    last = F.lower(F.regexp_extract(s, r"([^ \t\n\r\f\x0B]+)$", 1))
    inner = F.regexp_extract(s, r"^[^ ]*( .*)$", 1)
    refused = (
        s.rlike("(?i)^(" + "|".join(V.SENTENCE_STARTS) + r")\s")
        | ((F.length(s) > 20) & (last.isin(V.CUT_WORDS) | s.rlike("(?i)(" + "|".join(V.CUT_STEMS) + ")$")))
        | inner.rlike(r"[\p{L}\p{N}_]\.\s+[A-Z]")
        | s.rlike(V.INLINE_CITATION)
        | s.rlike("(?i)" + V.DOSAGE)
        | (F.length(s) - F.length(F.replace(s, F.lit(","), F.lit(""))) >= 2)
        | s.rlike("(?i)" + V.any_of(V.HEADER_REFUSED))
        | (s.endswith(".") & (T.word_count(s) > 5))
    )
    return (
        F.when((s == "") | (F.length(s) > 80), False)
        .when(T.is_boilerplate(s) if boilerplate is None else boilerplate, False)
        .when(canonical(s) != "other", True)
        .when(refused, False)
        .otherwise(norm.rlike(V.any_of(V.HEADER_SHAPES)))
    )


def headers(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, header, canonical."""
    return lines(df, key, text).where(is_header(F.col("line"))).select(key, "line_no", T.trim_ws(F.col("line")).alias("header"), canonical(F.col("line")).alias("canonical"))


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, section_no, canonical, raw_header, confidence, content, start_line, is_subsection; empty bodies included.

    Section 0 is what stands before the first header: an implied overview if it has more than 30 words, else left out.
    A section of no known kind takes that of the last known section before it, unless that is references,
    acknowledgements or supplementary.
    """
    w = W.partitionBy(key).orderBy("line_no")
    # each line is matched once: what is no part of a body is known before lines are shuffled
    l = lines(df, key, text).withColumn("boiler", T.is_boilerplate(F.col("line"))).withColumn("head", is_header(F.col("line"), F.col("boiler")))
    l = l.withColumn("kept", ~F.col("head") & ~F.col("boiler") & ~T.is_figure_label(F.col("line"))).withColumn("section_no", F.sum(F.col("head").cast("int")).over(w))
    s = l.groupBy(key, "section_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("line_no", "line")))).alias("body"),
        F.max(F.when(F.col("head"), F.col("line"))).alias("raw"),
        F.min("line_no").alias("start_line"),
    )
    s = s.withColumn("content", T.body_text(F.transform("body", lambda x: x["line"])))
    s = s.where((F.col("section_no") > 0) | (T.word_count(F.col("content")) > 30))
    own = F.when(F.col("section_no") == 0, "overview").otherwise(canonical(F.col("raw")))
    s = s.withColumn("own", own)
    o = W.partitionBy(key).orderBy("section_no")
    before = F.last(F.when(F.col("own") != "other", F.col("own")), ignorenulls=True).over(o.rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("parent", F.when(F.col("own") == "other", before))
    takes = F.col("parent").isNotNull() & ~F.col("parent").isin("references", "acknowledgements", "supplementary")
    return s.select(
        key, F.col("section_no").cast("int").alias("section_no"),
        F.when(takes, F.col("parent")).otherwise(F.col("own")).alias("canonical"),
        T.trim_ws(F.coalesce("raw", F.lit(""))).alias("raw_header"),
        F.when(F.col("section_no") == 0, "implicit").when(takes, F.concat(F.lit("inherited:"), "parent")).when(F.col("own") == "other", "unknown").otherwise("regex").alias("confidence"),
        "content", "start_line", F.coalesce(takes, F.lit(False)).alias("is_subsection"),
    )


def merged(s: DataFrame, key: str, skip: list[str] = ()) -> DataFrame:
    """key, canonical, content, confidence: non-empty bodies of a kind in document order, with a blank line between."""
    g = s.where((F.col("content") != "") & ~F.col("canonical").isin(list(skip))).groupBy(key, "canonical")
    parts = F.array_sort(F.collect_list(F.struct("section_no", "content")))
    return g.agg(F.array_join(F.transform(parts, lambda x: x["content"]), "\n\n").alias("content"), F.min_by("confidence", "section_no").alias("confidence"))


def unmatched(s: DataFrame, key: str) -> DataFrame:
    """key, raw_header of the sections that stay other."""
    return s.where((F.col("canonical") == "other") & (F.col("content") != "") & ~F.col("is_subsection")).select(key, "raw_header")


def results_repair(df: DataFrame, key: str, text: str, least_words: int = 20) -> DataFrame:
    """key, results: what stands between a line Results and the next known header line, if longer than least_words."""
    l = lines(df, key, text)
    start = l.where(F.col("line").rlike(r"^\s*Results\s*$")).groupBy(key).agg(F.min("line_no").alias("first"))
    l = l.join(start, key).where("line_no > first")
    stop = F.min(F.when(F.col("line").rlike(V.AFTER_RESULTS), F.col("line_no"))).over(W.partitionBy(key))
    l = l.withColumn("stop", stop).where("stop is null or line_no < stop")
    body = l.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("b"))
    body = body.select(key, T.trim_ws(F.array_join(F.transform("b", lambda x: x["line"]), "\n")).alias("results"))
    return body.where(T.word_count(F.col("results")) > least_words)


def classify_unmatched(s: DataFrame, key: str, chat) -> DataFrame:
    """sections whose kind a provider may tell from the header: each distinct header is asked for once, and an answer
    that is no canonical name leaves the section as it is."""
    from quirework.operators.providers import answered

    asked = answered(unmatched(s, key).select("raw_header").where("raw_header <> ''").distinct(), "raw_header", chat, "_said")
    known = asked.where(F.col("_said").isin(list(V.SECTION_ALIASES)))
    out = s.join(known, "raw_header", "left")
    use = (F.col("canonical") == "other") & F.col("_said").isNotNull() & ~F.col("is_subsection")
    return out.withColumn("confidence", F.when(use, "llm").otherwise(F.col("confidence"))).withColumn("canonical", F.when(use, F.col("_said")).otherwise(F.col("canonical"))).select(*s.columns)
