"""The pN_ queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirework.storage import spread


def table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table; a small one is spread over the cores."""
    return spread(spark.read.parquet(f"{d}/{name}.parquet").select(*columns))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from quirework.llm.truncation import truncated

    return truncated(table(spark, d, "chunks", "row_id", "feed", "content", "caption"), "row_id", "feed", ["content", "caption"]).select("row_id", "field").distinct()


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    from quirework.llm.truncation import truncation_rates

    return truncation_rates(table(spark, d, "chunks", "row_id", "feed", "content", "caption"), "row_id", "feed", ["content", "caption"])


def _scans(spark: SparkSession, d: str):
    from quirework.llm.scans import Scans

    return Scans(table(spark, d, "chunks", "row_id", "title", "content", "caption"), "row_id", ["content", "caption"], title="title")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).found()


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).repaired()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from quirework.llm.split import oversized

    return oversized(spark.read.parquet(f"{d}/chunks.parquet"), "row_id", "content")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    from quirework.llm.split import split_texts

    return split_texts(spark.read.parquet(f"{d}/chunks.parquet"), "row_id", "content").drop("text_hash")


def p3_file_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All contents as large text files, cut by ranges of bytes."""
    from quirework.llm.common import scratch
    from quirework.llm.split import split_files

    at = scratch(spark, "texts")
    spark.read.parquet(f"{d}/chunks.parquet").select("content").where("content is not null").write.option("lineSep", "\n\n").text(at)
    return split_files(spark, [at]).drop("path")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from quirework.llm.names import entity_pairs

    pairs = entity_pairs(spark.read.parquet(f"{d}/author_credits.parquet"), "credit_id", "authors", "affiliation")
    return pairs.withColumnsRenamed({"key_a": "credit_id_a", "key_b": "credit_id_b"})


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    from quirework.llm.names import entities

    return entities(spark.read.parquet(f"{d}/author_credits.parquet"), "credit_id", "authors", "affiliation")


def _versions(spark: SparkSession, d: str):
    from quirework.llm.versions import Versions

    return Versions(table(spark, d, "chunks", "chunk_id", "title", "content"), "chunk_id", "title", "content", threshold=0.6, run=3, least_words=40)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).pairs().withColumnsRenamed({"key_a": "chunk_id_a", "key_b": "chunk_id_b"})


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).classes()


def p5_close(spark: SparkSession, d: str) -> DataFrame:
    """Classes of records that share four fifths of their runs of five words."""
    from quirework.llm.versions import CloseVersions

    return CloseVersions(table(spark, d, "chunks", "chunk_id", "title", "content"), "chunk_id", "title", "content", threshold=0.8, run=5).classes()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    from quirework.llm.packing import packed

    return packed(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p6_bucket_batches(spark: SparkSession, d: str) -> DataFrame:
    from quirework.llm.packing import bucket_batches

    return bucket_batches(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from quirework.llm.contamination import leaks

    return leaks(table(spark, d, "documents", "doc_id", "text"), spark.read.parquet(f"{d}/eval_items.parquet")).select("doc_id", "item_id").distinct()


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    from quirework.llm.contamination import without_leaks

    return without_leaks(table(spark, d, "documents", "doc_id", "text"), spark.read.parquet(f"{d}/eval_items.parquet"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from quirework.llm.stuffing import stuffed

    return stuffed(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id").distinct()


def p8_profiles(spark: SparkSession, d: str) -> DataFrame:
    from quirework.llm.stuffing import page_profiles

    return page_profiles(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_repaired, p3_found, p3_pieces, p3_file_pieces, p4_found, p4_entities, p5_found, p5_groups, p5_close, p6_containers, p6_bucket_batches, p7_found, p7_clean, p8_found, p8_profiles)}

SQL: dict[str, str] = {
    "p3_found": r"""
        SELECT DISTINCT row_id FROM chunks WHERE len(regexp_extract_all(content, '[^ \t\r\n]+')) > 1000""",
    "p7_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
        dg AS (SELECT doc_id, array_to_string(w[p : p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
        ig AS (SELECT item_id, array_to_string(w[p : p + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS p FROM i))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    # a word goes if a shared run of 13 words covers it, what stands between two words if one run covers both
    "p7_clean": r"""
        WITH d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS parts FROM documents),
        i AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
        g AS (SELECT DISTINCT array_to_string(w[p : p + 12], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 11)) AS p FROM i)),
        hit AS (SELECT doc_id, p FROM (SELECT doc_id, array_to_string(w[p : p + 12], ' ') AS g, p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)) JOIN g USING (g)),
        e AS (SELECT doc_id, k, parts[k] AS part, regexp_matches(parts[k], '^[\p{L}\p{N}]') AS is_word FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM d WHERE doc_id IN (SELECT doc_id FROM hit))),
        n AS (SELECT *, sum(CAST(is_word AS INT)) OVER (PARTITION BY doc_id ORDER BY k) AS no FROM e),
        l AS (SELECT n.*, max(p) OVER (PARTITION BY n.doc_id ORDER BY k) AS last FROM n LEFT JOIN hit ON n.doc_id = hit.doc_id AND is_word AND p = no),
        c AS (SELECT doc_id, coalesce(string_agg(part, '' ORDER BY k) FILTER (WHERE last IS NULL OR no + CAST(NOT is_word AS INT) - last > 12), '') AS text FROM l GROUP BY doc_id)
        SELECT * FROM c UNION ALL SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c)""",
}
