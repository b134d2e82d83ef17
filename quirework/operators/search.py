"""Nearest neighbours by cosine distance, and texts made of the hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def where(filters: dict) -> Column:
    """A metadata filter: {field: value}, {field: {"$eq": v}}, {field: {"$in": [...]}}, {"$and": [filters]}."""
    out = F.lit(True)
    for k, v in filters.items():
        if k == "$and":
            for f in v:
                out = out & where(f)
        elif isinstance(v, dict) and "$in" in v:
            out = out & F.col(k).isin(list(v["$in"]))
        else:
            out = out & (F.col(k) == (v["$eq"] if isinstance(v, dict) else v))
    return out


def type_filter(chunk_types: list[str] | None, default: list[str]) -> dict:
    """The filter of a search on chunk types: one by $eq, several by $in; none or empty means the default."""
    types = chunk_types or default
    return {"chunk_type": {"$eq": types[0]} if len(types) == 1 else {"$in": types}}


#: Bytes of query vectors that go to the executors at once; more queries are answered in several scans.
BLOCK_BYTES = 64 << 20


def _best(dist: np.ndarray, keys: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k least finite distances of each column, ties by key; a few more rows where the k-th is a tie."""
    kth = np.partition(dist, min(k, len(dist)) - 1, axis=0)[min(k, len(dist)) - 1]
    row, col = np.nonzero((dist <= kth) & np.isfinite(dist))
    b = pd.DataFrame({"query_id": ids[col], "_id": keys[row], "distance": dist[row, col]}).sort_values(["query_id", "distance", "_id"])
    return b[b.groupby("query_id").cumcount() < k]


def _scored(batches: Iterator[pd.DataFrame], queries: np.ndarray, ids: np.ndarray, kinds: list | None, k: int, step: int = 500) -> Iterator[pd.DataFrame]:
    best: list[list[pd.DataFrame]] = [[] for _ in range(0, len(ids), step)]
    for d in batches:
        if not len(d):
            continue
        m = np.vstack([np.asarray(v, np.float64) for v in d["_v"]])
        norm, keys = np.linalg.norm(m, axis=1), d["_id"].to_numpy()
        codes, names = pd.factorize(d["_kind"]) if kinds else (None, None)
        for no, at in enumerate(range(0, len(ids), step)):
            with np.errstate(divide="ignore", invalid="ignore"):
                dist = 1 - (m @ queries[at : at + step].T) / norm[:, None]
            dist = np.where(np.isnan(dist), np.inf, dist)
            if kinds:
                open_ = np.array([[x is None or n in x for x in kinds[at : at + step]] for n in names] + [[x is None for x in kinds[at : at + step]]])
                dist = np.where(open_[codes], dist, np.inf)
            best[no].append(_best(dist, keys, ids[at : at + step], k))
            if len(best[no]) > 16:
                best[no] = [_cut(best[no], k)]
    for b in best:
        if b:
            yield _cut(b, k)


def _cut(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    b = pd.concat(parts).sort_values(["query_id", "distance", "_id"])
    return b[b.groupby("query_id").cumcount() < k]


def nearest(vectors: DataFrame, key: str, vector: str, queries: list[tuple], k: int = 5, kind: str | None = None) -> DataFrame:
    """query_id, rank, key, distance: the k nearest rows of each query of a block, ties by key.

    queries: (id, vector) or, with kind, (id, vector, kinds): only rows whose `kind` is among a query's kinds count, all
    where its kinds are None. Each task keeps k rows of each query, so k rows times queries times tasks are shuffled.
    Null vectors are left out; a vector of zeros has the distance of no row (null).
    """
    q = np.array([x[1] for x in queries], np.float64).reshape(len(queries), -1)
    n = np.linalg.norm(q, axis=1, keepdims=True)
    ids, kinds = np.array([x[0] for x in queries], np.int64), [x[2] for x in queries] if kind else None
    shared = vectors.sparkSession.sparkContext.broadcast((q / np.where(n == 0, np.nan, n), ids, kinds))
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("_v"), *([F.col(kind).alias("_kind")] if kind else []))
    s = v.mapInPandas(lambda it: _scored(it, *shared.value, k), "query_id bigint, _id bigint, distance double")
    r = s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "_id"))).where(F.col("rank") <= k)
    return r.select("query_id", "rank", F.col("_id").alias(key), F.round("distance", 4).alias("distance"))


def distances(vectors: DataFrame, key: str, vector: str, query: list[float]) -> DataFrame:
    """key, distance of every row to one query, without ranks and so without a shuffle."""
    v = F.array(*(F.lit(float(x)) for x in query))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    c = F.col(vector)
    size = F.sqrt(dot(c, c)) * F.sqrt(dot(v, v))
    return vectors.where(c.isNotNull()).select(key, F.round(1 - dot(c, v) / F.nullif(size, F.lit(0.0)), 4).alias("distance"))


def nearest_blocks(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 5, kind: str | None = None, kinds: str | None = None, query_key: str | None = None, block: int | None = None) -> DataFrame:
    """nearest for a stated set of queries, in blocks of at most BLOCK_BYTES of vectors, or about `block` queries, a scan of
    the rows for each.

    kinds: the queries' array column of allowed kinds (see nearest). The queries are counted first; one block is the rule.
    """
    own = query_key or key
    q = queries.where(F.col(own).isNotNull() & F.col(vector).isNotNull()).select(F.col(own).cast("long").alias("i"), F.col(vector).alias("v"), *([F.col(kinds).alias("k")] if kinds else []))
    size = q.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = max(1, -(-size.n // block) if block else -(-size.n * (size.d or 1) * 8 // BLOCK_BYTES))
    out = None
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()
        rows = [(r.i, list(r.v), *([None if r.k is None else set(r.k)] if kinds else [])) for r in rows]
        if rows:
            part = nearest(vectors, key, vector, rows, k, kind)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, " + key + " bigint, distance double")


def band_counts(vectors: DataFrame, vector: str, queries: DataFrame, key: str) -> DataFrame:
    """query_id, band, n: how many rows stand in each band of distance to each query; counted by task, then summed up.

    queries are as many as are stated, a broadcast of at most BLOCK_BYTES at once. A vector of zeros is in no band.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("i"), F.col(vector).alias("v"))
    size = q.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks, out = max(1, -(-size.n * (size.d or 1) * 8 // BLOCK_BYTES)), None
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()
        m = np.array([list(r.v) for r in rows], np.float64).reshape(len(rows), -1)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        shared = vectors.sparkSession.sparkContext.broadcast((m / np.where(n == 0, np.nan, n), np.array([r.i for r in rows], np.int64)))
        part = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).alias("_v")).mapInPandas(lambda it, s=shared: _banded(it, *s.value), "query_id bigint, low boolean, mid boolean, n bigint")
        out = part if out is None else out.unionByName(part)
    name = F.when(F.col("low"), "very relevant").when(F.col("mid"), "relevant").otherwise("loosely related")
    return out.groupBy("query_id", name.alias("band")).agg(F.sum("n").alias("n"))


def _banded(batches: Iterator[pd.DataFrame], queries: np.ndarray, ids: np.ndarray, step: int = 500) -> Iterator[pd.DataFrame]:
    for d in batches:
        if not len(d) or not len(ids):
            continue
        m = np.vstack([np.asarray(v, np.float64) for v in d["_v"]])
        with np.errstate(divide="ignore", invalid="ignore"):
            m = m / np.linalg.norm(m, axis=1, keepdims=True)
        for at in range(0, len(ids), step):
            dist = np.round(1 - m @ queries[at : at + step].T, 4)
            low, mid, any_ = (x.sum(0) for x in (dist < 0.3, dist < 0.5, ~np.isnan(dist)))
            for a, b, n in ((True, True, low), (False, True, mid - low), (False, False, any_ - mid)):
                some = n > 0
                yield pd.DataFrame({"query_id": ids[at : at + step][some], "low": a, "mid": b, "n": n[some]})


def band(distance: Column) -> Column:
    return F.when(distance < 0.3, "very relevant").when(distance < 0.5, "relevant").otherwise("loosely related")


def with_fallback(targeted: DataFrame, broad: DataFrame, query: str) -> DataFrame:
    """targeted, and broad for the queries that have no targeted row."""
    return targeted.unionByName(broad.join(targeted.select(query).distinct(), query, "left_anti"))


def context(hits: DataFrame, keys: list[str], first_line: str = "Relevant publication excerpts:\n", chars: int = 1200) -> DataFrame:
    """keys, context: numbered hits with a header line and the beginning of each text. hits: rank, title, year,
    chunk_type, doi, content; at most a few for each key, as a search gives them."""
    head = F.format_string('[%d] "%s" (%s) — %s | DOI: %s', F.col("rank"), F.coalesce("title", F.lit("")), F.coalesce("year", F.lit("")), F.upper("chunk_type"), F.coalesce("doi", F.lit("")))
    line = F.concat(head, F.lit("\n    "), F.substring(F.coalesce("content", F.lit("")), 1, chars), F.lit("\n"))
    g = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return g.select(*keys, F.concat(F.lit(first_line + "\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("context"))




NO_HIT = "No relevant publications found for this query."


def context_or_none(queries: DataFrame, hits: DataFrame, keys: list[str], **kw) -> DataFrame:
    """context() for every query: a fixed sentence for those without a hit."""
    c = context(hits, keys, **kw)
    return queries.select(*keys).distinct().join(c, keys, "left").withColumn("context", F.coalesce("context", F.lit(NO_HIT)))


def summary(publications: DataFrame) -> DataFrame:
    """What stands in for excerpts where a search has none: each publication's title, year and source as JSON, and n, how
    many there are. One row for each, since a list of all may be of any length."""
    from quirework.operators.listing import count_of

    return publications.select(F.to_json(F.struct("title", "year", "source")).alias("entry"), count_of(publications).alias("n"))


def read_publications(spark, path: str) -> DataFrame:
    """title, year, journal of a JSON file that is a list of publications or an object with such a list."""
    one = "struct<title:string,year:string,journal:string>"
    df = spark.read.schema(f"publications array<{one}>, title string, year string, journal string").option("multiLine", True).json(path)
    alone = F.array(F.struct("title", "year", "journal"))
    return df.select(F.inline(F.coalesce("publications", alone)))
