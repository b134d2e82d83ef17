"""An approximate index: vectors in cells around centroids, of which a search reads the nearest few.

The centroids are fitted on a sample of at most `sample` rows (a documented bound); every row is indexed. The index is a
table with a folder for each cell, so that a search reads only the folders its queries need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _matrix(d: pd.Series) -> np.ndarray:
    return _unit(np.vstack([np.asarray(v, np.float64) for v in d]))


def sampled(vectors: DataFrame, key: str, vector: str, sample: int = 20_000) -> np.ndarray:
    """Unit vectors of the rows whose key hashes lowest, at most `sample`."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(vector).alias("v")).orderBy("h").limit(sample).collect()
    return _unit(np.array([r["v"] for r in rows], np.float64)) if rows else np.empty((0, 0))


def fit(m: np.ndarray, cells: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Centroids of unit length by spherical k-means."""
    if not len(m):
        return m
    c = m[np.random.default_rng(seed).choice(len(m), min(cells, len(m)), replace=False)]
    for _ in range(rounds):
        own = (m @ c.T).argmax(1)
        c = _unit(np.array([m[own == k].sum(0) if (own == k).any() else c[k] for k in range(len(c))]))
    return c


def probes_for(m: np.ndarray, centroids: np.ndarray, recall: float, k: int = 5, asked: int = 200) -> int:
    """How many cells must be read so that `asked` of the sample's vectors find that share of their k nearest in the sample.

    The larger the collection, the nearer the k nearest are and the fewer cells hold them, so the sample errs on the safe
    side.
    """
    q = m[:: max(1, len(m) // asked)][:asked]
    near = np.argsort(-(q @ m.T), axis=1)[:, :k]
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)  # of each cell in the query's order
    need = np.take_along_axis(place, (m @ centroids.T).argmax(1)[near], axis=1).reshape(-1)
    return int(np.quantile(need, recall, method="higher")) + 1


@dataclass
class Index:
    """Where the cells are, their centroids, how many a search reads, and the rows of each."""

    path: str
    centroids: np.ndarray
    probes: int
    sizes: dict[int, int]

    def share_read(self, queries: np.ndarray) -> float:
        """The share of the rows that each of the queries is compared with, on average."""
        near = np.argsort(-(_unit(queries) @ self.centroids.T), axis=1)[:, : self.probes]
        return float(np.mean([sum(self.sizes.get(int(c), 0) for c in row) for row in near]) / max(1, sum(self.sizes.values())))


def build(vectors: DataFrame, key: str, vector: str, path: str, recall: float = 0.93, sample: int = 20_000) -> Index:
    """An index of every row with a vector at path. The number of cells is the root of the rows', 16 to 4,096."""
    n = vectors.where(F.col(vector).isNotNull()).count()
    m = sampled(vectors, key, vector, sample)
    centroids = fit(m, int(min(4096, max(16, n**0.5))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                u = _matrix(d["_v"])
                yield pd.DataFrame({"_id": d["_id"], "cell": (u @ centroids.T).argmax(1), "unit": list(u.astype(np.float32))})

    v = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("_v"))
    placed = v.mapInPandas(run, "_id bigint, cell int, unit array<float>")
    # a cell's rows stand together, a large cell's in several files
    placed.repartition(F.col("cell"), F.pmod(F.xxhash64("_id"), F.lit(1 + n // 10_000_000))).write.partitionBy("cell").parquet(path)
    sizes = {r[0]: r[1] for r in vectors.sparkSession.read.parquet(path).groupBy("cell").count().collect()} if n else {}  # as many as cells
    return Index(path, centroids, probes_for(m, centroids, recall) if len(m) else 0, sizes)


def search(index: Index, queries: DataFrame, key: str, vector: str, k: int = 5, block: int = 10_000) -> DataFrame:
    """query_id, rank, key, distance of the k nearest rows found in the cells nearest to each query.

    queries: a stated set, taken in blocks of at most `block`; each block is broadcast as a matrix and reads only the
    folders of its cells. A row is compared with the queries that probe its cell, in one product for each batch and cell.
    """
    spark, out = queries.sparkSession, None
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("i"), F.col(vector).alias("v"))
    blocks = max(1, -(-q.count() // block))
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()
        if not rows or not index.sizes:
            continue
        asked, ids = _unit(np.array([r.v for r in rows], np.float64)), np.array([r.i for r in rows], np.int64)
        near = np.argsort(-(asked @ index.centroids.T), axis=1)[:, : index.probes]
        of = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
        shared = spark.sparkContext.broadcast((asked, ids, of))
        cells = spark.read.parquet(index.path).where(F.col("cell").isin(list(of)))
        part = cells.mapInPandas(lambda it, s=shared: _scored(it, *s.value, k), "query_id bigint, _id bigint, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"query_id bigint, rank int, {key} bigint, distance double")
    r = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "_id"))).where(F.col("rank") <= k)
    return r.select("query_id", "rank", F.col("_id").alias(key), F.round("distance", 4).alias("distance"))


def _scored(batches: Iterator[pd.DataFrame], asked: np.ndarray, ids: np.ndarray, of: dict[int, np.ndarray], k: int) -> Iterator[pd.DataFrame]:
    for d in batches:
        for cell, g in d.groupby("cell"):
            who = of[int(cell)]
            dist = 1 - np.vstack(list(g["unit"])).astype(np.float64) @ asked[who].T
            m = min(k, len(g))
            best = np.argpartition(dist, m - 1, axis=0)[:m]
            yield pd.DataFrame({"query_id": np.repeat(ids[who], m), "_id": g["_id"].to_numpy()[best].T.reshape(-1), "distance": np.take_along_axis(dist, best, 0).T.reshape(-1)})
