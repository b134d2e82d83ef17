"""Problem 5: near-duplicate records, by prefixes under several global token orders.

A record is the set of its runs of `run` consecutive words (its tokens). Every order is a global order of all tokens,
given by a seeded hash. Two records are candidates if they share their prefix tokens under all `each` orders of one of
`groups` groups of orders, and if their prefix tokens under all the orders together agree as often as similar records'
do (one bit for each order). Only what passes these filters is verified, on the records' whole token sets.

Prefixes have one token, which makes this MinHash banding: `groups` bands of `each` hashes. An exact prefix of
(1 - threshold) of a record's tokens makes candidates of nearly all pairs of records at a threshold of 0.6; with prefixes
of one token a pair of similarity s is lost with the probability (1 - s^each)^groups: 0.0002 at 0.6, 0.000008 at 0.65
(each=4, groups=60).

`pairs` lists all links, which are as many as there are. `classes` needs no pairs within a family: each text is verified
against the least text of each of its prefixes, and then only against texts of the same prefix that this left in another
class, so that no link between different classes is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import flat_words, lower_words, mix, only_in, runs_hash, word_hashes, written


def token_sets(texts: list[str], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts one after another (repeated ones too), and the number of each text's."""
    codes, distinct, counts = flat_words(texts)
    h = runs_hash(word_hashes(distinct)[codes], run)
    n = np.maximum(counts - run + 1, 0)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    place = np.arange(int(n.sum())) + np.repeat(firsts - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return h[place], n


def order_seeds(n: int) -> np.ndarray:
    """One odd multiplier for each order."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def prefixes(tokens: np.ndarray, counts: np.ndarray, orders: int) -> np.ndarray:
    """The first token of each text under each order, as its place in the order; texts without tokens are left out."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[counts > 0]
    out = np.empty((orders, len(starts)), np.uint64)
    with np.errstate(over="ignore"):
        for k, m in enumerate(order_seeds(orders)):
            out[k] = np.minimum.reduceat(tokens * m, starts)
    return out


def _sign(batches: Iterator[pa.RecordBatch], least_words: int, run: int, each: int, groups: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # a text is given once for each task
    orders = each * groups
    for b in batches:
        ids, titles, contents = (b.column(k).to_pylist() for k in range(3))
        fresh = []
        for k, i in enumerate(ids):
            if i not in seen:
                seen.add(i)
                fresh.append(k)
        _, _, n_words = flat_words([contents[k] for k in fresh])
        fresh = [k for k, n in zip(fresh, n_words.tolist()) if n >= least_words]
        for at in range(0, len(fresh), 2000):
            part = fresh[at : at + 2000]
            tokens, counts = token_sets([f"{titles[k]} {contents[k]}" for k in part], run)
            part = [k for k, n in zip(part, counts.tolist()) if n]
            if not part:
                continue
            p = prefixes(tokens, counts, orders)
            keys = np.empty((len(part), groups), np.uint64)
            with np.errstate(over="ignore"):
                for g in range(groups):
                    key = np.full(len(part), np.uint64(g + 1))
                    for k in range(each):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + p[g * each + k])
                    keys[:, g] = key
            # the place's high bits are small in a first token, so the bit is taken from a mixture
            bits = (mix(p) & np.uint64(1)).astype(np.uint8).T
            sketch = np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, -orders % 64))), axis=1)).view(np.int64)
            lists = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a.reshape(-1)), a.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in part], pa.int64()), lists(keys.view(np.int64)), lists(np.ascontiguousarray(sketch))], ["text_id", "keys", "sketch"])


def _verify(batches: Iterator[pd.DataFrame], run: int) -> Iterator[pd.DataFrame]:
    for d in batches:
        known: dict[int, frozenset] = {}
        sims = []
        for pair in zip(d["text_a"], d["text_b"], d["record_a"], d["record_b"]):
            for i, record in zip(pair[:2], pair[2:]):
                if i not in known:
                    w = lower_words(record)
                    known[i] = frozenset(zip(*(w[k:] for k in range(run))))
            a, b = known[pair[0]], known[pair[1]]
            both = len(a & b)
            sims.append(both / (len(a) + len(b) - both))
        yield pd.DataFrame({"text_a": d["text_a"], "text_b": d["text_b"], "similarity": np.array(sims, float)})


class Versions:
    """Links between the distinct texts of a table, and the rows of each text."""

    def __init__(self, df: DataFrame, key: str, title: str, content: str, threshold: float = 0.8, run: int = 5, least_words: int = 1, each: int = 4, groups: int = 60):
        """A record is title, a space and content; null counts as empty. Contents of fewer than least_words words, and
        records of fewer than `run` words, take no part. Texts are told apart by a hash of 64 bits."""
        self.orders = each * groups
        self._read(df, key, title, content, threshold, run, least_words)
        self._post(self._texts().mapInArrow(lambda it: _sign(it, least_words, run, each, groups), "text_id bigint, keys array<bigint>, sketch array<bigint>"))

    def _read(self, df: DataFrame, key: str, title: str, content: str, threshold: float, run: int, least_words: int) -> None:
        self.key, self.threshold, self.run = key, threshold, run
        t, c = F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(content), F.lit(""))
        rows = df.select(F.col(key).alias("_key"), t.alias("title"), c.alias("content")).withColumn("text_id", F.xxhash64("title", F.lit("\x01"), "content"))
        # n words have at least 2 n - 1 characters
        self._rows = rows.where(F.length("content") >= 2 * least_words - 1).withColumnRenamed("_key", key)

    def _texts(self) -> DataFrame:
        return self._rows.select("text_id", "title", "content")

    def _post(self, sign: DataFrame) -> None:
        """sign: text_id, keys (prefixes), sketch (what the other orders tell)."""
        self.signed = written(sign, "signed")
        # texts that share a prefix with another: prefixes are counted, which a hot one only costs a row for each task,
        # and the posts of the others end at a bitmap of the shared ones before they are shuffled
        posts = self.signed.select("text_id", F.explode("keys").alias("prefix"))
        shared = written(posts.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix"), "prefixes")
        posts = only_in(posts, "prefix", shared)
        sketches = self.signed.groupBy("text_id").agg(F.any_value("sketch").alias("sketch"))
        #: prefix, text_id, sketch of the shared prefixes.
        self.posts = written(posts.distinct().join(sketches, "text_id"), "posts")

    def _near(self, a: str, b: str) -> Column:
        """Whether two sketches agree as similar records' do: in (1 + s) / 2 of the bits, less five standard deviations.
        Tested inside the join, so that dissimilar pairs are never shuffled."""
        apart = F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
        return apart <= int(self.orders * (1 - self.threshold) / 2 + 5 * math.sqrt(self.orders * (1 - self.threshold**2) / 4))

    def _verified(self, pairs: DataFrame, what: str) -> DataFrame:
        """text_a, text_b, similarity of the candidates that are similar, on their whole texts; written."""
        pairs = written(pairs.distinct(), f"candidates-{what}")
        ids = written(pairs.select(F.explode(F.array("text_a", "text_b")).alias("text_id")).distinct(), f"ids-{what}")
        texts = only_in(self._rows.select("text_id", F.concat_ws(" ", "title", "content").alias("record")), "text_id", ids).dropDuplicates(["text_id"])
        for x in "ab":
            pairs = pairs.join(texts.select(F.col("text_id").alias(f"text_{x}"), F.col("record").alias(f"record_{x}")), f"text_{x}")
        run = self.run
        return written(pairs.mapInPandas(lambda it: _verify(it, run), "text_a bigint, text_b bigint, similarity double").where(F.col("similarity") >= self.threshold), f"links-{what}")

    @cached_property
    def links(self) -> DataFrame:
        """text_a < text_b, similarity: one row for each pair of different texts at least as similar as the threshold."""
        a, b = (self.posts.select("prefix", F.col("text_id").alias(f"text_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
        return self._verified(a.join(b, "prefix").where((F.col("text_a") < F.col("text_b")) & self._near("sketch_a", "sketch_b")).select("text_a", "text_b"), "all")

    def _members_of(self, ids: DataFrame) -> DataFrame:
        """text_id, key of the rows with these texts; only they are shuffled."""
        return only_in(self._rows.select("text_id", self.key), "text_id", ids).distinct()

    def pairs(self) -> DataFrame:
        """key_a < key_b of all rows with different keys whose texts are linked or the same: by definition as many as there are."""
        m = self._members_of(written(self.links.select(F.explode(F.array("text_a", "text_b")).alias("text_id")).distinct(), "linked"))
        a, b = (m.select(F.col("text_id").alias(f"text_{x}"), F.col(self.key).alias(f"key_{x}")) for x in "ab")
        linked = self.links.join(a, "text_a").join(b, "text_b").where("key_a <> key_b").select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))
        h = F.xxhash64(self.key)
        twice = self._rows.groupBy("text_id").agg(F.min(h).alias("x"), F.max(h).alias("y")).where("x <> y").select("text_id")
        same = self._members_of(written(twice.join(self.signed.select("text_id"), "text_id", "left_semi"), "twice"))
        same = same.alias("p").join(same.alias("q"), "text_id").where(F.col(f"p.{self.key}") < F.col(f"q.{self.key}")).select(F.col(f"p.{self.key}").alias("key_a"), F.col(f"q.{self.key}").alias("key_b"))
        return linked.unionByName(same).distinct()

    @cached_property
    def stars(self) -> DataFrame:
        """text_a, text_b: links enough to tell the classes. As many as texts times the few least texts they share
        prefixes with, and those between texts of a prefix that the first ones leave in different classes."""
        least = self.posts.groupBy("prefix").agg(F.min(F.struct("text_id", "sketch")).alias("l")).select("prefix", F.col("l.text_id").alias("text_a"), F.col("l.sketch").alias("sketch_a"))
        first = self.posts.join(least, "prefix").where((F.col("text_id") > F.col("text_a")) & self._near("sketch_a", "sketch")).select("text_a", F.col("text_id").alias("text_b"))
        first = self._verified(first, "stars")
        label = _labels(first).select(F.col("text_a").alias("text_id"), "label")
        posts = self.posts.join(label, "text_id", "left").withColumn("label", F.coalesce("label", "text_id"))
        # prefixes with texts of several classes: those outside the least text's class meet the others
        main = posts.groupBy("prefix").agg(F.min(F.struct("text_id", "label")).alias("m"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
        posts = written(posts.join(main.select("prefix", F.col("m.label").alias("main")), "prefix"), "strays")
        a = posts.where("label <> main").select("prefix", F.col("text_id").alias("a"), F.col("label").alias("label_a"), F.col("sketch").alias("sketch_a"))
        b = posts.select("prefix", F.col("text_id").alias("b"), F.col("label").alias("label_b"), "main", F.col("sketch").alias("sketch_b"))
        met = a.join(b, "prefix").where(((F.col("label_b") == F.col("main")) | (F.col("label_a") < F.col("label_b"))) & self._near("sketch_a", "sketch_b"))
        rest = self._verified(met.select(F.least("a", "b").alias("text_a"), F.greatest("a", "b").alias("text_b")), "strays")
        return written(first.unionByName(rest).select("text_a", "text_b").distinct(), "stars")

    def classes(self) -> DataFrame:
        """key, class_id, n_same: one row for each key and text that takes part.

        class_id is the least text_id that links lead to, n_same the number of rows with the same text.
        """
        label = _labels(self.stars).select(F.col("text_a").alias("text_id"), "label")
        rows = self._rows.select("text_id", self.key).join(self.signed.select("text_id"), "text_id", "left_semi")
        each = rows.groupBy("text_id", self.key).agg(F.count("*").alias("n"))  # copies of a text are summed up first
        same = each.groupBy("text_id").agg(F.sum("n").alias("n_same"))
        return each.join(same, "text_id").join(label, "text_id", "left").select(self.key, F.coalesce("label", "text_id").alias("class_id"), "n_same")


class CloseVersions(Versions):
    """Versions for high thresholds, by exact prefixes under several global orders: no pair is lost.

    Two records at least as similar as the threshold t share a token among the first n - ceil(t n) + 1 of their n tokens
    under every global order. The orders put rare tokens first (by a table of `buckets` counts over all records, which
    may be shared by several tokens: an order needs no exact counts) and break ties by seeded hashes. Candidates share a
    prefix token under the first order, and the filters of the other orders are intersected inside the join. At a low
    threshold prefixes hold so many tokens that Versions is the cheaper way.
    """

    def __init__(self, df: DataFrame, key: str, title: str, content: str, threshold: float = 0.8, run: int = 5, least_words: int = 1, orders: int = 3, buckets: int = 1 << 20):
        """As Versions; buckets is a power of two: at most so many rows of 12 bytes come to the driver, a byte for each
        bucket is broadcast."""
        self.orders = orders
        self._read(df, key, title, content, threshold, run, least_words)
        counts = self._texts().mapInArrow(lambda it: _bucket_counts(it, least_words, run, buckets), "bucket int, n bigint")
        table = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        levels = np.zeros(buckets, np.uint8)
        levels[table.column("bucket").to_numpy()] = np.log2(table.column("n").to_numpy())
        shared = df.sparkSession.sparkContext.broadcast(levels)
        sign = self._texts().mapInArrow(lambda it: _prefix_sign(it, least_words, run, threshold, orders, shared), "text_id bigint, keys array<bigint>, sketch struct<n:int,others:array<array<bigint>>>")
        self._post(sign)

    def _near(self, a: str, b: str) -> Column:
        """Whether sizes allow the threshold and the prefixes under each other order share a token."""
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        out = (n >= m * self.threshold - 1e-9) & (m >= n * self.threshold - 1e-9)
        for k in range(self.orders - 1):
            out = out & F.arrays_overlap(F.col(f"{a}.others")[k], F.col(f"{b}.others")[k])
        return out


def _fresh(batches: Iterator[pa.RecordBatch], least_words: int, run: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Texts that take part, each once for a task: their ids and their different tokens, sorted."""
    seen: set[int] = set()
    for b in batches:
        ids, titles, contents = (b.column(k).to_pylist() for k in range(3))
        for at in range(0, len(ids), 2000):
            part = [k for k in range(at, min(at + 2000, len(ids))) if ids[k] not in seen and not seen.add(ids[k])]
            _, _, n_words = flat_words([contents[k] for k in part])
            part = [k for k, n in zip(part, n_words.tolist()) if n >= least_words]
            tokens, counts = token_sets([f"{titles[k]} {contents[k]}" for k in part], run)
            sets = [np.unique(x) for x in np.split(tokens, np.cumsum(counts)[:-1])] if part else []
            yield [ids[k] for k, x in zip(part, sets) if len(x)], [x for x in sets if len(x)]


def _bucket_counts(batches: Iterator[pa.RecordBatch], least_words: int, run: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for _, sets in _fresh(batches, least_words, run):
        if sets:
            total += np.bincount((np.concatenate(sets) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])


def _prefix_sign(batches: Iterator[pa.RecordBatch], least_words: int, run: int, threshold: float, orders: int, shared) -> Iterator[pa.RecordBatch]:
    levels, seeds = shared.value, order_seeds(orders)
    kind = pa.struct([("n", pa.int32()), ("others", pa.list_(pa.list_(pa.int64())))])
    for ids, sets in _fresh(batches, least_words, run):
        keys, sketches = [], []
        for u in sets:
            level = levels[(u & np.uint64(len(levels) - 1)).astype(np.int64)]
            size = len(u) - math.ceil(threshold * len(u) - 1e-9) + 1
            with np.errstate(over="ignore"):
                first = [u[np.lexsort((mix(u * m), level))[:size]].view(np.int64).tolist() for m in seeds]
            keys.append(first[0])
            sketches.append({"n": len(u), "others": first[1:]})
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, kind)], ["text_id", "keys", "sketch"])


def _labels(links: DataFrame) -> DataFrame:
    """text_a, label: the least text that links lead to. Labels spread along links and jump to their own labels, so that a
    chain of n links needs about log n rounds; each round is a written table."""
    l = links.select("text_a", "text_b")
    edges = written(l.unionByName(l.select(F.col("text_b").alias("text_a"), F.col("text_a").alias("text_b"))), "edges")
    label = written(edges.groupBy("text_a").agg(F.least(F.min("text_b"), F.first("text_a")).alias("label")), "label")
    while True:
        near = edges.join(label.select(F.col("text_a").alias("text_b"), "label"), "text_b").groupBy("text_a").agg(F.min("label").alias("near"))
        step = label.join(near, "text_a").select("text_a", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = label.select(F.col("text_a").alias("label"), F.col("label").alias("far"))
        step = written(step.join(jump, "label", "left").select("text_a", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "label")
        label = step.select("text_a", "label")
        if step.where("old <> label").isEmpty():
            return label
