"""Problem 6: texts into containers of fixed capacity.

Sizes are counted once, with a public tokenizer, and written. The global histogram of sizes has at most `capacity`
entries, so the driver can plan on it: dynamic programming chooses the boundaries of length buckets that minimise the
padding of sizes to their bucket's boundary; then batches within the token budget are planned bucket by bucket, the
largest first. A batch begins in a bucket and its budget's rest is filled from lower buckets: batches of one bucket
alone leave much unused (see the README). A plan is a list of patterns (how many items of each bucket) with the number of containers
that use it, so its length depends on the number of buckets and not of texts. Items find their container by their rank
within their bucket, which comes from counts per salted part of the bucket: no bucket is ever in one task.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirework.llm.common import written

#: The folder of public tokenizers, unless a call names another file.
TOKENIZER = os.path.join(os.environ.get("QUIREWORK_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that divides text before byte pairs are merged, as published with this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


def tokenizer(path: str):
    """The byte-pair encoding of a vocabulary file of ranks; loaded once in a process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def longest(encoding) -> int:
    """Bytes of the longest token."""
    if not hasattr(encoding, "longest_token"):
        encoding.longest_token = max(map(len, encoding.token_byte_values()))
    return encoding.longest_token


def divided(text: str, capacity: int, encoding) -> list[tuple[int, int, int]]:
    """(start, stop, tokens) of the text, or of its pieces if it exceeds the capacity.

    A piece ends before a space or line break where there is one in its second half, so that its tokens are the same
    when it is encoded for itself; it is encoded again to make sure of its size.
    """
    if len(text) <= capacity * longest(encoding):  # else it can't fit, so a giant text is never encoded as a whole
        total = len(encoding.encode_ordinary(text))
        if total <= capacity:
            return [(0, len(text), total)]
    out, at = [], 0
    while at < len(text):
        size = capacity * 8  # characters, more than enough as a first guess; halved until it fits
        part = text[at : at + size]
        ids = encoding.encode_ordinary(part)
        if at + size >= len(text) and len(ids) <= capacity:
            out.append((at, len(text), len(ids)))
            break
        stop = at + len(part)
        if len(ids) > capacity:
            kept = encoding.decode_bytes(ids[:capacity])
            stop = at + len(kept.decode("utf-8", "ignore"))
        while True:
            low = at + (stop - at) // 2
            cut = max(text.rfind(" ", low, stop), text.rfind("\n", low, stop))
            end = cut if cut > at else stop
            n = len(encoding.encode_ordinary(text[at:end]))
            if n <= capacity or end - at <= 1:
                break
            stop = end if end < stop else at + max(1, (stop - at) * 9 // 10)
        out.append((at, end, n))
        at = end
    return out


def _sizes(batches: Iterator[pd.DataFrame], capacity: int, path: str) -> Iterator[pd.DataFrame]:
    enc = tokenizer(path)
    for d in batches:
        rows = [(k, i, a, b, n) for k, t in zip(d["_key"], d["_text"]) for i, (a, b, n) in enumerate(divided(t, capacity, enc))]
        yield pd.DataFrame(rows, columns=["_key", "piece_no", "start", "stop", "n_tokens"])


def bucket_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets that minimise the padding of all sizes to their bucket's bound.

    Dynamic programming over the sorted sizes, with the cost of a bucket by prefix sums. The best place of the bound
    before rises with the size, so each row of the table is found by divide and conquer, a level at a time:
    buckets x sizes x log(sizes) steps, all of them in arrays.
    """
    sizes = np.array(sorted(histogram), np.int64)
    n = len(sizes)
    if n <= buckets:
        return sizes.tolist()
    count = np.concatenate([[0], np.cumsum([histogram[int(s)] for s in sizes])]).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum([histogram[int(s)] * int(s) for s in sizes])]).astype(np.int64)
    levels, ranges = [], [(1, n - 1)]  # of each level the middles, and the places whose result bounds theirs
    while ranges:
        levels.append(tuple(np.array(x) for x in zip(*(((a + b) // 2, a - 1, b + 1) for a, b in ranges))))
        ranges = [r for a, b in ranges for r in ((a, (a + b) // 2 - 1), ((a + b) // 2 + 1, b)) if r[0] <= r[1]]
    best = sizes * count[1:] - tokens[1:]  # one bucket for the first j + 1 sizes
    back = np.zeros((buckets, n), np.int32)
    for k in range(1, buckets):
        at = np.zeros(n + 1, np.int64)  # where the bucket before ends, for each size
        at[n] = n - 2
        new, line = best.copy(), best + tokens[1:]
        for j, low, high in levels:
            first, last = at[low], np.minimum(at[high], j - 1)
            width = last - first + 1
            starts = np.cumsum(width) - width
            i = np.arange(int(width.sum())) - np.repeat(starts - first, width)
            cost = line[i] - np.repeat(sizes[j], width) * count[i + 1]
            least = np.minimum.reduceat(cost, starts)
            hits = np.flatnonzero(cost == np.repeat(least, width))
            at[j] = i[hits[np.searchsorted(hits, starts)]]
            total = least + sizes[j] * count[j + 1] - tokens[j + 1]
            better = total < new[j]
            new[j[better]], back[k, j[better]] = total[better], at[j[better]] + 1
        best = new
    bounds, j = [], n - 1
    for k in range(buckets - 1, -1, -1):
        bounds.append(int(sizes[j]))
        if back[k, j] == 0 and k:
            # as good with fewer buckets
            bounds.pop()
            continue
        j = int(back[k, j]) - 1
        if j < 0:
            break
    return bounds[::-1]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (items of each bound) and how many containers use each; every item of every bucket is placed once.

    A pattern takes the largest bound left, then always the largest that still fits; it is used as often as its
    scarcest bucket allows, so each pattern empties a bucket or takes it below its share.
    """
    left = {b: c for b, c in counts.items() if c}
    order = sorted(left)
    out = []
    while order:
        pattern: dict[int, int] = {}
        room, hi = capacity, len(order)
        while hi:
            hi = bisect.bisect_right(order, room, 0, hi)
            if not hi:
                break
            b = order[hi - 1]
            take = min(room // max(b, 1), left[b])
            pattern[b] = take
            room -= take * b
            hi -= 1
        times = min(left[b] // c for b, c in pattern.items())
        out.append((pattern, times))
        for b, c in pattern.items():
            left[b] -= c * times
            if not left[b]:
                order.pop(bisect.bisect_left(order, b))
    return out


def _sized(df: DataFrame, key: str, text: str, capacity: int, path: str) -> tuple[DataFrame, dict[int, int]]:
    """The table of pieces and sizes, and the histogram of sizes: at most `capacity` rows."""
    t = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text is not null")
    sized = written(t.mapInPandas(lambda it: _sizes(it, capacity, path), f"_key {dict(t.dtypes)['_key']}, piece_no bigint, start bigint, stop bigint, n_tokens bigint"), "sizes")
    return sized, {r[0]: r[1] for r in sized.groupBy(F.greatest("n_tokens", F.lit(1)).alias("n")).count().collect()}


def _placed(sized: DataFrame, bounds: list[int], slots: list[tuple[int, int, int, int]]) -> DataFrame:
    """sized with bucket (its bound) and container. slots: (bucket, first rank, items in each container, first container)."""
    spark = sized.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # salted parts of a bucket
    # rank within the bucket: rows of the parts before, then the place within the part
    cut = F.array(*(F.lit(b) for b in bounds))
    x = sized.withColumn("bucket", F.element_at(cut, (F.size(F.filter(cut, lambda b: b < F.col("n_tokens"))) + 1).cast("int")).cast("long"))
    x = x.withColumn("part", F.pmod(F.xxhash64("_key", "piece_no", "start"), F.lit(parts)))
    before = x.groupBy("bucket", "part").agg(F.count("*").alias("c")).withColumn("skip", F.sum("c").over(W.partitionBy("bucket").orderBy("part")) - F.col("c")).drop("c")
    x = x.withColumn("place", F.row_number().over(W.partitionBy("bucket", "part").orderBy("_key", "piece_no", "start")) - 1)
    x = x.join(before, ["bucket", "part"]).withColumn("rank", F.col("skip") + F.col("place"))
    # the slot with the greatest first rank not after the item's: slots of a bucket are a sorted array, few and small
    by = spark.createDataFrame(slots, "bucket bigint, first bigint, each bigint, base bigint").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("first", "each", "base"))).alias("slots"))
    x = x.join(F.broadcast(by), "bucket")  # as many rows as buckets
    x = x.withColumn("s", F.element_at(F.filter("slots", lambda s: s["first"] <= F.col("rank")), -1))
    return x.withColumn("container", (F.col("s.base") + F.floor((F.col("rank") - F.col("s.first")) / F.col("s.each"))).cast("long"))


def _counts(histogram: dict[int, int], bounds: list[int]) -> dict[int, int]:
    counts = dict.fromkeys(bounds, 0)
    for n, c in histogram.items():
        counts[bounds[bisect.bisect_left(bounds, n)]] += c
    return counts


def packed(df: DataFrame, key: str, text: str, capacity: int = 2048, buckets: int = 256, path: str = TOKENIZER) -> DataFrame:
    """key, piece_no, start, stop, n_tokens, container: where each text, or piece of an oversized text, goes.

    start and stop are the piece's code points. No container holds more than `capacity` tokens. Null texts give no
    rows; empty ones have no tokens and a place in a container. Repeated rows are each placed; a null key is a key.
    An empty table gives no rows.
    """
    sized, histogram = _sized(df, key, text, capacity, path)
    bounds = bucket_bounds(histogram, buckets)
    own = [F.col("_key").alias(key), "piece_no", "start", "stop", "n_tokens"]
    if not bounds:
        return sized.select(*own, F.lit(0).cast("long").alias("container"))
    slots, base, used = [], 0, dict.fromkeys(bounds, 0)
    for pattern, times in plan(_counts(histogram, bounds), capacity):
        for b, c in pattern.items():
            slots.append((b, used[b], c, base))
            used[b] += c * times
        base += times
    return _placed(sized, bounds, slots).select(*own, "container")


def bucket_batches(df: DataFrame, key: str, text: str, capacity: int = 2048, buckets: int = 256, path: str = TOKENIZER) -> DataFrame:
    """packed() with batches that stay inside their length bucket, and `bound`, the bucket's upper bound: every text of a
    container has at most that many tokens, so that little is padded; more room stays unused than in packed()."""
    sized, histogram = _sized(df, key, text, capacity, path)
    bounds = bucket_bounds(histogram, buckets)
    own = [F.col("_key").alias(key), "piece_no", "start", "stop", "n_tokens"]
    if not bounds:
        return sized.select(*own, F.lit(0).cast("long").alias("bound"), F.lit(0).cast("long").alias("container"))
    slots, base = [], 0
    for b, c in _counts(histogram, bounds).items():
        slots.append((b, 0, capacity // b, base))
        base -= -c // (capacity // b)
    return _placed(sized, bounds, slots).select(*own, F.col("bucket").alias("bound"), "container")
