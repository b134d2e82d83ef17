"""What the operators of this subpackage share: written tables, bitmaps of bounded size, vectorised words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.storage import scratch, written  # noqa: F401

#: A longest run of letters and digits.
WORD = re.compile(r"[^\W_]+")

#: A line that is only a page number, and one that is only a number.
PAGE = re.compile(r"[\W_]*(?:pages?|p|pp|seite|página|pág|s)?[\W_]*\d{1,5}(?:\s*(?:of|/|von|de|sur|-|–)\s*\d{1,5})?[\W_]*$", re.I)
NUMBER = re.compile(r"\s*\d+\s*$")

#: Words of a bitmap have 63 bits, so that no sign bit is touched.
BITS_PER_WORD = 63


def only_in(df: DataFrame, key: str, keys: DataFrame, most: int = 1 << 20) -> DataFrame:
    """The rows of df whose key is among the keys (a column of that name, without repeats).

    Up to `most` keys, a broadcast bitmap of 16 bits or more for each (2^24 bits: 266,306 rows of 16 bytes) keeps nearly
    all other rows from being shuffled; beyond, df is joined as it is. The rows are the same.
    """
    n = keys.count()
    if n <= most:
        bits = bits_for(n, 16)
        s = F.pmod(F.xxhash64(key), F.lit(bits))
        word, bit = (s / BITS_PER_WORD).cast("long"), (s % BITS_PER_WORD).cast("int")
        marks = keys.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_mask"))
        df = df.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(marks), "_word").where(F.call_function("shiftright", F.col("_mask"), F.col("_bit")).bitwiseAND(F.lit(1)) == 1)
        df = df.drop("_word", "_bit", "_mask")
    return df.join(keys, key)  # a semi-join would be planned below the filter


#: Bits that stand for a key in the bitmaps that Python reads.
PLACES = 4


def bits_of(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """A bitmap of 64-bit keys; bits is a power of two. Each key sets PLACES bits, told by the two halves of its hash. At
    most bits / 32 rows of 8 bytes come to the driver."""
    k = F.col(key)
    step = F.call_function("shiftrightunsigned", k, F.lit(32)).bitwiseOR(F.lit(1))
    s = F.explode(F.array(*((k + step * j).bitwiseAND(F.lit(bits - 1)) for j in range(PLACES)))).alias("s")
    got = (
        keys.where(k.isNotNull()).select(s)
        .select((F.col("s") / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s") % 32).cast("int")).alias("m"))
        .groupBy("w").agg(F.bit_or("m").alias("m"))
    )
    table = got.toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[table.column("w").to_numpy()] = table.column("m").to_numpy().astype(np.uint32)
    return out


def in_bits(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys the bitmap may have."""
    h = h.astype(np.uint64)
    left, size = np.arange(len(h)), np.uint64(len(bits) * 32 - 1)
    with np.errstate(over="ignore"):
        for j in range(PLACES):
            k = h[left]
            s = (k + ((k >> np.uint64(32)) | np.uint64(1)) * np.uint64(j)) & size
            left = left[(bits[(s >> np.uint64(5)).astype(np.int64)] >> (s & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1]
    out = np.zeros(len(h), bool)
    out[left] = True
    return out


def bits_for(n: int, each: int = 32, most: int = 1 << 28) -> int:
    """Bits of a bitmap for n keys: a power of two, `each` or more for a key, at least 4096; at most `most` (32 MiB), beyond
    which more other keys pass and none is lost. With 32 bits for a key 2 of 10,000 other keys pass (PLACES bits a key)."""
    return min(most, 1 << max(12, (max(1, n) * each - 1).bit_length()))


def by_size(texts: list[str], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Slices (from, to) of texts with about `most` characters each, one text at least, so that arrays over their words stay
    small whatever a batch holds."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def lower_words(text: str) -> list[str]:
    """The words of a text in lower case, one for each match of WORD in the text as it stands."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def flat_words(texts: list[str | None], pattern: re.Pattern = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts in lower case: (codes of the words one after another, distinct words, number per text)."""
    lists = [(lower_words(t) if pattern is WORD else pattern.findall(t.lower())) if t else [] for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.empty(int(counts.sum()), object)
    at = 0
    for ws in lists:
        flat[at : at + len(ws)] = ws
        at += len(ws)
    codes, distinct = pd.factorize(flat)
    return codes, np.asarray(distinct, object), counts


def word_hashes(distinct: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return pd.util.hash_array(distinct, categorize=False) if len(distinct) else np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def runs_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive elements of h, by place of the first; len(h) - n + 1 of them."""
    with np.errstate(over="ignore"):
        m = max(0, len(h) - n + 1)
        out = np.zeros(m, np.uint64)
        for k in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
        return out
