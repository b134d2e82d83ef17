"""Problem 7: passages of evaluation items in documents.

The items' word n-grams go into a hash set that is broadcast; documents are scanned once, window by window, and each
hit is verified against the items' words and extended to the whole shared passage. The set is broadcast only up to
max_grams n-grams (counted first). Beyond that, a bitmap of the items' hashes is broadcast instead: documents' windows
that it lets pass are joined with the items' on their hashes and verified on their words. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirework.llm.common import WORD, bits_for, bits_of, by_size, flat_words, in_bits, lower_words, runs_hash, word_hashes, written

HITS = "doc_id bigint, text_hash bigint, item_id bigint, start bigint, stop bigint, n_words bigint"


def _grams(words: list[str], n: int) -> np.ndarray:
    return runs_hash(word_hashes(np.array(words, object)), n)


class _Index:
    """Items as words, and their n-grams' hashes as a sorted array with the places (item's number, first word)."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.items = [(i, lower_words(t)) for i, t in items]
        grams = [_grams(ws, n) for _, ws in self.items]
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        h = np.concatenate([*grams, np.empty(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.item = np.repeat(np.arange(len(grams)), sizes)[order]
        self.place = (np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]

        # a bitmap of the hashes' last bits: most of a corpus's windows end there
        self.bits = max(16, (16 * len(h)).bit_length())
        self.some = np.zeros(1 << self.bits, bool)
        self.some[self.hashes & np.uint64((1 << self.bits) - 1)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the hashes are known, and of each of these the first of its places and the one after the last."""
        at = np.flatnonzero(self.some[h & np.uint64((1 << self.bits) - 1)])
        low, high = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
        return at[low < high], low[low < high], high[low < high]


_built: dict = {}


def _index_of(shared, n: int) -> _Index:
    """The index of broadcast items, built once in each worker process."""
    key = (shared.value[0], n)
    if key not in _built:
        _built.clear()
        _built[key] = _Index(shared.value[1], n)
    return _built[key]


def passages(words: list[str], hits: list[tuple[int, int, int]], index: _Index, n: int) -> list[tuple[int, int, int]]:
    """(item_id, first word, word after the last) of the verified, longest shared passages that begin at a hit (word, and
    the range of its hash's places)."""
    out, covered = [], {}
    for p, low, high in hits:
        for k, q in zip(index.item[low:high].tolist(), index.place[low:high].tolist()):
            item_id, ws = index.items[k]
            if covered.get((k, p - q), -1) >= p or words[p : p + n] != ws[q : q + n]:
                continue
            e = n
            while p + e < len(words) and q + e < len(ws) and words[p + e] == ws[q + e]:
                e += 1
            covered[k, p - q] = p + e - n
            out.append((item_id, p, p + e))
    return out


def _scan(batches: Iterator[pd.DataFrame], shared, n: int) -> Iterator[pd.DataFrame]:
    index = _index_of(shared, n)
    for d in (b.iloc[x:y] for b in batches for x, y in by_size(list(b.text))):
        out = []
        texts = list(d.text)
        codes, distinct, counts = flat_words(texts)
        if len(codes) >= n:
            h = runs_hash(word_hashes(distinct)[codes], n)
            firsts = np.concatenate([[0], np.cumsum(counts)])
            hits, low, high = index.hits(h)
            doc = np.searchsorted(firsts, hits, "right") - 1
            ok = hits + n <= firsts[doc + 1]
            found = pd.DataFrame({"doc": doc[ok], "p": (hits - firsts[doc])[ok], "low": low[ok], "high": high[ok]})
            for k, g in found.groupby("doc"):
                spans = [m.span() for m in WORD.finditer(texts[k])]
                for item_id, x, y in passages(lower_words(texts[k]), list(zip(g.p.tolist(), g.low.tolist(), g.high.tolist())), index, n):
                    out.append((d.doc_id.iloc[k], d.text_hash.iloc[k], item_id, spans[x][0], spans[y - 1][1], y - x))
        yield pd.DataFrame(out, columns=["doc_id", "text_hash", "item_id", "start", "stop", "n_words"])


def _leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, max_grams: int = 2_000_000) -> DataFrame:
    """leaks with the hash of the document's text, by which rows with one id are told apart."""
    t = F.col(text)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text")).where("doc_id is not null and length(text) > 0")
    i = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and length(text) > 0").distinct()
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)")))
    size = i.agg(F.coalesce(F.sum(F.greatest(words - (n - 1), F.lit(0))), F.lit(0))).first()[0]
    if size > max_grams:
        return _joined(d, i, n, size)
    shared = d.sparkSession.sparkContext.broadcast((np.random.default_rng().integers(1 << 62), [(r.item_id, r.text) for r in i.collect()]))
    return d.mapInPandas(lambda it: _scan(it, shared, n), HITS)


def leaks(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """Passages of at least n words that a document shares with an item: doc_id, item_id, start, stop, n_words.

    Named: doc_id, text, item_id, item_text (columns), n (13), max_grams. Words are runs of letters and digits without
    regard to case. start and stop are the passage's code points in the document. Null or empty texts on either side and
    items of fewer than n words give no rows; repeated rows give repeated passages; rows with null ids are left out.
    """
    return _leaks(docs, items, **kw).drop("text_hash")


def _windows(batches: Iterator[pd.DataFrame], n: int, marks) -> Iterator[pd.DataFrame]:
    """The texts' windows of n words; with marks only those whose hash the bitmap may have."""
    for d in batches:
        for r in d.itertuples(index=False):
            words = lower_words(r.text)
            h = _grams(words, n)
            p = np.arange(len(h)) if marks is None else np.flatnonzero(in_bits(h, marks.value))
            if len(p):
                spans = np.array([m.span() for m in WORD.finditer(r.text)], np.int64).reshape(-1, 2)
                yield pd.DataFrame({**{c: getattr(r, c) for c in d.columns if c != "text"}, "p": p, "h": h[p].view(np.int64), "gram": [" ".join(words[k : k + n]) for k in p.tolist()], "start": spans[p, 0], "stop": spans[p + n - 1, 1]})


def _joined(d: DataFrame, i: DataFrame, n: int, size: int) -> DataFrame:
    """_leaks for more items than can be broadcast: windows that pass the bitmap are joined by hash and verified by their
    words; runs of hits become passages. Rows are told apart, so that repeated rows give repeated passages."""
    more = "p bigint, h bigint, gram string, start bigint, stop bigint"
    b = i.withColumn("row2", F.xxhash64("text")).mapInPandas(lambda it: _windows(it, n, None), f"item_id bigint, row2 bigint, {more}")
    b = written(b.select("item_id", "row2", F.col("p").alias("q"), "h", F.col("gram").alias("gram2")), "grams")
    bits = bits_for(size)
    shared = d.sparkSession.sparkContext.broadcast(bits_of(b, "h", bits))
    a = d.withColumn("row", F.monotonically_increasing_id()).mapInPandas(lambda it: _windows(it, n, shared), f"doc_id bigint, text_hash bigint, row bigint, {more}")
    hit = a.join(b, "h").where("gram = gram2").select("doc_id", "text_hash", "row", "item_id", "row2", "p", (F.col("p") - F.col("q")).alias("diagonal"), "start", "stop")
    by = ["doc_id", "text_hash", "row", "item_id", "row2", "diagonal"]
    run = hit.withColumn("run", F.col("p") - F.row_number().over(W.partitionBy(*by).orderBy("p")))
    g = run.groupBy(*by, "run").agg(F.count("*").alias("c"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return g.select("doc_id", "text_hash", "item_id", "start", "stop", (F.col("c") + n - 1).alias("n_words"))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        out = []
        for text, spans in zip(d.text, d.spans):
            for s in sorted(map(tuple, ((x["start"], x["stop"]) for x in spans)), reverse=True):
                text = text[: s[0]] + text[s[1] :]
            out.append(text)
        yield pd.DataFrame({"doc_id": d.doc_id, "text": out})


def without_leaks(docs: DataFrame, items: DataFrame, whole_documents: bool = False, **kw) -> DataFrame:
    """doc_id, text of docs without the leaked passages, or without the rows concerned.

    Passages that overlap or touch are cut out as one. Keeps null texts and null ids, and repeated rows. Named: as in leaks.
    """
    doc_id, text = kw.get("doc_id", "doc_id"), kw.get("text", "text")
    found = written(_leaks(docs, items, **kw).select("doc_id", "text_hash", "start", "stop").distinct(), "leaks")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    on = ["doc_id", "text_hash"]
    rest = base.join(found.select(*on).distinct(), on, "left_anti").select("doc_id", "text")
    if whole_documents:
        return rest
    spans = found.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("s"))
    merge = """aggregate(s, cast(array() as array<struct<start:bigint,stop:bigint>>), (a, x) ->
        if(size(a) > 0 and element_at(a, -1).stop >= x.start,
           concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'stop', greatest(element_at(a, -1).stop, x.stop)))),
           concat(a, array(x))))"""
    spans = spans.select(*on, F.expr(merge).alias("spans"))
    return rest.unionByName(base.join(spans, on).select("doc_id", "text", "spans").mapInPandas(_cut, "doc_id bigint, text string"))
