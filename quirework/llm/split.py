"""Problem 3: cut oversized texts into overlapping pieces at natural boundaries, by ranges with halos.

A text is divided into ranges, each read with a halo on both sides. A range's worker finds the words that start in it
and the kind of gap before each (its boundary table). Prefix sums over the ranges' word counts tell which texts are
oversized and number the pieces; a range cuts its own words, so it needs of the ranges before it only the last
boundaries. A range hands the words after its last good gap to the next one, so that no piece ends at a mere range
end. Windows over a text's ranges see a few numbers of each range; boundary tables stay in a written table and meet
them by text and range, and so do the ends of the ranges before. Pieces are offsets to the end, and each range gives the
parts of pieces that lie in it. A task holds a whole text only where the input has it as one value.

A value of a table is divided by characters (split_texts), a file by bytes (split_files).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirework.llm.common import written

#: A word is a longest run without space, tab or line break.
GAP, GAP_BYTES = re.compile(r"[ \t\r\n]+"), re.compile(rb"[ \t\r\n]+")
HALO = 256
#: Kinds of gap, the better the higher.
PLAIN, LINE, SENTENCE, PARAGRAPH = range(4)
KINDS = ["none", "line", "sentence", "paragraph"]


def boundary_table(text: str | bytes, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of the words that start in text[lo:hi]: starts, stops, kinds of the gaps before them; and where the range's first
    gap is (-1 if it has none). The rest of text is the halo; the last word may go on beyond it."""
    raw = isinstance(text, bytes)
    gap_re, line, ends, closers = (GAP_BYTES, b"\n", b".!?", b"\"')]}") if raw else (GAP, "\n", ".!?…", "\"')]}»”’")
    starts, stops, kinds = [], [], []
    at, last, kind, n = 0, 0, PARAGRAPH, len(text)
    first = gap_re.search(text, lo, hi)
    for a, b in [*((m.start(), m.end()) for m in gap_re.finditer(text)), (n, n)]:
        if a > at:
            if lo <= at < hi:
                starts.append(at)
                stops.append(a)
                kinds.append(kind)
            last = a
        if b >= hi:
            break
        gap, end = text[a:b], text[max(0, last - 4) : last].rstrip(closers)[-1:]
        kind = PARAGRAPH if gap.count(line) >= 2 else SENTENCE if end and end in ends else LINE if line in gap else PLAIN
        at = b
    return np.array(starts, np.int64), np.array(stops, np.int64), np.array(kinds, np.int64), first.start() if first else -1


def last_good_gap(kinds: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """(word before which to cut, kind): the last gap of the best kind before words low..high, or before word high."""
    window = kinds[low : high + 1]
    best = int(window.max()) if len(window) else PLAIN
    return (high if best == PLAIN else low + int(np.flatnonzero(window == best)[-1])), best


def choose_cuts(kinds: np.ndarray, first: int, max_words: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces (from word, to word, kind of the cut at the end) of words first..; those before are only repeated."""
    out, new, n = [], first, len(kinds)
    while new < n:
        begin = max(0, new - overlap)
        if begin + max_words >= n:
            return [*out, (begin, n, PARAGRAPH)]
        cut, kind = last_good_gap(kinds, max(new + 1, begin + max_words // 2), begin + max_words)
        out.append((begin, cut, kind))
        new = cut
    return out


def handed_over(kinds: np.ndarray, max_words: int) -> int:
    """The first of a range's words that it leaves to the next range; len(kinds) if none, as in ranges of few words."""
    n = len(kinds)
    return n if n < max_words or n < 2 else last_good_gap(kinds, n - max_words // 2, n - 1)[0]


def _tables(batches: Iterator[pd.DataFrame], tail: int) -> Iterator[pd.DataFrame]:
    for d in batches:
        rows = []
        for text, lo, hi, origin in zip(d["_text"], d["_lo"], d["_hi"], d["_origin"]):
            s, e, k, gap = boundary_table(text, lo, hi)
            rows.append((len(s), s, e - s, k, s[-tail:] + origin, e[-tail:] + origin, k[-tail:], gap + origin if gap >= 0 else None, len(e) > 0 and e[-1] == len(text)))
        names = ["_n", "_s", "_l", "_k", "_ts", "_te", "_tk", "_gap", "_goes_on"]
        own = d[["_row", "_range", "_ranges", "_size", "_origin"]]
        yield own.assign(**dict(zip(names, zip(*rows)))) if rows else own.assign(**{n: [] for n in names})


def _cut(batches: Iterator[pd.DataFrame], max_words: int, overlap: int) -> Iterator[pd.DataFrame]:
    ints = lambda x: np.array(x, np.int64)
    for d in batches:
        out = []
        for r in d.to_dict("records"):
            s = ints(r["_s"]) + r["_origin"]
            e, k = s + ints(r["_l"]), ints(r["_k"])
            if r["_goes_on"]:
                e[-1] = r["_after"]
            if not r["_last"]:
                own = handed_over(k, max_words)
                s, e, k = s[:own], e[:own], k[:own]
            first = 0
            tails = [[ints(t[c]) for c in ("ts", "te", "tk")] for t in r["_tails"]] if r["_tails"] is not None else []
            for t, of in zip(tails, r["_tails"] if tails else []):
                if of["goes_on"]:
                    t[1][-1] = of["after"]
            if tails:
                if r["_empty"]:
                    tails.append([ints([])] * 3)
                bs, be, bk = (np.concatenate(x) for x in zip(*tails))
                given = len(bs) - len(tails[-1][0]) + handed_over(tails[-1][2], max_words)
                low = max(0, given - overlap)
                first = given - low
                s, e, k = (np.concatenate([x[low:], y]) for x, y in ((bs, s), (be, e), (bk, k)))
            out += [(r["_row"], r["_range"], i, int(s[a]), int(e[b - 1]), b - a, c) for i, (a, b, c) in enumerate(choose_cuts(k, first, max_words, overlap))]
        yield pd.DataFrame(out, columns=["_row", "_range", "_i", "start", "stop", "n_words", "_kind"])


def _pieces(ranges: DataFrame, max_words: int, overlap: int) -> DataFrame:
    """ranges: _row (the text), _range, _ranges, _size, _text, _lo, _hi, _origin. Gives _row, piece_no, start, stop,
    n_words, boundary; written."""
    longs, small = "array<bigint>", "array<tinyint>"
    tables = written(
        ranges.mapInPandas(
            lambda it: _tables(it, max_words + overlap),
            f"_row bigint, _range int, _ranges int, _size bigint, _origin bigint, _n bigint, _s array<int>, _l array<int>, _k {small}, _ts {longs}, _te {longs}, _tk {small}, _gap bigint, _goes_on boolean",
        ), "boundaries",
    )
    full = _with_ends(tables, max_words, overlap)
    cuts = written(full.mapInPandas(lambda it: _cut(it, max_words, overlap), "_row bigint, _range int, _i bigint, start bigint, stop bigint, n_words bigint, _kind bigint"), "cuts")
    before = cuts.groupBy("_row", "_range").agg(F.count("*").alias("c")).withColumn("_skip", F.sum("c").over(W.partitionBy("_row").orderBy("_range")) - F.col("c")).drop("c")
    kinds = F.array(*map(F.lit, KINDS))
    no = (F.col("_skip") + F.col("_i")).alias("piece_no")
    return cuts.join(before, ["_row", "_range"]).select("_row", no, "start", "stop", "n_words", F.element_at(kinds, (F.col("_kind") + 1).cast("int")).alias("boundary"))


def _with_ends(tables: DataFrame, max_words: int, overlap: int) -> DataFrame:
    """The boundary tables of the oversized texts' ranges, with the ends of the ranges before that they need."""
    w = W.partitionBy("_row").orderBy("_range")
    # a word that goes on beyond its range's halo ends at the first gap of a later range, or with the text
    after = F.coalesce(F.last("_gap", ignorenulls=True).over(W.partitionBy("_row").orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)), F.col("_size"))
    slim = tables.select("_row", "_range", "_ranges", "_size", "_n", "_gap", "_goes_on").withColumn("_after", after)
    # a range is handed the ends of those before it, back to the one that completes `overlap` words
    empty = F.lag("_n").over(w) == 0
    ended = F.when(~empty, F.struct((F.col("_range") - 1).alias("range"), F.lag("_goes_on").over(w).alias("goes_on"), F.lag("_after").over(w).alias("after")))
    slim = slim.withColumn("_ended", ended).withColumn("_empty", F.coalesce(empty, F.lit(False))).withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
    near = F.collect_list("_ended").over(W.partitionBy("_row").orderBy("_before").rangeBetween(-max(0, overlap - 1), W.currentRow))
    slim = slim.withColumn("_near", F.filter(near, lambda x: x["range"] < F.col("_range")))
    slim = slim.withColumn("_total", F.sum("_n").over(W.partitionBy("_row"))).where(F.col("_total") > max_words)
    slim = slim.select("_row", "_range", "_after", "_empty", "_near", (F.col("_range") == F.col("_ranges") - 1).alias("_last"))
    ends = slim.select("_row", F.col("_range").alias("_to"), F.explode("_near").alias("x")).select("_row", "_to", F.col("x.range").alias("_range"), "x.goes_on", "x.after")
    ends = ends.join(tables.select("_row", "_range", F.col("_ts").alias("ts"), F.col("_te").alias("te"), F.col("_tk").alias("tk")), ["_row", "_range"])
    ends = ends.groupBy("_row", F.col("_to").alias("_range")).agg(F.array_sort(F.collect_list(F.struct("_range", "goes_on", "after", "ts", "te", "tk"))).alias("_tails"))
    return tables.select("_row", "_range", "_origin", "_s", "_l", "_k", "_goes_on").join(slim.drop("_near"), ["_row", "_range"]).join(ends, ["_row", "_range"], "left")


def _checked(max_words: int, overlap: int) -> None:
    if not 0 <= overlap < max_words // 2:
        raise ValueError("overlap must be less than half of max_words")


def _long(df: DataFrame, key: str, text: str, max_words: int) -> DataFrame:
    """_key, _whole, text_hash of the texts that can be oversized: n words need 2 n - 1 characters."""
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_whole")).where(F.length("_whole") > 2 * max_words).withColumn("text_hash", F.xxhash64("_whole"))


def _ranges_of(batches: Iterator[pd.DataFrame], range_chars: int) -> Iterator[pd.DataFrame]:
    """The ranges of texts with their halos; together as many as have about the characters of one range."""
    for d in batches:
        out, held = [], 0
        for r in d.to_dict("records"):
            text = r.pop("_whole")
            count = -(-len(text) // range_chars)
            for no in range(count):
                at = no * range_chars
                low = max(0, at - HALO)
                out.append(r | {"_range": no, "_ranges": count, "_size": len(text), "_text": text[low : at + range_chars + HALO], "_lo": at - low, "_hi": at - low + range_chars, "_origin": low})
                held += len(out[-1]["_text"])
                if held >= range_chars:
                    yield pd.DataFrame(out)
                    out, held = [], 0
        if out:
            yield pd.DataFrame(out)


def _ranges(giant: DataFrame, range_chars: int) -> DataFrame:
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in giant.schema if f.name != "_whole")
    return giant.mapInPandas(lambda it: _ranges_of(it, range_chars), f"{own}, _range int, _ranges int, _size bigint, _text string, _lo bigint, _hi bigint, _origin bigint")


def _offsets(texts: DataFrame, max_words: int, overlap: int, range_chars: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts: _key, text_hash, _whole. Gives their ranges, written; _key, text_hash, _row of each text, of rows with the same
    key and text one; and the pieces of the oversized ones without their texts (see _pieces)."""
    ranges = written(_ranges(texts.withColumn("_row", F.monotonically_increasing_id()), range_chars), "ranges")
    rows = ranges.where("_range = 0").groupBy("_key", "text_hash").agg(F.min("_row").alias("_row"))
    ranges = ranges.join(rows.select("_row"), "_row", "left_semi")
    return ranges, rows, _pieces(ranges.drop("_key", "text_hash"), max_words, overlap)


def _cut_whole(batches: Iterator[pd.DataFrame], max_words: int, overlap: int) -> Iterator[pd.DataFrame]:
    """The pieces of texts of one range."""
    for d in batches:
        out = []
        for at, text in enumerate(d["_whole"]):
            s, e, k, _ = boundary_table(text, 0, len(text))
            if len(s) > max_words:
                out += [(at, i, int(s[a]), int(e[b - 1]), b - a, KINDS[c], text[s[a] : e[b - 1]]) for i, (a, b, c) in enumerate(choose_cuts(k, 0, max_words, overlap))]
        p = pd.DataFrame(out, columns=["_at", "piece_no", "start", "stop", "n_words", "boundary", "piece"])
        yield d[["_key", "text_hash"]].iloc[p.pop("_at")].reset_index(drop=True).join(p)


def _parts(batches: Iterator[pd.DataFrame], range_chars: int) -> Iterator[pd.DataFrame]:
    """What of the pieces lies in a range."""
    for d in batches:
        for r in d.to_dict("records"):
            base, end = r["_origin"], r["_range"] * range_chars
            rows = [(r["_row"], p["piece_no"], r["_range"], r["_text"][max(p["start"], end) - base : min(p["stop"], end + range_chars) - base]) for p in r["_held"]]
            yield pd.DataFrame(rows, columns=["_row", "piece_no", "_range", "part"])


def split_texts(df: DataFrame, key: str, text: str, max_words: int = 1000, overlap: int = 100, range_chars: int = 1 << 20) -> DataFrame:
    """Pieces of the texts with more than max_words words: key, text_hash, piece_no, start, stop, n_words, boundary, piece.

    Offsets count code points. Every piece has at most max_words words; every piece after the first begins with the
    last `overlap` words of the one before. `boundary` is the kind
    of gap at the piece's end. Null, empty and short texts give no rows. Rows with the same key and text count once;
    rows with the same key and different texts are split each for itself (told apart by text_hash). A null key is a
    key. Columns of df other than key and text are not read. Texts of one range are cut where they are read.
    """
    _checked(max_words, overlap)
    long = _long(df, key, text, max_words)
    own = f"_key {dict(long.dtypes)['_key']}, text_hash bigint"
    piece = "piece_no bigint, start bigint, stop bigint, n_words bigint, boundary string, piece string"
    one = long.where(F.length("_whole") <= range_chars).mapInPandas(lambda it: _cut_whole(it, max_words, overlap), f"{own}, {piece}")
    ranges, rows, p = _offsets(long.where(F.length("_whole") > range_chars), max_words, overlap, range_chars)
    # a range's pieces meet its text once; a piece over several ranges is put together from its parts
    over = F.sequence(F.floor(F.col("start") / range_chars).cast("int"), F.floor((F.col("stop") - 1) / range_chars).cast("int"))
    held = p.select("_row", "piece_no", "start", "stop", F.explode(over).alias("_range"))
    held = held.groupBy("_row", "_range").agg(F.collect_list(F.struct("piece_no", "start", "stop")).alias("_held"))
    parts = ranges.select("_row", "_range", "_text", "_origin").join(held, ["_row", "_range"]).mapInPandas(lambda it: _parts(it, range_chars), "_row bigint, piece_no bigint, _range int, part string")
    whole = parts.groupBy("_row", "piece_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_range", "part"))), lambda x: x["part"]), "").alias("piece"))
    many = p.join(whole, ["_row", "piece_no"]).join(rows, "_row")
    out = one.dropDuplicates(["_key", "text_hash", "piece_no"]).unionByName(many.select(*one.columns))
    return out.withColumnRenamed("_key", key)


def oversized(df: DataFrame, key: str, text: str, max_words: int = 1000, overlap: int = 100, range_chars: int = 1 << 20) -> DataFrame:
    """The keys of the texts that are divided: those that have a second piece, by ranges, boundary tables, prefix sums and
    cuts as split_texts has them, whatever a text's length; only the pieces' texts are left out."""
    _checked(max_words, overlap)
    _, rows, p = _offsets(_long(df, key, text, max_words), max_words, overlap, range_chars)
    return p.where("piece_no = 1").join(rows, "_row").select(F.col("_key").alias(key)).distinct()


def split_files(spark: SparkSession, paths: list[str], max_words: int = 1000, overlap: int = 100, range_bytes: int = 8 << 20) -> DataFrame:
    """Pieces of UTF-8 text files (byte offsets): path, piece_no, start, stop, n_words, boundary, piece.

    paths: files or folders; a path is given as a URI. Each range is read by seeking in the file; the ranges of a file
    spread over the cluster, and so do the pieces' reads. Files are anything pyarrow's file systems open; a missing one
    fails, an empty one gives no rows.
    """
    _checked(max_words, overlap)
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("_size")).where("_size > 0")
    files = files.withColumn("_row", F.xxhash64("path"))
    count = F.ceil(F.col("_size") / range_bytes).cast("int")
    r = files.withColumn("_ranges", count).withColumn("_range", F.explode(F.sequence(F.lit(0), count - 1))).repartition(F.col("path"), F.col("_range"))
    read = r.mapInPandas(lambda it: _read(it, range_bytes), "_row bigint, _range int, _ranges int, _size bigint, _text binary, _lo bigint, _hi bigint, _origin bigint")
    p = _pieces(read, max_words, overlap).join(files.select("_row", "path"), "_row")
    p = p.select("path", "piece_no", "start", "stop", "n_words", "boundary").repartition("path", "piece_no")
    return p.mapInPandas(_take, "path string, piece_no bigint, start bigint, stop bigint, n_words bigint, boundary string, piece string")


def _open(path: str):
    from pyarrow import fs

    f, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
    return f.open_input_file(at), f.get_file_info(at).size


def _read(batches: Iterator[pd.DataFrame], range_bytes: int) -> Iterator[pd.DataFrame]:
    for d in batches:
        for row, path, no, count in zip(d["_row"], d["path"], d["_range"], d["_ranges"]):
            f, size = _open(path)
            with f:
                at = no * range_bytes
                low = max(0, at - HALO)
                data = f.read_at(min(size, at + range_bytes + HALO) - low, low)
            yield pd.DataFrame({"_row": [row], "_range": [no], "_ranges": [count], "_size": [size], "_text": [data], "_lo": [at - low], "_hi": [at - low + range_bytes], "_origin": [low]})


def _take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        pieces = []
        for path, a, b in zip(d.path, d.start, d.stop):
            f, _ = _open(path)
            with f:
                pieces.append(f.read_at(b - a, a).decode("utf-8", "replace"))
        yield d.assign(piece=pieces)
