"""Problems 3 and 6: round trips, rules and edge cases."""

import bisect
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirework.llm import packing, split
from quirework.llm.common import written

WORDS = re.compile(r"[^ \t\r\n]+")


def text_of(n, seed=1):
    r = random.Random(seed)
    return "".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 9))) + r.choice([". ", " ", " ", " ", "\n", ".\n\n", "   "]) for _ in range(n))


def rejoined(pieces, overlap):
    out, last = [], None
    for p in pieces:
        w = WORDS.findall(p)
        repeated = 0 if last is None else min(overlap, len(last))
        assert not repeated or w[:repeated] == last[-repeated:]
        out += w[repeated:]
        last = w
    return out


@pytest.mark.parametrize("range_chars", [1 << 20, 20000, 7000])
def test_split_round_trip(spark, range_chars):
    text = text_of(30000)
    df = spark.createDataFrame([(1, text)], "id long, t string")
    p = sorted(split.split_texts(df, "id", "t", 1000, 100, range_chars).collect(), key=lambda r: r.piece_no)
    assert [r.piece_no for r in p] == list(range(len(p)))
    assert all(r.n_words == len(WORDS.findall(r.piece)) <= 1000 and text[r.start : r.stop] == r.piece for r in p)
    assert rejoined([r.piece for r in p], 100) == WORDS.findall(text)
    assert all(r.boundary == "paragraph" for r in p)


@pytest.mark.parametrize(("n", "pieces"), [(1000, 0), (1001, 2), (1900, 2), (1901, 3)])
def test_split_limits(spark, n, pieces):
    df = spark.createDataFrame([(1, " ".join(["w"] * n))], "id long, t string")
    assert split.split_texts(df, "id", "t").count() == pieces
    assert split.oversized(df, "id", "t").count() == (pieces > 0)


def test_split_edges(spark):
    long = "w " * 1500
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "x"), (3, long, "y"), (None, long, "x"), (4, "a" * 5000, "x"), (5, " \n" * 5000, "x"), (6, "v " * 1500, "x"), (6, long, "x")]
    df = spark.createDataFrame(rows, "id long, t string, piece string")
    n = Counter(r.id for r in split.split_texts(df, "id", "t").collect())
    assert n == {3: 2, None: 2, 6: 4}
    assert {r.id for r in split.oversized(df, "id", "t").collect()} == {3, None, 6}
    assert split.split_texts(df.limit(0), "id", "t").count() == 0
    with pytest.raises(ValueError):
        split.split_texts(df, "id", "t", 100, 50)


@pytest.mark.parametrize("range_chars", [1 << 20, 2500])
def test_oversized_texts_are_those_with_pieces(spark, monkeypatch, range_chars):
    made, pieces = [], split._pieces
    monkeypatch.setattr(split, "_pieces", lambda *x: made.append(pieces(*x)) or made[-1])
    rows = [(1, text_of(1001)), (2, text_of(1000)), (3, text_of(9000)), (3, text_of(9000)), (4, "x" * 6000), (None, text_of(1500)), (5, text_of(999) + " z" + " " * 9000), (5, " " * 9000)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = [r.id for r in split.oversized(df, "id", "t", range_chars=range_chars).collect()]
    # every text that can be oversized goes the whole way: ranges, boundary tables, prefix sums, numbered pieces
    assert sorted(map(str, got)) == ["1", "3", "None"] and len(made) == 1
    p = made[0].collect()
    assert len({r["_row"] for r in p}) == 3 and all(r.n_words <= 1000 for r in p)
    made.clear()
    by = Counter(r.id for r in split.split_texts(df, "id", "t", range_chars=range_chars).collect())
    assert set(by) == set(got) and sum(by.values()) == len(p)


def test_long_words_over_ranges(spark):
    text = " ".join(["x" * 5000] * 3 + ["w"] * 2000)
    p = sorted(split.split_texts(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t", 1000, 100, 4000).collect(), key=lambda r: r.piece_no)
    assert rejoined([r.piece for r in p], 100) == WORDS.findall(text)


def test_words_over_many_ranges(spark):
    text = " ".join(["x" * 90000, *["w"] * 50, "y" * 70000, *["v"] * 3000, " " * 20000, "z"])
    df = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (None, text, "c"), (2, text[1:], "d")], "id long, t string, _row string")
    p = sorted(split.split_texts(df, "id", "t", 1000, 100, 4000).collect(), key=lambda r: (str(r.id), r.piece_no))
    for key, t in ((1, text), (None, text), (2, text[1:])):
        own = [r for r in p if r.id == key]
        assert [r.piece_no for r in own] == list(range(len(own))) and rejoined([r.piece for r in own], 100) == WORDS.findall(t)
        assert all(t[r.start : r.stop] == r.piece for r in own)
    assert {r.id for r in split.oversized(df, "id", "t", range_chars=4000).collect()} == {1, None, 2}


def test_windows_see_no_boundary_tables(spark):
    longs = "array<bigint>"
    schema = f"_row bigint, _range int, _ranges int, _size bigint, _origin bigint, _n bigint, _s array<int>, _l array<int>, _k array<tinyint>, _ts {longs}, _te {longs}, _tk array<tinyint>, _gap bigint, _goes_on boolean"
    plan = split._with_ends(written(spark.createDataFrame([], schema), "t"), 1000, 100)._jdf.queryExecution().optimizedPlan()

    def below(node):
        yield node
        for k in range(node.children().size()):
            yield from below(node.children().apply(k))

    windows = [n for n in below(plan) if n.nodeName() == "Window"]
    seen = {x.split("#")[0] for n in windows for x in n.output().mkString(" ").split()}
    assert windows and "_n" in seen and not seen & {"_s", "_l", "_k", "_ts", "_te", "_tk"}


def test_split_files(spark, tmp_path):
    text = text_of(20000, 2)
    (tmp_path / "a.txt").write_bytes(text.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    p = sorted(split.split_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "empty.txt")], 1000, 100, 30000).collect(), key=lambda r: r.piece_no)
    assert rejoined([r.piece for r in p], 100) == WORDS.findall(text)


def test_bucket_bounds_are_optimal():
    from itertools import combinations

    h = {1: 5, 2: 1, 5: 3, 6: 2, 9: 4, 11: 1}
    sizes = sorted(h)
    cost = lambda b: sum(c * (min(x for x in b if x >= s) - s) for s, c in h.items())
    best = min(cost([*c, sizes[-1]]) for c in combinations(sizes[:-1], 2))
    got = packing.bucket_bounds(h, 3)
    assert len(got) <= 3 and cost(got) == best
    assert packing.bucket_bounds(h, 10) == sizes
    assert packing.bucket_bounds({}, 3) == []


def padding(h, bounds):
    return sum(c * (bounds[bisect.bisect_left(bounds, s)] - s) for s, c in h.items())


@pytest.mark.parametrize("seed", range(6))
def test_bucket_bounds_against_the_whole_table(seed):
    r = random.Random(seed)
    h = {s: r.randint(1, 50) for s in r.sample(range(1, 400), r.randint(2, 90))}
    sizes, k = sorted(h), r.randint(1, 20)
    best = [padding({s: h[s] for s in sizes[: j + 1]}, [sizes[j]]) for j in range(len(sizes))]
    for _ in range(k - 1):
        best = [min([best[j], *(best[i] + padding({s: h[s] for s in sizes[i + 1 : j + 1]}, [sizes[j]]) for i in range(j))]) for j in range(len(sizes))]
    got = packing.bucket_bounds(h, k)
    assert len(got) <= k and got[-1] == sizes[-1] and padding(h, got) == best[-1]


def test_bucket_bounds_of_many_sizes():
    r = random.Random(1)
    began = time.time()
    got = packing.bucket_bounds({s: r.randint(1, 10**6) for s in range(1, 2049)}, 256)
    assert len(got) == 256 and time.time() - began < 5


def test_plan_places_everything():
    counts = {1: 100, 300: 17, 700: 9, 1100: 5, 2048: 2}
    placed = Counter()
    for pattern, times in packing.plan(counts, 2048):
        assert times > 0 and sum(b * c for b, c in pattern.items()) <= 2048
        for b, c in pattern.items():
            placed[b] += c * times
    assert placed == counts


@pytest.mark.skipif(not __import__("os").path.exists(packing.TOKENIZER), reason="no tokenizer files")
def test_packed(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(r.randint(1, 900))) for _ in range(300)]
    rows = [*enumerate(texts), (900, ""), (901, None), (902, "word " * 5000), (903, "x" * 20000), (1, texts[1]), (None, "null key")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "id long, t string, container int")
    out = packed = packing.packed(df, "id", "t", 2048, buckets=64).collect()
    load = Counter()
    for x in out:
        load[x.container] += x.n_tokens
    assert max(load.values()) <= 2048 and set(load) == set(range(len(load)))
    assert sum(load.values()) / (2048 * len(load)) > 0.93
    by = {}
    for x in packed:
        by.setdefault(x.id, []).append(x)
    assert 901 not in by and len(by[900]) == 1 and len(by[1]) == 2 and len(by[None]) == 1
    enc = packing.tokenizer(packing.TOKENIZER)
    for k, t in ((902, "word " * 5000), (903, "x" * 20000)):
        p = sorted(by[k], key=lambda x: x.piece_no)
        assert "".join(t[x.start : x.stop] for x in p) == t
        assert all(len(enc.encode_ordinary(t[x.start : x.stop])) == x.n_tokens <= 2048 for x in p)
    assert all(len(v) == 1 for k, v in by.items() if k in range(2, 300))
    assert packing.packed(df.limit(0), "id", "t").count() == 0
    alone = packing.bucket_batches(df, "id", "t", 2048, 64)
    by = alone.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.countDistinct("bound").alias("bounds"), F.max(F.col("n_tokens") - F.col("bound")).alias("over")).collect()
    assert alone.count() == len(out) and len(by) >= len(load) and {x.container for x in by} == set(range(len(by)))
    assert all(x.n <= 2048 and x.bounds == 1 and x.over <= 0 for x in by)
    assert packing.bucket_batches(df.limit(0), "id", "t").count() == 0
