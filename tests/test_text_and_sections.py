"""Fixtures of the rules: inline inputs and the values they must give."""

import pytest
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import chunks as C
from quirework.operators import sections as P


def one(spark, c, **values):
    types = {k: v[1] if isinstance(v, tuple) else "string" for k, v in values.items()}
    row = tuple(v[0] if isinstance(v, tuple) else v for v in values.values())
    return spark.createDataFrame([row], ", ".join(f"{k} {t}" for k, t in types.items())).select(c).first()[0]


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, T.unspaced(t), t="R E S U L T S") == "RESULTS"
    assert one(spark, T.unspaced(t), t="R E") == "R E"
    assert one(spark, T.word_count(t), t=" \n\t ") == 0
    assert one(spark, T.word_count(t), t=None) is None
    assert one(spark, T.word_count(t), t=" a\nb\tc ") == 3
    assert one(spark, T.clean_text(t), t="a-\nb \x07 \n\n\n\n\nc  ") == "ab\n\n\nc"
    assert one(spark, T.slug(t), t="x" * 49 + " tail") == "x" * 49 + "_"
    assert one(spark, T.doi(t), t="see 10.1234/ab.c).") == "10.1234/ab.c"
    assert one(spark, T.doi(t), t="none") == ""
    assert one(spark, T.title_from_stem(t), t="2024 One Two Three") is None
    assert one(spark, T.title_from_stem(t), t="2024 One Two Three Four") == "One Two Three Four"
    assert one(spark, T.looks_like_title(t), t="IL-12 in four words") is False
    assert one(spark, T.preview(t, 3), t="a\nbcd") == "a b…"
    assert one(spark, T.is_boilerplate(t), t="Each particle was counted") is True
    assert one(spark, T.is_boilerplate(t, strict=True), t="Each particle was counted") is False


@pytest.mark.parametrize(
    ("line", "head", "kind"),
    [
        ("Summary and conclusions", True, "overview"),
        ("Results and discussion", True, "conclusion"),
        ("1. Introduction", False, "other"),
        ("1 Introduction", True, "other"),
        ("Study Population", False, "other"),
        ("Background levels were measured twice", True, "introduction"),
        ("R E S U L T S", True, "results"),
        ("the results", False, "other"),
        ("", False, "other"),
        ("METHODS", True, "methods"),
        ("x" * 81, False, "other"),
    ],
)
def test_headers(spark, line, head, kind):
    assert one(spark, P.is_header(F.col("t")), t=line) is head
    assert one(spark, P.canonical(F.col("t")), t=line) == kind


def test_sections_inherit(spark):
    text = "\n".join(["w " * 31, "Methods", "a b", "Zebras", "c d", "References", "e", "Zebras", "f"])
    s = P.sections(spark.createDataFrame([(1, text), (2, "w " * 30), (3, ""), (4, None)], "id int, t string"), "id", "t").orderBy("id", "section_no").collect()
    assert [(r.id, r.canonical, r.confidence) for r in s] == [
        (1, "overview", "implicit"), (1, "methods", "regex"), (1, "methods", "inherited:methods"), (1, "references", "regex"), (1, "other", "unknown"),
    ]


def test_chunks_of_empty_paper(spark):
    papers = spark.createDataFrame([("p",)], "k string")
    none = spark.createDataFrame([], "k string, canonical string, content string, confidence string")
    out = sorted(C.build(papers, none, "k").collect(), key=lambda r: r.chunk_id[-3:])
    assert [r.chunk_type for r in out] == ["overview", "introduction", "methods", "results", "discussion"]
    assert {r.confidence for r in out} == {"unknown"}
    assert out[4].chunk_id == "p__discussion__004"


@pytest.mark.parametrize(("words", "emitted"), [(19, False), (20, True)])
def test_optional_chunks(spark, words, emitted):
    papers = spark.createDataFrame([("p",)], "k string")
    m = spark.createDataFrame([("p", "conclusion", "w " * words, "regex")], "k string, canonical string, content string, confidence string")
    assert (C.build(papers, m, "k").where("chunk_type = 'conclusion'").count() == 1) is emitted


@pytest.mark.parametrize(("n", "parts"), [(4000, 1), (4001, 2), (7900, 2), (7901, 3)])
def test_split_windows(spark, n, parts):
    words = [f"w{i}" for i in range(n)]
    out = C.split_windows(spark.createDataFrame([(1, " ".join(words))], "id int, t string"), ["id"], "t").orderBy("sub_chunk").collect()
    assert len(out) == parts
    got = out[0].part.split() + [w for r in out[1:] for w in r.part.split()[100:]]
    assert got == words


def test_skip_reasons(spark):
    df = spark.createDataFrame([("methods", "w " * 19, False), ("methods", "w " * 20, False), ("figure", "w " * 50, False), ("methods", "w " * 20, True), (None, None, None)], "t string, c string, k boolean")
    got = [r[0] for r in df.select(C.skip_reason(F.col("t"), F.col("c"), F.col("k"))).collect()]
    assert got == ["empty", None, "type", "dup", "type"]
