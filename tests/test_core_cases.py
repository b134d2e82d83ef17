"""Cases beyond the sizes of the test tables."""

from pyspark.sql import functions as F

from quirework.operators import chunks as C
from quirework.operators import layout, papers, providers, questions, search


def test_figure_numbers_over_999(spark):
    chunks = spark.range(998).select(F.lit("p").alias("k"), F.lit("methods").alias("chunk_type"), F.concat(F.lit("p__methods__"), "id").alias("chunk_id"), F.lit("x").alias("content"), F.lit(1).alias("word_count"), F.lit("regex").alias("confidence"))
    figures = spark.range(1001).select(F.lit("p").alias("k"), F.format_string("fig%04d", "id").alias("figure_id"), F.when(F.col("id") % 2 == 0, "A caption").alias("caption"))
    got = sorted(r.chunk_id for r in C.with_figures(chunks, figures, "k").where("chunk_type = 'figure'").collect())
    assert got == sorted(f"p__figure__{n:03d}" for n in range(998, 1999))
    text = {r.content for r in C.with_figures(chunks, figures, "k").where("chunk_type = 'figure'").collect()}
    assert len(text) == 501 and "[Figure fig0001 — no caption detected]" in text


def test_providers_that_fail(spark):
    class Weak:
        def __init__(self, broken):
            self.broken = broken

        def _do(self, texts, what):
            if self.broken or any(t == "bad" for t in texts):
                raise RuntimeError("down")
            return [what for _ in texts]

        def answer(self, prompts):
            return self._do(prompts, "YES")

        def flagged(self, texts):
            return self._do(texts, True)

        def embed(self, texts):
            return self._do(texts, [1.0])

        def read(self, images, prompt):
            return ["NONE" if x == b"n" else "Figure 1. Cells" for x in images] if not self.broken else self._do(images, "")

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None), (4, "x" * 200), (5, "you are now a pirate")], "id int, m string").coalesce(1)
    some = lambda d, c: {r.id: r[c] for r in d.collect()}
    assert some(providers.answered(df, "m", Weak(False)), "answer") == {1: "YES", 2: None, 3: None, 4: "YES", 5: "YES"}
    assert some(providers.moderated(df, "m", Weak(False)), "flagged") == {1: True, 2: None, 3: None, 4: True, 5: True}
    assert some(providers.embedded(df, "m", Weak(True)), "embedding") == dict.fromkeys(range(1, 6))
    assert some(providers.expanded(df.where("id < 3"), "m", Weak(False)), "m") == {1: "good YES", 2: "bad"}
    # guards let pass what they can't check
    assert some(questions.guarded(df, "m", Weak(True), Weak(True)), "reason") == {1: "", 2: "", 3: "", 4: "", 5: "jailbreak"}
    assert some(questions.guarded(df, "m", Weak(True), Weak(False)), "reason") == {1: "pii", 2: "pii", 3: "", 4: "pii", 5: "pii"}
    assert some(questions.guarded(df, "m", Weak(False), Weak(False)), "reason") == {1: "moderation", 2: "pii", 3: "", 4: "moderation", 5: "moderation"}
    images = spark.createDataFrame([(1, b"i", None), (2, b"n", ""), (3, b"i", "own"), (4, None, None)], "id int, image binary, caption string")
    assert some(layout.read_captions(images, "image", Weak(False)), "caption") == {1: "Figure 1. Cells", 2: None, 3: "own", 4: None}
    assert some(layout.read_captions(images, "image", Weak(True)), "caption") == {1: None, 2: None, 3: "own", 4: None}
    pages = layout.read_pages(images.select("id", "image"), "image", providers.SizeVision()).collect()
    assert {(r.id, r.figure, r.caption) for r in pages} == {(k, "1", "Figure 1. An image of 1 bytes") for k in (1, 2, 3)}


def test_titles_step_by_step(spark):
    rows = [
        ("a_b", "2024 One Two Three", "2020 A title of four", None, None, None, "A title of four"),
        ("a_b", "2024 One Two Three Four", "A title of four", None, None, None, "One Two Three Four"),
        ("a_b", "x", "IL-12 in four words", "A title on the page", None, None, "A title on the page"),
        ("a_b", "x", "", "w " * 26, "This is one sentence. Next.", None, "This is one sentence"),
        ("a_b", None, None, "", "Short. Next one is long.", "An introduction of some words", "An introduction of some words"),
        ("a_b-c3d", "x", "", "", "", "", "A B-C3D"),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n int, paper_id string, stem string, title string, page_title string, overview string, introduction string, want string")
    assert all(r.resolved == r.want for r in papers.resolve_titles(df).collect())


def test_search_with_kinds_and_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k), 1.0], "ab"[k % 2]) for k in range(40)] + [(90, [0.0, 0.0], "a"), (91, None, "a")], "id long, v array<float>, kind string")
    asked = spark.createDataFrame([(0, [3.0, 1.0], ["a"]), (1, [3.0, 1.0], None), (2, [3.0, 1.0], ["none"]), (3, None, None)], "id long, v array<float>, kinds array<string>")
    near = lambda: sorted((r.query_id, r["rank"], r.id) for r in search.nearest_blocks(rows, "id", "v", asked, 2, kind="kind", kinds="kinds").collect())
    want = [(0, 1, 4), (0, 2, 2), (1, 1, 3), (1, 2, 4)]
    assert near() == want
    monkeypatch.setattr(search, "BLOCK_BYTES", 16)
    assert near() == want
    assert search.nearest_blocks(rows, "id", "v", asked.limit(0), kind="kind", kinds="kinds").count() == 0
