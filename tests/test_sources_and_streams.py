import json

import pytest

from quirework import schemas
from quirework.operators import chunks as operators
from quirework.operators import index
from quirework.operators.providers import HashedWords
from quirework.sources import files, sinks
from quirework.streaming import pipelines


def chunk(i, text, **kw):
    return {"paper_id": "p", "chunk_type": "methods", "chunk_id": f"p__methods__{i:03d}", "title": "T", "content": text, "word_count": 1, **kw}


def test_chunk_files(spark, tmp_path):
    (tmp_path / "a__chunks.json").write_text(json.dumps([chunk(0, "x"), chunk(1, "é\ny")]))
    (tmp_path / "other.json").write_text("[]")
    df = files.read_chunks(spark, str(tmp_path))
    assert df.count() == 2 and df.where("authors is null").count() == 2
    assert files.read_chunks(spark, str(tmp_path / "a__chunks.json")).count() == 2
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception):
        files.read_chunks(spark, str(tmp_path / "none"))


def test_loose_json(spark, tmp_path):
    assert files.read_json(spark, str(tmp_path / "missing.json"), "a int").count() == 0
    (tmp_path / "broken.json").write_text("{")
    assert files.read_json(spark, str(tmp_path / "broken.json"), "a int").count() == 0
    (tmp_path / "good.json").write_text('{"a": 1}')
    assert files.read_json(spark, str(tmp_path / "good.json"), "a int").first().a == 1


def test_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one two\fthree")
    (tmp_path / "b.pdf").write_bytes(b"\xff")

    def parse(b):
        return [{"page_number": k + 1, "text": t, "word_count": len(t.split()), "has_figures": False} for k, t in enumerate(b.decode().split("\f"))]

    out = {(r.path.rsplit("/", 1)[1], r.page_number): (r.text, r.error is None) for r in files.read_documents(spark, str(tmp_path), parse).collect()}
    assert out[("a.pdf", 1)] == ("one two", True) and out[("a.pdf", 2)] == ("three", True)
    assert [v[1] for k, v in out.items() if k[0] == "b.pdf"] == [False]


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([("p", "x.pdf", "T", "A", "", "2020", "x", "m", 0.5, 1, 2, "body")], "paper_id string, pdf_path string, title string, authors string, doi string, year string, source string, extraction_method string, quality_score double, page_count int, word_count int, full_text string")
    assert sinks.extracted_text(p).first().value.endswith("\nbody")
    pages = spark.createDataFrame([("p", 1, 2, False, "m")], "paper_id string, page_number int, word_count int, has_figures boolean, extraction_method string")
    figures = spark.createDataFrame([("figure_1", 3, "x.png", "c", 5, 6, "p")], "figure_id string, page_number int, image_path string, caption string, width_px int, height_px int, paper_id string")
    m = json.loads(sinks.manifests(p, pages, figures).first().value)
    assert m["figures"] == [{"figure_id": "figure_1", "page_number": 3, "image_path": "x.png", "caption": "c", "width_px": 5, "height_px": 6}]
    assert json.loads(sinks.manifests(p, pages).first().value)["figures"] == []
    assert m["metadata"]["author"] == "A" and m["pages"][0]["page_number"] == 1
    sinks.write_values(sinks.extracted_text(p), str(tmp_path / "t"))
    c = spark.createDataFrame([("methods", "x")], "chunk_type string, content string")
    sinks.write_chunks(c, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 1


def put(folder, name, chunks):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}__chunks.json").write_text(json.dumps(chunks))


def test_stream_ingest(spark, tmp_path):
    src, at = tmp_path / "src", str(tmp_path / "index")
    words = "w " * 30
    run = lambda cp: pipelines.ingest(spark, str(src), at, str(tmp_path / cp)).awaitTermination()
    rows = lambda: {r.id: r.document for r in index.read_index(spark, at).collect()}
    put(src, "a", [chunk(0, words + "zzz"), chunk(1, "short"), chunk(5, words)])
    run("cp")
    assert set(rows()) == {"p__methods__000", "p__methods__005"}
    # the newest text counts, not the greatest
    put(src, "b", [chunk(0, words + "new"), chunk(2, words)])
    run("cp")
    assert rows()["p__methods__000"].endswith("new") and set(rows()) == {f"p__methods__{k:03d}" for k in (0, 2, 5)}
    # a new checkpoint goes on from what is there
    src = tmp_path / "src2"
    put(src, "c", [chunk(7, words)])
    run("cp2")
    assert set(rows()) == {f"p__methods__{k:03d}" for k in (0, 2, 5, 7)}
    assert index.manifests(spark, at) == [1, 2, 3]
    # what isn't concerned stays where it was written
    parts = index._manifest(spark, at, 3)["parts"].values()
    assert len({p.split("/")[1] for p in parts}) > 1 and sum("v000003" in p for p in parts) == 1
    assert {r.id for r in index.read_index(spark, at, 1).collect()} == {"p__methods__000", "p__methods__005"}


def test_index_upsert(spark, tmp_path):
    at = str(tmp_path / "index")
    made = lambda *cs: spark.createDataFrame([{**c, "row_id": k} for k, c in enumerate(cs)], schemas.CHUNK + ", row_id int")
    long, short = "v " * 9000, "w " * 40

    class Counting(HashedWords):
        def embed(self, texts):
            with open(tmp_path / "asked", "a") as f:
                f.write("x" * len(texts))
            return super().embed(texts)

    asked = lambda: len((tmp_path / "asked").read_text())
    up = lambda tag, *cs: index.upsert_version(spark, at, operators.index_rows(made(*cs)), tag, Counting(8))
    m = up("one", chunk(0, long), chunk(1, short))
    assert (m["n_rows"], m["n_new"], asked()) == (4, 2, 4)
    # a chunk that shrinks leaves no parts; only what changed is embedded
    m = up("two", chunk(0, short), chunk(1, short), chunk(2, short + "z"))
    assert (m["version"], m["n_rows"], m["n_new"], asked()) == (2, 3, 1, 6)
    rows = index.read_index(spark, at).collect()
    assert {r.id for r in rows} == {f"p__methods__{k:03d}" for k in range(3)} and all(len(r.embedding) == 8 for r in rows)
    # a batch that runs again counts once
    m = up("two", chunk(0, short), chunk(1, short), chunk(2, short + "z"))
    assert (m["version"], m["n_new"]) == (2, 1) and index.read_index(spark, at).count() == 3
    assert index.build_index(spark, made(chunk(1, short), chunk(3, short)), at) == 1
    assert index.build_index(spark, made(chunk(1, short)), at) == 0 and index.read_index(spark, at).count() == 4
    assert index.build_index(spark, made(chunk(9, short)), at, force=True) == 1 and index.read_index(spark, at).count() == 1


def test_index_of_files(spark, tmp_path):
    put(tmp_path / "src", "a", [chunk(0, "w " * 30), chunk(1, "w " * 30)])
    at, file = str(tmp_path / "index"), str(tmp_path / "src" / "a__chunks.json")
    assert index.read_index(spark, at) is None
    assert index.init_index(spark, str(tmp_path / "src"), at).count() == 2
    assert index.index_file(spark, file, at) == 0
    put(tmp_path / "src", "a", [chunk(0, "w " * 30), chunk(4, "w " * 30)])
    assert index.index_file(spark, file, at) == 1 and index.init_index(spark, str(tmp_path / "src"), at).count() == 3


def test_command(spark, tmp_path):
    from quirework.__main__ import main

    src, at = str(tmp_path / "src"), str(tmp_path / "index")
    put(tmp_path / "src", "a", [chunk(0, "w " * 30), chunk(1, "w " * 30)])
    assert main(["plan", src, at]) == 1 and main(["build", src, at, "--vectors", "4"]) == 2 and main(["plan", src, at]) == 0
    assert main(["build", src, at]) == 0 and main(["build", src, at, "--force"]) == 2
    assert main(["stream", src, at, str(tmp_path / "cp")]) == 3 and index.read_index(spark, at).count() == 2


def test_arrays_and_figures(spark, tmp_path):
    c = spark.createDataFrame([chunk(k, "é\n") for k in range(5)] + [{**chunk(9, "x"), "paper_id": "q"}], schemas.CHUNK)
    got = {(r.paper_id, r.part): json.loads(r.value) for r in sinks.paper_arrays(c).collect()}
    assert [x["chunk_id"] for x in got["p", 0]] == [f"p__methods__{k:03d}" for k in range(5)] and got["p", 0][0]["doi"] is None and len(got) == 2
    assert sum(len(json.loads(r.value)) for r in sinks.paper_arrays(c, 2).collect()) == 6
    sinks.write_paper_arrays(c, str(tmp_path / "arrays"))
    assert spark.read.text(str(tmp_path / "arrays")).count() == 2
    f = spark.createDataFrame([("p", 1, b"img"), ("p", 2, None)], "paper_id string, figure_no int, image binary")
    at = {r.figure_no: r.image_path for r in sinks.write_figures(f, str(tmp_path / "figures")).collect()}
    assert at[2] is None and open(at[1], "rb").read() == b"img"


def test_stream_activity(spark):
    sf = "/root/testdata/sf0.001"
    m = spark.readStream.schema(spark.read.parquet(f"{sf}/chat_messages.parquet").schema).option("pathGlobFilter", "chat_messages.parquet").parquet(sf)
    q = pipelines.activity(m).writeStream.format("memory").queryName("activity").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from activity").count() > 0


def test_stream_histories(spark, tmp_path):
    src = tmp_path / "m"
    spark.createDataFrame([(k, "s", k, "user", f"m{k}", None, None, None) for k in range(12)], schemas.MESSAGE).coalesce(1).write.parquet(str(src))
    m = spark.readStream.schema(schemas.MESSAGE).parquet(str(src))
    q = pipelines.histories(m).writeStream.format("memory").queryName("histories").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.sql("select * from histories").first()
    assert r.turns == 10 and r.history.startswith("user: m2\n") and r.history.endswith("user: m11")
