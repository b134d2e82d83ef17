"""The registered queries and their SQL. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.functions import vocabularies as V
from quirework.operators import chunks as C
from quirework.operators import index as I
from quirework.operators import layout as L
from quirework.operators import listing as A
from quirework.operators import papers as N
from quirework.operators import questions as Q
from quirework.operators import search as S
from quirework.operators import sections as P
from quirework.plans import fixtures as X
from quirework.storage import scratch, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents' ids and texts; a small table is spread over the cores."""
    return spread(read(spark, d, "documents").select("doc_id", "text"))


def q(pattern: str) -> str:
    """A text as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def q_list(words: list[str]) -> str:
    return ", ".join(q(w) for w in words)


def one_of(patterns: list[str]) -> str:
    return q("(?i)" + "|".join(patterns))


# ---- pieces of SQL the oracles share
TRIM = r"regexp_replace({0}, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"
WORDS = r"len(regexp_extract_all({0}, '[^ \t\n\r\f\v]+'))"
sql_trim, sql_words = TRIM.format, WORDS.format
ALIAS_CASE = "CASE " + " ".join(f"WHEN regexp_matches(norm, {one_of(p)}) THEN '{n}'" for n, p in V.SECTION_ALIASES.items()) + " ELSE 'other' END"
SQL_LINES = f"""lines AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) u(i)),
    t AS (SELECT *, {sql_trim("line")} AS s FROM lines),
    n AS (SELECT *, CASE WHEN regexp_matches(s, {q(V.SPACED_CAPITALS)}) THEN replace(s, ' ', '') ELSE s END AS norm FROM t),
    c AS (SELECT *, {ALIAS_CASE} AS canon, lower(regexp_extract(s, '([^ \t\n\r\f\v]+)$', 1)) AS last_word, regexp_matches(s, {one_of(V.BOILERPLATE)}) AS boiler FROM n),
    h AS (SELECT *, CASE WHEN s = '' OR length(s) > 80 THEN false WHEN boiler THEN false WHEN canon <> 'other' THEN true
        WHEN regexp_matches(s, {q("(?i)^(" + "|".join(V.SENTENCE_STARTS) + r")[ \t\n\r\f\v]")})
            OR (length(s) > 20 AND (last_word IN ({q_list(V.CUT_WORDS)}) OR regexp_matches(s, {q("(?i)(" + "|".join(V.CUT_STEMS) + ")$")})))
            OR regexp_matches(regexp_extract(s, '^[^ ]*( .*)$', 1), '[\\p{{L}}\\p{{N}}_]\\.[ \t\n\r\f\v]+[A-Z]')
            OR regexp_matches(s, {q(V.INLINE_CITATION)}) OR regexp_matches(s, {q("(?i)" + V.DOSAGE)}) OR length(s) - length(replace(s, ',', '')) >= 2
            OR regexp_matches(s, {one_of(V.HEADER_REFUSED)}) OR (ends_with(s, '.') AND {sql_words("s")} > 5) THEN false
        ELSE regexp_matches(norm, {q("|".join(V.HEADER_SHAPES))}) END AS head FROM c)"""
SQL_SECTIONS = (
    SQL_LINES
    + f""",
    g AS (SELECT *, CAST(sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS INT) AS section_no FROM h),
    b AS (SELECT doc_id, section_no, min(line_no) AS start_line, max(CASE WHEN head THEN s END) AS raw, max(CASE WHEN head THEN canon END) AS own0,
        coalesce(string_agg(CASE WHEN NOT head AND NOT boiler AND NOT regexp_matches(s, '(?i)^(figure|fig\\.|table|scheme)\\s*\\d+\\s*[.\\-]?\\s*$') THEN line END, chr(10) ORDER BY line_no), '') AS body0
        FROM g GROUP BY ALL),
    e AS (SELECT *, {sql_trim("regexp_replace(body0, '\\n{3,}', chr(10) || chr(10), 'g')")} AS content FROM b),
    o AS (SELECT *, CASE WHEN section_no = 0 THEN 'overview' ELSE own0 END AS own FROM e WHERE section_no > 0 OR {sql_words("content")} > 30),
    p AS (SELECT *, CASE WHEN own = 'other' THEN last_value(CASE WHEN own <> 'other' THEN own END IGNORE NULLS)
        OVER (PARTITION BY doc_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent FROM o),
    r AS (SELECT *, coalesce(parent NOT IN ('references', 'acknowledgements', 'supplementary'), false) AS takes FROM p),
    sections AS (SELECT doc_id, section_no, CASE WHEN takes THEN parent ELSE own END AS canonical, coalesce(raw, '') AS raw_header,
        CASE WHEN section_no = 0 THEN 'implicit' WHEN takes THEN 'inherited:' || parent WHEN own = 'other' THEN 'unknown' ELSE 'regex' END AS confidence,
        content, CAST(start_line AS INT) AS start_line, takes AS is_subsection FROM r),
    merged AS (SELECT doc_id, canonical, string_agg(content, chr(10) || chr(10) ORDER BY section_no) AS content, arg_min(confidence, section_no) AS confidence
        FROM sections WHERE content <> '' GROUP BY ALL)"""
)
SQL_REPAIR = rf"""rl AS (SELECT doc_id, i AS n, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) u(i)),
    rf AS (SELECT doc_id, min(n) AS first FROM rl WHERE regexp_matches(line, '^\s*Results\s*$') GROUP BY doc_id),
    ra AS (SELECT doc_id, n, line, min(CASE WHEN regexp_matches(line, {q(V.AFTER_RESULTS)}) THEN n END) OVER (PARTITION BY doc_id) AS stop FROM rl JOIN rf USING (doc_id) WHERE n > first),
    rb AS (SELECT doc_id, {sql_trim("string_agg(line, chr(10) ORDER BY n)")} AS results FROM ra WHERE stop IS NULL OR n < stop GROUP BY doc_id),
    repaired AS (SELECT * FROM rb WHERE {sql_words("results")} > 20)"""
TYPE_ROWS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(V.CHUNK_TYPES))
SQL_CHUNKS = (
    SQL_SECTIONS
    + f""",
    {SQL_REPAIR},
    kk AS (SELECT d.doc_id, v.place, v.chunk_type, CASE WHEN v.chunk_type = 'results' AND rr.results IS NOT NULL THEN rr.results ELSE coalesce(m.content, '') END AS content, coalesce(m.confidence, 'unknown') AS confidence
        FROM documents d CROSS JOIN (VALUES {TYPE_ROWS}) v(place, chunk_type) LEFT JOIN merged m ON m.doc_id = d.doc_id AND m.canonical = v.chunk_type LEFT JOIN repaired rr ON rr.doc_id = d.doc_id),
    built AS (SELECT doc_id, chunk_type, concat_ws('__', doc_id, chunk_type, printf('%03d', row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)) AS chunk_id,
        content, CAST({sql_words("content")} AS INT) AS word_count, confidence
        FROM kk WHERE chunk_type NOT IN ('conclusion', 'acknowledgements') OR {sql_words("content")} >= 20)"""
)


# ---- search over vectors
NEAR = "list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"
VEC = f"""SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(d, 4) AS distance FROM (SELECT v.vec_id AS query_id, e.vec_id, {NEAR} AS d,
    row_number() OVER (PARTITION BY v.vec_id ORDER BY {NEAR}, e.vec_id) AS rank FROM embeddings e, embeddings v WHERE %s) WHERE rank <= 5"""


@query(VEC % "v.vec_id % 50 = 0 AND e.label IN (1, 2, 3)")
def vec_topk_filtered(spark, d):
    e = read(spark, d, "embeddings")
    return S.nearest_blocks(e.where(S.where({"$and": [{"label": {"$in": [1, 2, 3]}}]})), "vec_id", "embedding", e.where(F.col("vec_id") % 50 == 0))


@query(VEC % "v.vec_id % 50 = 0")
def vec_topk_batch(spark, d):
    e = read(spark, d, "embeddings")
    return S.nearest_blocks(e, "vec_id", "embedding", e.where(F.col("vec_id") % 50 == 0))


@query(f"""SELECT query_id, band, count(*) AS n FROM (SELECT v.vec_id AS query_id, CASE WHEN round({NEAR}, 4) < 0.3 THEN 'very relevant' WHEN round({NEAR}, 4) < 0.5 THEN 'relevant' ELSE 'loosely related' END AS band
    FROM embeddings e, embeddings v WHERE v.vec_id % 50 = 0) GROUP BY ALL""")
def vec_band(spark, d):
    e = read(spark, d, "embeddings")
    return S.band_counts(e, "embedding", e.where(F.col("vec_id") % 50 == 0), "vec_id")


@query(f"""WITH t AS ({VEC % "v.vec_id % 50 = 0 AND e.label = v.label AND v.label < 5"}), b AS ({VEC % "v.vec_id % 50 = 0"})
    SELECT * FROM t UNION ALL SELECT * FROM b WHERE query_id NOT IN (SELECT query_id FROM t)""")
def vec_fallback(spark, d):
    e = read(spark, d, "embeddings")
    asked = e.where(F.col("vec_id") % 50 == 0)
    own = asked.where("label < 5").select("vec_id", "embedding", F.array("label").alias("kinds"))
    targeted = S.nearest_blocks(e, "vec_id", "embedding", own, kind="label", kinds="kinds")
    return S.with_fallback(targeted, S.nearest_blocks(e, "vec_id", "embedding", asked), "query_id")


# ---- text
@query(rf"""SELECT row_id, md5({sql_trim(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t\r\f]+(\n|$)', '\1', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g')")}) AS cleaned FROM chunks""")
def clean_text(spark, d):
    return read(spark, d, "chunks").select("row_id", F.md5(T.clean_text(F.col("content"))).alias("cleaned"))


@query(f"""SELECT row_id, CAST({sql_words("content")} AS INT) AS counted, word_count AS stated, {sql_words("content")} = word_count AS agrees FROM chunks""")
def word_counts(spark, d):
    n = T.word_count(F.col("content"))
    return read(spark, d, "chunks").select("row_id", n.alias("counted"), F.col("word_count").alias("stated"), (n == F.col("word_count")).alias("agrees"))


@query(r"""SELECT paper_id, s || CASE WHEN year = '' THEN '' ELSE '__' || year END AS slug_id
    FROM (SELECT paper_id, year, substring(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 50) AS s FROM papers)""")
def slug_paper_id(spark, d):
    return read(spark, d, "papers").select("paper_id", T.paper_id(F.col("title"), F.col("year")).alias("slug_id"))


@query(r"""SELECT row_id, regexp_replace(regexp_extract(content, '(10\.\d{4,9}/[^ \t\n\r\f]+)', 1), '[.,;)]+$', '') AS doi,
    coalesce(nullif(regexp_extract(source_file, '((19|20)\d{2})', 1), ''), nullif(regexp_extract(content, '(^|[^\p{L}\p{N}_])((19|20)\d{2})($|[^\p{L}\p{N}_])', 2), ''), '') AS year_found FROM chunks""")
def doi_year_extract(spark, d):
    c = F.col("content")
    return read(spark, d, "chunks").select("row_id", T.doi(c).alias("doi"), T.year(F.col("source_file"), c).alias("year_found"))


SQL_STEM = r"regexp_replace(regexp_replace({0}, '^.*/', ''), '\.[^.]*$', '')"


SQL_YEARLESS = lambda x: sql_trim(rf"regexp_replace({x}, '^\d{{4}}[ \t\n\r\f\v]+', '')")
SQL_TITLE_CASE = lambda x: rf"array_to_string(list_transform(regexp_extract_all({x}, '\p{{L}}+|[^\p{{L}}]+'), lambda p: upper(p[1]) || lower(p[2:])), '')"
SQL_TITLE_LIKE = lambda x: rf"({sql_words(x)} >= 4 AND NOT regexp_matches({x}, {one_of(V.BAD_TITLES)}))"
SQL_FIRST_LINES = lambda table, key, text, n: rf"SELECT {key}, i AS line_no, {sql_trim('l[i]')} AS s FROM (SELECT {key}, string_split({text}, chr(10)) AS l FROM {table}), unnest(range(1, least(len(l), {n}) + 1)) u(i)"
SQL_PAGE_TITLE = lambda table, key, text: rf"""SELECT {key}, arg_min(s, length(s) * -100000 + line_no) AS title FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY line_no) AS r FROM ({SQL_FIRST_LINES(table, key, text, 30)})
    WHERE length(s) >= 15 AND NOT regexp_matches(s, {one_of(V.BOILERPLATE)}) AND NOT regexp_matches(s, '(?i)^https?://|^doi:') AND length(s) - length(replace(s, ',', '')) <= 4
        AND NOT (s = upper(s) AND s <> lower(s) AND {sql_words("s")} > 3) AND NOT regexp_matches(s, {one_of(V.NOT_IN_TITLE)})) WHERE r <= 15 GROUP BY {key}"""  # noqa: E731


@query(rf"""WITH p AS (SELECT paper_id, length(paper_id) % 5 AS v, title, {SQL_STEM.format("pdf_path")} AS stem FROM papers),
    c AS (SELECT paper_id, arg_min(content, row_id) FILTER (WHERE chunk_type = 'overview') AS o, arg_min(content, row_id) FILTER (WHERE chunk_type = 'introduction') AS i FROM chunks WHERE content <> '' GROUP BY paper_id),
    t AS ({SQL_PAGE_TITLE("(SELECT paper_id, o AS text FROM c WHERE o IS NOT NULL)", "paper_id", "text")}),
    x AS (SELECT p.paper_id, v, CASE WHEN v = 0 THEN stem ELSE '2024 A Short-Name' END AS stem, CASE WHEN v = 1 THEN '2021 ' || p.title WHEN v = 0 THEN p.title ELSE '' END AS title,
        CASE WHEN v = 2 THEN coalesce(t.title, '') ELSE '' END AS page_title, CASE WHEN v IN (2, 3) THEN coalesce(o, '') ELSE '' END AS o, CASE WHEN v IN (2, 3) THEN coalesce(i, '') ELSE '' END AS i FROM p LEFT JOIN c USING (paper_id) LEFT JOIN t USING (paper_id)),
    y AS (SELECT *, {SQL_YEARLESS("stem")} AS a, {SQL_YEARLESS("title")} AS b, {sql_trim("page_title")} AS c, {sql_trim("string_split(o, '.')[1]")} AS d, {sql_trim("string_split(i, '.')[1]")} AS e FROM x)
    SELECT paper_id, CASE WHEN {sql_words("a")} >= 4 THEN a WHEN {SQL_TITLE_LIKE("b")} THEN b WHEN {SQL_TITLE_LIKE("c")} AND {sql_words("c")} <= 25 THEN c
        WHEN {SQL_TITLE_LIKE("d")} AND {sql_words("d")} <= 30 THEN d WHEN {SQL_TITLE_LIKE("e")} AND {sql_words("e")} <= 30 THEN e ELSE {SQL_TITLE_CASE("replace(paper_id, '_', ' ')")} END AS resolved, {SQL_TITLE_LIKE("title")} AS plausible,
        CASE WHEN title <> '' THEN title WHEN {sql_words("a")} >= 4 THEN a ELSE {SQL_TITLE_CASE("replace(replace(stem, '_', ' '), '-', ' ')")} END AS from_data FROM y""")
def resolve_title(spark, d):
    """Papers decorated by the length of their id, so that each step of the order decides for some."""
    p, v = read(spark, d, "papers"), F.length("paper_id") % 5
    first = lambda kind: F.min_by(F.when(F.col("chunk_type") == kind, F.col("content")), F.when(F.col("chunk_type") == kind, F.col("row_id")))
    c = read(spark, d, "chunks").where("content <> '' and chunk_type in ('overview', 'introduction')").groupBy("paper_id").agg(first("overview").alias("o"), first("introduction").alias("i"))
    t = N.page_title(c.where("o is not null"), "paper_id", "o").withColumnRenamed("title", "t")
    x = p.join(c, "paper_id", "left").join(t, "paper_id", "left").select(
        "paper_id", F.when(v == 0, T.file_stem(F.col("pdf_path"))).otherwise("2024 A Short-Name").alias("stem"), F.when(v == 1, F.concat(F.lit("2021 "), "title")).when(v == 0, F.col("title")).otherwise("").alias("title"),
        F.when(v == 2, F.col("t")).alias("page_title"), F.when(v.isin(2, 3), F.col("o")).alias("overview"), F.when(v.isin(2, 3), F.col("i")).alias("introduction"),
    )
    return N.resolve_titles(x).select("paper_id", "resolved", T.looks_like_title(F.col("title")).alias("plausible"), N.title_from_data(F.col("title"), F.col("stem")).alias("from_data"))


@query(SQL_PAGE_TITLE("documents", "doc_id", "text"))
def title_heuristic(spark, d):
    return N.page_title(read(spark, d, "documents"), "doc_id", "text")


@query(rf"""WITH k AS (SELECT *, regexp_replace({sql_trim(r"regexp_replace(regexp_replace(s, '\d+,?\d*', '', 'g'), '\s+', ' ', 'g')")}, '^,+|,+$', '', 'g') AS c FROM ({SQL_FIRST_LINES("documents", "doc_id", "text", 50)})
        WHERE contains(s, ' and ') AND length(s) - length(replace(s, ',', '')) >= 2 AND NOT regexp_matches(lower(s), {q("|".join(V.INSTITUTIONS))})),
    f AS (SELECT doc_id, arg_min(c, line_no) AS c FROM k WHERE length(c) > 10 GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 'Author of ' || coalesce(source, 'x') ELSE coalesce(c, '') END AS authors FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id""")
def resolve_authors(spark, d):
    """A third of the documents have authors in their data, by FIXTURES 3."""
    x = read(spark, d, "documents").withColumn("m", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" Author of "), F.coalesce("source", F.lit("x")), F.lit(" "))))
    return N.resolve_authors(x, "doc_id", "text", "m")


@query(r"""SELECT paper_id, arg_min(doi, (page, row_id)) AS doi FROM (SELECT paper_id, row_id, CASE chunk_type WHEN 'overview' THEN 1 WHEN 'introduction' THEN 2 ELSE 3 END AS page,
    regexp_replace(regexp_extract(content, '(10\.\d{4,9}/[^ \t\n\r\f]+)', 1), '[.,;)]+$', '') AS doi FROM (SELECT * REPLACE (CASE WHEN row_id % 3 = 0 THEN content || ' 10.1234/x.' || row_id || '.' ELSE content END AS content) FROM chunks)) WHERE page <= 2 AND doi <> '' GROUP BY paper_id""")
def paper_doi(spark, d):
    """Chunks stand in for pages; a third has a DOI appended, by FIXTURES 3."""
    page = F.when(F.col("chunk_type") == "overview", 1).when(F.col("chunk_type") == "introduction", 2).otherwise(3)
    text = F.when(F.col("row_id") % 3 == 0, F.concat("content", F.lit(" 10.1234/x."), F.col("row_id").cast("string"), F.lit("."))).otherwise(F.col("content"))
    c = read(spark, d, "chunks").select("paper_id", F.struct(page.alias("p"), "row_id").alias("at"), page.alias("page"), text.alias("text"))
    first = c.where("page <= 2").withColumn("_d", T.doi(F.col("text"))).where("_d <> ''").groupBy("paper_id").agg(F.min_by("text", "at").alias("text"))
    return N.paper_doi(first.withColumn("page", F.lit(1)), "paper_id", "page", "text")


@query(rf"""SELECT row_id, CASE WHEN length(t) > 60 THEN substring(t, 1, 60) || '…' ELSE t END AS preview FROM (SELECT row_id, {sql_trim("replace(content, chr(10), ' ')")} AS t FROM chunks)""")
def preview(spark, d):
    return read(spark, d, "chunks").select("row_id", T.preview(F.col("content"), 60).alias("preview"))


@query("""SELECT paper_id, round(0.6 * least(CAST(sum(coalesce(word_count, 0)) AS DOUBLE) / count(*) / 300.0, 1.0) + 0.4 * CAST(sum(CASE WHEN coalesce(word_count, 0) >= 20 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 3) AS quality_score
    FROM paper_pages GROUP BY paper_id""")
def quality_by_paper(spark, d):
    return A.quality(read(spark, d, "paper_pages"), "paper_id", "word_count")


@query("""WITH f AS (SELECT paper_id, page_number, coalesce(word_count, 0) + CASE WHEN page_number % 2 = 0 THEN 17 ELSE 0 END AS f FROM paper_pages),
    r AS (SELECT paper_id, page_number, CAST(CASE WHEN coalesce(word_count, 0) < 50 AND f > coalesce(word_count, 0) THEN f ELSE coalesce(word_count, 0) END AS INT) AS word_count,
        coalesce(word_count, 0) < 50 AND f > coalesce(word_count, 0) AS replaced FROM paper_pages JOIN f USING (paper_id, page_number))
    SELECT paper_id, CASE WHEN bool_or(replaced) THEN 'mixed' ELSE 'pymupdf' END AS method, CAST(sum(word_count) AS BIGINT) AS word_count, count(*) FILTER (WHERE replaced) AS n_replaced FROM r GROUP BY paper_id""")
def weak_page_repair(spark, d):
    p = read(spark, d, "paper_pages")
    second = p.select("paper_id", "page_number", (F.coalesce("word_count", F.lit(0)) + F.when(F.col("page_number") % 2 == 0, 17).otherwise(0)).alias("word_count"))
    r = A.repair_weak_pages(p, second, "paper_id")
    return r.groupBy("paper_id").agg(
        F.when(F.max("replaced"), "mixed").otherwise("pymupdf").alias("method"), F.sum("word_count").alias("word_count"), F.sum(F.col("replaced").cast("long")).alias("n_replaced")
    )


@query(rf"""WITH c AS (SELECT paper_id, row_id, content FROM chunks WHERE {sql_trim("content")} <> ''),
    n AS (SELECT paper_id, count(*) AS n, min(row_id) AS low, max(row_id) AS high FROM c GROUP BY paper_id)
    SELECT paper_id, CAST(part AS INT) AS part, md5(string_agg(content, chr(10) || chr(10) ORDER BY row_id)) AS full_text, CAST(sum({sql_words("content")}) AS BIGINT) AS word_count
    FROM (SELECT c.*, floor((row_id - low) * ceil(n / 1000.0) / (high - low + 1)) AS part FROM c JOIN n USING (paper_id)) GROUP BY ALL""")
def full_text_assembly(spark, d):
    c = read(spark, d, "chunks").where(T.trim_ws(F.col("content")) != "")
    return A.assembled(c, "paper_id", "row_id", "content", 1000).withColumn("full_text", F.md5("full_text"))


# ---- sections
@query(f"WITH {SQL_LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, s AS header, canon AS canonical FROM h WHERE head")
def header_candidates(spark, d):
    return P.headers(texts(spark, d), "doc_id", "text")


@query(f"WITH {SQL_SECTIONS} SELECT doc_id, section_no, canonical, raw_header, confidence, md5(content) AS content, start_line, is_subsection FROM sections")
def sections_all(spark, d):
    return P.sections(texts(spark, d), "doc_id", "text").withColumn("content", F.md5("content"))


@query(f"WITH {SQL_SECTIONS} SELECT doc_id, canonical, md5(content) AS content, confidence FROM merged")
def sections_merged(spark, d):
    return P.merged(P.sections(texts(spark, d), "doc_id", "text"), "doc_id").withColumn("content", F.md5("content"))


@query(f"WITH {SQL_SECTIONS} SELECT doc_id, raw_header FROM sections WHERE canonical = 'other' AND content <> '' AND NOT is_subsection")
def sections_unmatched(spark, d):
    return P.unmatched(P.sections(texts(spark, d), "doc_id", "text"), "doc_id")


@query(f"WITH {SQL_REPAIR} SELECT doc_id, md5(results) AS results FROM repaired")
def results_repair(spark, d):
    return P.results_repair(texts(spark, d), "doc_id", "text").withColumn("results", F.md5("results"))


# ---- chunks
def _built(spark, d):
    docs = texts(spark, d)
    return C.build(docs, P.merged(P.sections(docs, "doc_id", "text"), "doc_id"), "doc_id", P.results_repair(docs, "doc_id", "text"))


@query(f"WITH {SQL_CHUNKS} SELECT doc_id, chunk_type, chunk_id, md5(content) AS content, word_count, confidence FROM built")
def chunks_built(spark, d):
    return _built(spark, d).withColumn("content", F.md5("content"))


@query(rf"""WITH n AS (SELECT paper_id, count(*) AS n FROM chunks WHERE chunk_type <> 'figure' GROUP BY paper_id),
    f AS (SELECT paper_id, CASE WHEN coalesce(caption, '') <> '' THEN caption ELSE '[Figure ' || coalesce(figure_id, '') || ' — no caption detected]' END AS content,
        row_number() OVER (PARTITION BY paper_id ORDER BY figure_id NULLS FIRST, caption NULLS FIRST) - 1 + coalesce(n, 0) AS no FROM chunks LEFT JOIN n USING (paper_id) WHERE chunk_type = 'figure')
    SELECT paper_id, 'figure' AS chunk_type, concat_ws('__', paper_id, 'figure', printf('%03d', no)) AS chunk_id,
        md5(content) AS content, CAST({sql_words("content")} AS INT) AS word_count FROM f""")
def figure_chunks(spark, d):
    c = read(spark, d, "chunks")
    text = c.where("chunk_type <> 'figure'").select("paper_id", "chunk_type", "chunk_id", "content", "word_count", "confidence")
    out = C.with_figures(text, c.where("chunk_type = 'figure'").select("paper_id", "figure_id", "caption"), "paper_id")
    return out.where("chunk_type = 'figure'").select("paper_id", "chunk_type", "chunk_id", F.md5("content").alias("content"), "word_count")


REASON = f"CASE WHEN chunk_type NOT IN ({q_list(V.CHUNK_TYPES)}) THEN 'type' WHEN {sql_words('content')} < 20 THEN 'empty' %s END"


@query(f"SELECT coalesce({REASON % "WHEN row_id <> first THEN 'dup'"}, 'indexed') AS reason, count(*) AS n FROM chunks JOIN (SELECT chunk_id, min(row_id) AS first FROM chunks GROUP BY chunk_id) USING (chunk_id) GROUP BY ALL")
def skip_reasons(spark, d):
    c = read(spark, d, "chunks")
    first = c.groupBy("chunk_id").agg(F.min("row_id").alias("first"))
    r = C.skip_reason(F.col("chunk_type"), F.col("content"), F.col("row_id") != F.col("first"))
    return c.join(first, "chunk_id").groupBy(F.coalesce(r, F.lit("indexed")).alias("reason")).agg(F.count("*").alias("n"))


def _sql_windows(size: int, overlap: int) -> str:
    step = size - overlap
    return rf"""WITH w AS (SELECT row_id, content, regexp_extract_all(content, '[^ \t\n\r\f\v]+') AS w FROM chunks),
    p AS (SELECT *, CASE WHEN len(w) > {size} THEN 1 + CAST(ceil((len(w) - {size}) / {step}.0) AS INT) ELSE 1 END AS n FROM w)
    SELECT row_id, CAST(i AS INT) AS sub_chunk, CAST(n AS INT) AS n_parts, md5(CASE WHEN n = 1 THEN content ELSE array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') END) AS part,
        CAST(len(w[i * {step} + 1 : i * {step} + {size}]) AS INT) AS part_words FROM p, unnest(range(0, n)) u(i)"""


@query(_sql_windows(4000, 100))
def split_windows(spark, d):
    return C.split_windows(read(spark, d, "chunks"), ["row_id"], "content").withColumn("part", F.md5("part"))


@query(_sql_windows(200, 20))
def split_windows_small(spark, d):
    return C.split_windows(read(spark, d, "chunks"), ["row_id"], "content", 200, 20).withColumn("part", F.md5("part"))


@query(rf"""WITH {_sql_windows(4000, 100)[5:].split("SELECT row_id, CAST(i")[0]} SELECT CASE WHEN n > 1 THEN chunk_id || '__p' || i ELSE chunk_id END AS id, md5(CASE WHEN n = 1 THEN c.content ELSE array_to_string(w[i * 3900 + 1 : i * 3900 + 4000], ' ') END) AS document,
    c.paper_id, c.chunk_type, c.title, coalesce(c.authors, '') AS authors, coalesce(c.year, '') AS year, coalesce(c.doi, '') AS doi, c.source_file, CAST(len(w[i * 3900 + 1 : i * 3900 + 4000]) AS VARCHAR) AS word_count, CAST(i AS VARCHAR) AS sub_chunk
    FROM p JOIN chunks c USING (row_id), unnest(range(0, n)) u(i) WHERE c.chunk_type IN ({q_list(V.CHUNK_TYPES)}) AND len(w) >= 20""")
def index_rows(spark, d):
    return C.index_rows(read(spark, d, "chunks")).withColumn("document", F.md5("document"))


@query(rf"""SELECT row_id, chunk_type, CAST({sql_words("content")} AS INT) AS word_count, CASE WHEN {sql_words("content")} < 20 THEN 'EMPTY' ELSE '' END AS flag,
    CASE WHEN length(t) > 60 THEN substring(t, 1, 60) || '…' ELSE t END AS preview FROM (SELECT *, {sql_trim("replace(content, chr(10), ' ')")} AS t FROM chunks)""")
def chunk_report(spark, d):
    return C.report(read(spark, d, "chunks"), ["row_id"])


# ---- index
@query("""WITH l AS (SELECT chunk_id, arg_max(content, row_id) AS content, max(row_id) AS row_id FROM chunks GROUP BY chunk_id), o AS (SELECT DISTINCT chunk_id FROM chunks WHERE ingested_at < TIMESTAMP '2024-03-01')
    SELECT l.chunk_id, row_id, md5(content) AS content, o.chunk_id IS NOT NULL AS was_known FROM l LEFT JOIN o ON o.chunk_id = l.chunk_id""")
def incremental_upsert(spark, d):
    c = read(spark, d, "chunks").select("chunk_id", "row_id", "content", "ingested_at")
    early = F.col("ingested_at") < F.lit("2024-03-01").cast("timestamp_ntz")
    old, new = (I.latest(x.drop("ingested_at").withColumn("was_known", F.lit(False)), "chunk_id", "row_id") for x in (c.where(early), c.where(~early)))
    known = old.select("chunk_id", F.lit(True).alias("k"))
    out = I.upsert(old, new, "chunk_id").drop("was_known").join(known, "chunk_id", "left")
    return out.select("chunk_id", "row_id", F.md5("content").alias("content"), F.coalesce("k", F.lit(False)).alias("was_known"))


@query(f"""WITH l AS (SELECT chunk_id, arg_max(content, row_id) AS content, arg_max(chunk_type, row_id) AS chunk_type, min(ingested_at) AS first FROM chunks GROUP BY chunk_id)
    SELECT chunk_id AS id, CAST({sql_words("content")} AS INT) AS words FROM l WHERE first >= TIMESTAMP '2024-03-01' AND chunk_type IN ({q_list(V.CHUNK_TYPES)}) AND {sql_words("content")} >= 20""")
def index_increment(spark, d):
    """What a later run indexes: chunks fit for the index whose id isn't there from before."""
    c = read(spark, d, "chunks")
    fit = lambda x: x.where(C.skip_reason(F.col("chunk_type"), F.col("content"), F.lit(False)).isNull())
    cols = ["chunk_id", "content", "chunk_type", "row_id"]
    existing = c.where(F.col("ingested_at") < F.lit("2024-03-01").cast("timestamp_ntz")).select(F.col("chunk_id").alias("id"))
    new = fit(I.latest(c.select(*cols), "chunk_id", "row_id")).withColumnRenamed("chunk_id", "id")
    return I.unindexed(new, existing, "id").select("id", T.word_count(F.col("content")).alias("words"))


@query(f"""SELECT paper_id, 0 AS part, md5('[' || string_agg('{{"chunk_id":' || to_json(chunk_id) || ',"paper_id":' || to_json(paper_id) || ',"chunk_type":' || to_json(chunk_type) || ',"title":' || to_json(title) || ',"authors":' || to_json(authors) || ',"year":' || to_json(year) || ',"doi":' || to_json(doi)
    || ',"source_file":' || to_json(source_file) || ',"content":"","word_count":' || word_count || ',"figure_id":null,"image_path":null,"caption":null,"confidence":' || to_json(confidence) || '}}', ',' ORDER BY chunk_id, word_count) || ']') AS value
    FROM (SELECT DISTINCT * FROM (SELECT chunk_id, arg_max(paper_id, row_id) AS paper_id, arg_max(chunk_type, row_id) AS chunk_type, arg_max(title, row_id) AS title, arg_max(authors, row_id) AS authors, arg_max(year, row_id) AS year, arg_max(doi, row_id) AS doi,
        arg_max(source_file, row_id) AS source_file, arg_max(word_count, row_id) AS word_count, arg_max(confidence, row_id) AS confidence FROM chunks GROUP BY chunk_id)) GROUP BY paper_id""")
def paper_arrays(spark, d):
    """The arrays with empty contents, since engines write line breaks and other marks in JSON differently."""
    from quirework.sources.sinks import paper_arrays

    none = F.lit(None).cast("string")
    c = I.latest(read(spark, d, "chunks").withColumns({"content": F.lit(""), "figure_id": none, "image_path": none, "caption": none}), "chunk_id", "row_id")
    return paper_arrays(c, 1_000_000).withColumn("value", F.md5("value"))


@query("""SELECT source, CASE WHEN source IN (SELECT DISTINCT source_file FROM chunks WHERE confidence = 'regex') THEN 'skip' ELSE 'process' END AS action, count(*) AS n FROM papers GROUP BY ALL""")
def ingest_dry_run(spark, d):
    done = read(spark, d, "chunks").where("confidence = 'regex'").select(F.col("source_file").alias("source"))
    return I.plan_ingest(read(spark, d, "papers").select("source"), done, "source").groupBy("source", "action").agg(F.count("*").alias("n"))


@query("""SELECT paper_id, CASE WHEN quality_score IS NOT NULL AND source <> '' THEN 'skip' ELSE 'process' END AS action, CASE WHEN quality_score IS NOT NULL THEN page_count ELSE 0 END AS page_count, CASE WHEN quality_score IS NOT NULL THEN coalesce(n, 0) ELSE 0 END AS pages
    FROM (SELECT *, count(*) OVER (PARTITION BY source) AS same FROM papers) p LEFT JOIN (SELECT paper_id, count(*) AS n FROM paper_pages GROUP BY paper_id) USING (paper_id) WHERE same = 1""")
def manifest_lookup(spark, d):
    """Papers found again by the manifests of those that were extracted: manifests as JSON, read back, joined by source.
    Papers that share a source's name are left out, in SQL too."""
    from quirework import schemas
    from quirework.sources.sinks import manifests

    p = read(spark, d, "papers")
    p = p.join(p.groupBy("source").agg(F.count("*").alias("same")).where("same = 1").select("source"), "source")
    m = manifests(p.where("quality_score is not null"), read(spark, d, "paper_pages")).select(F.from_json("value", schemas.MANIFEST).alias("m"))
    m = m.select(F.col("m.metadata.source").alias("source"), F.col("m.page_count").alias("page_count"), F.size("m.pages").cast("long").alias("pages"))
    out = I.plan_ingest(p.select("paper_id", "source"), m, "source").join(m, "source", "left")
    return out.select("paper_id", "action", F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("pages", F.lit(0)).cast("long").alias("pages"))


# ---- listings
@query("""SELECT 'total' AS kind, 'chunks' AS name, count(*) AS n FROM chunks UNION ALL SELECT 'total', 'papers', count(DISTINCT paper_id) FROM chunks
    UNION ALL SELECT 'type', chunk_type, count(*) FROM chunks GROUP BY chunk_type UNION ALL SELECT 'paper', paper_id, count(*) FROM chunks GROUP BY paper_id""")
def collection_stats(spark, d):
    return A.stats(read(spark, d, "chunks"))


SQL_CATALOGUE = """SELECT *, row_number() OVER (ORDER BY year DESC, first_row) AS place FROM (SELECT paper_id, arg_min(title, row_id) AS title, arg_min(authors, row_id) AS authors, arg_min(year, row_id) AS year,
    arg_min(doi, row_id) AS doi, min(row_id) AS first_row FROM chunks WHERE paper_id <> '' GROUP BY paper_id)"""


@query(SQL_CATALOGUE)
def catalogue(spark, d):
    return A.publications(read(spark, d, "chunks"), "row_id")


@query("""SELECT row_id, paper_id, chunk_type, chunk_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY chunk_type, row_id) AS INT) AS place FROM chunks WHERE contains(lower(paper_id), 'spring')""")
def chunk_listing(spark, d):
    return A.listing(read(spark, d, "chunks").select("row_id", "paper_id", "chunk_type", "chunk_id"), paper="SPRING", order="row_id")


@query("SELECT chunk_type, count(*) AS n, repeat('█', CAST(count(*) AS INT)) AS bar FROM chunks GROUP BY chunk_type")
def type_bars(spark, d):
    return A.bars(read(spark, d, "chunks").groupBy("chunk_type").agg(F.count("*").alias("n")), "n", 1)


@query(f"""SELECT '- **"' || title || '"** (' || year || ') — DOI: ' || doi AS line, paper_id, place, count(*) OVER () AS total FROM ({SQL_CATALOGUE})""")
def catalogue_lines(spark, d):
    p = A.publications(read(spark, d, "chunks"), "row_id")
    return p.select(A.catalogue_line(F.col("title"), F.col("year"), F.col("doi")).alias("line"), "paper_id", "place", A.count_of(p).alias("total"))


@query("""SELECT paper_id, chunk_type, row_id, md5('[' || chunk_type || '] ' || chunk_id || chr(10) || content) AS line FROM chunks""")
def export_dump(spark, d):
    """The dump's entries in its order; a global sort, so that a paper with very many chunks is no single task's."""
    line = F.concat(F.lit("["), "chunk_type", F.lit("] "), "chunk_id", F.lit("\n"), "content")
    return read(spark, d, "chunks").select("paper_id", "chunk_type", "row_id", F.md5(line).alias("line")).orderBy("paper_id", "chunk_type", "row_id")


@query("""SELECT paper_id, count(*) AS pages, count(*) FILTER (WHERE has_figures) AS with_figures, CAST(sum(coalesce(word_count, 0)) AS BIGINT) AS words, count(*) FILTER (WHERE coalesce(word_count, 0) < 20) AS nearly_empty FROM paper_pages GROUP BY paper_id""")
def page_diagnostics(spark, d):
    w = F.coalesce("word_count", F.lit(0))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return read(spark, d, "paper_pages").groupBy("paper_id").agg(F.count("*").alias("pages"), n(F.col("has_figures")).alias("with_figures"), F.sum(w).alias("words"), n(w < 20).alias("nearly_empty"))


# ---- context of answers
SQL_EXCERPT = """'[' || rank || '] "' || title || '" (' || year || ') — ' || upper(chunk_type) || ' | DOI: ' || doi || chr(10) || '    ' || substring(content, 1, 1200) || chr(10)"""


@query(f"""WITH hits AS ({VEC % "v.vec_id % 50 = 0"}), h AS (SELECT query_id, rank, c.* FROM hits JOIN chunks c ON c.row_id = hits.vec_id + 1 WHERE chunk_type IN ('methods', 'results')),
    c AS (SELECT query_id, 'Relevant publication excerpts:' || chr(10) || chr(10) || string_agg({SQL_EXCERPT}, chr(10) ORDER BY rank) AS context FROM h GROUP BY query_id)
    SELECT query_id, md5(coalesce(context, 'No relevant publications found for this query.')) AS context FROM (SELECT DISTINCT query_id FROM hits) LEFT JOIN c USING (query_id)""")
def rag_context(spark, d):
    """Hits of two types only, so that some queries have none."""
    c = read(spark, d, "chunks").where("chunk_type in ('methods', 'results')").withColumn("vec_id", F.col("row_id") - 1)
    hits = vec_topk_batch(spark, d)
    return S.context_or_none(hits, hits.join(c, "vec_id"), ["query_id"]).withColumn("context", F.md5("context"))


# ---- questions
def _bounded(words: list[str]) -> str:
    return f"coalesce(regexp_matches(message, {q(V.bounded(words))}), false)"


@query(f"""SELECT message_id, CASE WHEN m AND NOT r THEN 'methods' WHEN r AND NOT m THEN 'results,discussion' WHEN o AND NOT m AND NOT r THEN 'overview,introduction' END AS route, listing FROM
    (SELECT message_id, {_bounded(V.METHODS_WORDS)} AS m, {_bounded(V.RESULTS_WORDS)} AS r, {_bounded(V.OVERVIEW_WORDS)} AS o, {_bounded(V.LISTING_WORDS)} AS listing FROM chat_messages)""")
def intent_route(spark, d):
    m = F.col("message")
    return read(spark, d, "chat_messages").select("message_id", Q.route(m).alias("route"), Q.intent(m, V.LISTING_WORDS).alias("listing"))


@query(f"SELECT message_id, coalesce({sql_words('message')} <= 4, false) AND {_bounded(V.SCIENCE_WORDS)} AS short_science FROM chat_messages")
def science_short(spark, d):
    return read(spark, d, "chat_messages").select("message_id", Q.is_short_science(F.col("message")).alias("short_science"))


SQL_BARE = "regexp_replace(" + sql_trim("lower(message)") + ", '[!.,?]+$', '')"


@query(f"SELECT message_id, coalesce({SQL_BARE} IN ({q_list(V.GREETINGS)}), false) AS greeting, coalesce({SQL_BARE} IN ({q_list(V.FOLLOW_UPS)}), false) AS follow_up FROM chat_messages")
def greeting(spark, d):
    m = F.col("message")
    return read(spark, d, "chat_messages").select("message_id", Q.is_greeting(m).alias("greeting"), Q.is_follow_up(m).alias("follow_up"))


SQL_ONCE = "t AS (SELECT session_id, turn_no, unnest(arg_max({'message_id': message_id, 'role': role, 'message': message, 'category': category}, (received_at, message_id))) FROM chat_messages GROUP BY session_id, turn_no)"
SQL_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(lower(message), {q('|'.join(w))}) THEN '{n}'" for n, w in V.CATEGORY_WORDS.items()) + " END"


@query(f"""WITH {SQL_ONCE}, s AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN {SQL_TOPIC} END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn_no, message_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS latest FROM t)
    SELECT message_id, category, CASE WHEN coalesce({SQL_BARE} IN ({q_list(V.FOLLOW_UPS)}), false) THEN coalesce(latest, category) ELSE category END AS effective_category FROM s""")
def followup_category(spark, d):
    return Q.with_effective_category(Q.once(read(spark, d, "chat_messages"))).select("message_id", "category", "effective_category")


@query(rf"""WITH r AS (SELECT message_id, '```json' || chr(10) || '{{"category": "' || upper(coalesce(category, 'none')) || '"}}' || CASE WHEN message_id % 7 = 0 THEN '}}}}' ELSE '' END || chr(10) || '```' AS reply, message_id % 7 = 0 AS broken, category FROM chat_messages)
    SELECT message_id, CASE WHEN NOT broken AND lower(coalesce(category, 'none')) IN ({q_list(V.CATEGORIES)}) THEN lower(category) ELSE 'else' END AS parsed FROM r""")
def category_parse(spark, d):
    c = F.upper(F.coalesce("category", F.lit("none")))
    bad = F.col("message_id") % 7 == 0
    reply = F.concat(F.lit('```json\n{"category": '), F.when(bad, F.lit("")).otherwise(F.lit('"')), c, F.lit('"}\n```'))
    return read(spark, d, "chat_messages").select("message_id", Q.parse_category(reply).alias("parsed"))


@query(f"""SELECT message_id, CASE WHEN coalesce({SQL_BARE} IN ({q_list(V.GREETINGS)}), false) THEN 'greeting' WHEN category IN ('general', 'projects', 'publications', 'calendar', 'hobbies') THEN category
    WHEN category = 'else' THEN 'refusal' ELSE 'rephrase' END AS answerer FROM chat_messages""")
def dispatch(spark, d):
    return read(spark, d, "chat_messages").select("message_id", Q.dispatch(F.col("message"), F.col("category")).alias("answerer"))


@query(f"""SELECT message_id, CASE WHEN coalesce(length(message) % 97 = 0, false) THEN 'moderation' WHEN coalesce(regexp_matches(message, {q("|".join(V.PERSONAL))}), false) THEN 'pii'
    WHEN coalesce(regexp_matches(lower(message), {q("|".join(V.JAILBREAK_WORDS))}), false) THEN 'jailbreak' ELSE '' END AS reason FROM chat_messages""")
def guard_chain(spark, d):
    m = F.col("message")
    return read(spark, d, "chat_messages").select("message_id", Q.guard(m, F.length(m) % 97 == 0).alias("reason"))


@query(f"SELECT doc_id, coalesce(regexp_matches(text, {q('|'.join(V.PERSONAL))}), false) AS personal, coalesce(regexp_matches(lower(text), {q('|'.join(V.JAILBREAK_WORDS))}), false) AS jailbreak FROM documents")
def guard_documents(spark, d):
    return read(spark, d, "documents").select("doc_id", Q.personal(F.col("text")).alias("personal"), Q.jailbreak(F.col("text")).alias("jailbreak"))


@query(f"""SELECT message_id, CASE WHEN coalesce(contains(lower(message), 'dose') , false) THEN 'moderation' WHEN coalesce(regexp_matches(message, {q("|".join(V.PERSONAL))}), false) THEN 'pii'
    WHEN coalesce(regexp_matches(lower(message), {q("|".join(V.JAILBREAK_WORDS))}), false) THEN 'jailbreak' ELSE '' END AS reason FROM chat_messages""")
def guard_providers(spark, d):
    """The guards by providers: stand-ins for moderation and for the model."""
    from quirework.operators.providers import PatternChat, WordModerator

    m = read(spark, d, "chat_messages").select("message_id", "message")
    return Q.guarded(m, "message", WordModerator(["dose"]), PatternChat(V.PERSONAL)).select("message_id", "reason")


# ---- sessions
@query(f"WITH {SQL_ONCE} SELECT session_id, turn_no, message_id FROM t QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC, message_id DESC) <= 10")
def session_last_n(spark, d):
    return Q.last_messages(Q.once(read(spark, d, "chat_messages"))).select("session_id", "turn_no", "message_id")


@query(f"""WITH {SQL_ONCE}, h AS (SELECT message_id, list(coalesce(role, '') || ': ' || coalesce(message, '')) OVER (PARTITION BY session_id ORDER BY turn_no, message_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS l FROM t)
    SELECT message_id, CAST(coalesce(len(l), 0) AS INT) AS n, md5(coalesce(array_to_string(l, chr(10)), '')) AS history FROM h""")
def session_history(spark, d):
    h = Q.with_history(Q.once(read(spark, d, "chat_messages")))
    said = F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    return h.select("message_id", F.size("history").alias("n"), F.md5(said).alias("history"))


@query(f"""WITH {SQL_ONCE}, h AS (SELECT message_id, role, message, list(coalesce(role, '') || ': ' || coalesce(message, '')) OVER (PARTITION BY session_id ORDER BY turn_no, message_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS l FROM t)
    SELECT message_id, md5('system: You answer questions about papers.' || chr(10) || coalesce(array_to_string(l, chr(10)) || chr(10), '') || 'user: ' || coalesce(message, '')) AS prompt FROM h WHERE role = 'user'""")
def prompt_messages(spark, d):
    h = Q.with_history(Q.once(read(spark, d, "chat_messages"))).where("role = 'user'")
    p = Q.prompt(F.lit("You answer questions about papers."), F.col("history"), F.col("message"))
    return h.select("message_id", F.md5(F.array_join(F.transform(p, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")).alias("prompt"))


SQL_HISTORY = f"""{SQL_ONCE}, hh AS (SELECT *, list(coalesce(role, '') || ': ' || coalesce(message, '')) OVER (PARTITION BY session_id ORDER BY turn_no, message_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS l FROM t),
    h AS (SELECT *, coalesce(array_to_string(l, chr(10)) || chr(10), '') AS before FROM hh)"""
SAID = lambda p: F.array_join(F.transform(p, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
SQL_TOLD = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {q(t)}" for k, (t, _) in Q.AGENTS.items()) + " END"
SQL_TEMPERATURE = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {n}::DOUBLE" for k, (_, n) in Q.AGENTS.items()) + " END"


@query(f"""WITH {SQL_HISTORY} SELECT message_id, {SQL_TEMPERATURE("category")} AS temperature, md5('system: ' || {SQL_TOLD("category")} || CASE WHEN category = 'calendar' THEN '' ELSE chr(10) || chr(10) || '{{"about":"' || category || '"}}' END || chr(10) || before || 'user: ' || coalesce(message, '')) AS prompt
    FROM h WHERE role = 'user' AND category IN ('general', 'projects', 'calendar', 'hobbies')""")
def agent_prompts(spark, d):
    data = spark.createDataFrame([(c, '{"about":"%s"}' % c) for c in ("general", "projects", "hobbies")], "category string, data string")
    h = Q.with_history(Q.once(read(spark, d, "chat_messages"))).where("role = 'user'")
    return Q.agent_prompts(h, data).select("message_id", "temperature", F.md5(SAID(F.col("prompt"))).alias("prompt"))


@query(f"""WITH {SQL_HISTORY}, qs AS (SELECT message_id, message, before, e.embedding, {_bounded(V.METHODS_WORDS)} AS m, {_bounded(V.RESULTS_WORDS)} AS r, {_bounded(V.OVERVIEW_WORDS)} AS o, {_bounded(V.LISTING_WORDS)} AS listed
        FROM h LEFT JOIN embeddings e ON e.vec_id = h.message_id WHERE role = 'user' AND message_id % 50 = 0),
    qr AS (SELECT *, CASE WHEN m AND NOT r THEN ['methods'] WHEN r AND NOT m THEN ['results', 'discussion'] WHEN o AND NOT m AND NOT r THEN ['overview', 'introduction'] END AS types FROM qs),
    near AS (SELECT v.message_id, c.row_id, v.types IS NULL OR list_contains(v.types, c.chunk_type) AS fits, {NEAR} AS dist FROM qr v, embeddings e JOIN chunks c ON c.row_id = e.vec_id + 1 WHERE NOT listed AND v.embedding IS NOT NULL),
    best AS (SELECT *, bool_or(fits) OVER (PARTITION BY message_id) AS any_fits FROM near),
    hit AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY dist, row_id) AS rank FROM best WHERE fits OR NOT any_fits QUALIFY rank <= 5),
    ctx AS (SELECT message_id, count(*) AS n_hits, 'Relevant excerpts from the publications:' || chr(10) || chr(10) || string_agg({SQL_EXCERPT}, chr(10) ORDER BY rank) AS context FROM hit JOIN chunks USING (row_id) GROUP BY message_id),
    a AS (SELECT q.*, n_hits, context, CASE WHEN listed THEN 'catalogue' WHEN context IS NOT NULL THEN 'excerpts' ELSE 'summary' END AS agent, (SELECT count(DISTINCT paper_id) FROM chunks WHERE paper_id <> '') AS n FROM qr q LEFT JOIN ctx USING (message_id))
    SELECT message_id AS id, agent, {SQL_TEMPERATURE("agent")} AS temperature, coalesce(n_hits, 0) AS n_hits, md5('system: ' || {SQL_TOLD("agent")} || chr(10) || chr(10)
        || CASE agent WHEN 'catalogue' THEN 'Here are all ' || n || ' publications, listed by year:' WHEN 'summary' THEN 'Publications list (' || n || ' total)' ELSE context END || chr(10) || before || 'user: ' || coalesce(message, '')) AS prompt FROM a""")
def publications_prompt(spark, d):
    """From message to prompt. Questions are the user's messages whose id is divisible by 50; the vector of that number
    stands in for a question's, so that SQL can follow, and some questions have none."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    h = Q.with_history(Q.once(read(spark, d, "chat_messages"))).where("role = 'user' and message_id % 50 = 0")
    asked = h.join(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "message_id"), "message_id", "left").select(F.col("message_id").alias("id"), "message", "embedding", "history")
    c = read(spark, d, "chunks")
    rows = e.withColumn("row_id", F.col("vec_id") + 1).drop("vec_id").join(c.select("row_id", "chunk_type", "title", "year", "doi", "content"), "row_id")
    out = Q.publications_prompts(asked, rows, A.publications(c, "row_id"))
    return out.withColumn("prompt", F.md5(SAID(F.col("prompt"))))


# ---- layout
@query(f"""SELECT doc, string_agg(text, chr(10) ORDER BY CASE WHEN x1 - x0 > 0.65 * width THEN 0 WHEN x0 < 0.45 * width THEN 1 ELSE 2 END, y0, block_no) AS text FROM ({X.BLOCKS_SQL}) WHERE block_type = 0 GROUP BY doc""")
def column_order(spark, d):
    return L.reading_order(X.blocks(spark), "doc", "width")


@query(r"""SELECT row_id, CASE WHEN regexp_matches(caption, '(?i)^figure\s*(\d+)[A-Z]?\s*([.\-–]|\s|$)') THEN CAST(regexp_extract(caption, '(?i)^figure\s*(\d+)', 1) AS INT) ELSE 0 END AS figure_no FROM chunks WHERE caption IS NOT NULL""")
def caption_match(spark, d):
    return read(spark, d, "chunks").where("caption is not null").select("row_id", F.coalesce(L.figure_number(F.col("caption")), F.lit(0)).alias("figure_no"))


@query(X.FIGURES_SQL)
def figure_dedupe(spark, d):
    m = L.match_captions(X.images(spark), X.blocks(spark)).where("caption is not null")
    return L.main_figures(m).select("doc", "figure_no", "image_no", "caption", "step")


@query(f"SELECT doc, page, (images >= 4 AND words < 450) OR share > 0.35 OR (images >= 1 AND words < 350) AS composite FROM ({X.PAGES_SQL})")
def composite_pages(spark, d):
    return X.pages(spark).select("doc", "page", L.is_composite(F.col("images"), F.col("words"), F.col("share")).alias("composite"))


@query(rf"""WITH w AS (SELECT doc, page, max(width) AS width FROM ({X.BLOCKS_SQL}) GROUP BY ALL),
    i AS (SELECT doc, page, count(*) AS n_images, string_agg(printf('%dx%dpx pos=(%.0f,%.0f) %.0f%%', width_px, height_px, x0, y0, (x1 - x0) * (y1 - y0) * 100 / (width * 800)), chr(10) ORDER BY image_no) AS images FROM ({X.IMAGES_SQL}) JOIN w USING (doc, page) GROUP BY ALL),
    b AS (SELECT doc, page, CAST(sum({sql_words("text")}) AS BIGINT) AS words, count(*) AS n_blocks FROM ({X.BLOCKS_SQL}) WHERE block_type = 0 GROUP BY ALL),
    f AS (SELECT doc, page, string_agg(substring({sql_trim("text")}, 1, 80), chr(10) ORDER BY block_no) AS previews FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY block_no) AS r FROM ({X.BLOCKS_SQL}) WHERE block_type = 0) WHERE r <= 5 GROUP BY ALL)
    SELECT doc, page, n_images, coalesce(words, 0) AS words, images, coalesce(n_blocks, 0) AS n_blocks, coalesce(previews, '') AS previews FROM i LEFT JOIN b USING (doc, page) LEFT JOIN f USING (doc, page)""")
def page_images(spark, d):
    return L.diagnostics(X.images(spark), X.blocks(spark), 800.0)


@query()
def embed_hash(spark, d):
    from quirework.operators.providers import HashedWords, embedded

    return embedded(read(spark, d, "chunks").select("row_id", "content"), "content", HashedWords(64))


@query()
def stub_answers(spark, d):
    from quirework.operators.providers import EchoChat, answered

    h = Q.with_history(Q.once(read(spark, d, "chat_messages"))).where("role = 'user'")
    return answered(h.select("message_id", F.to_json(Q.prompt(F.lit("You answer."), F.col("history"), F.col("message"))).alias("prompt")), "prompt", EchoChat())


@query(f"""SELECT message_id, CASE WHEN {sql_words("message")} <= 3 THEN message || ' (' || length(message) || ' characters read)' ELSE message END AS query FROM chat_messages WHERE message IS NOT NULL""")
def query_expansion(spark, d):
    from quirework.operators.providers import EchoChat, expanded

    m = read(spark, d, "chat_messages").where("message is not null").select("message_id", F.col("message").alias("query"))
    return expanded(m, "query", EchoChat())


@query(f"""SELECT message_id, coalesce(length(message) > 100 AND NOT regexp_matches(lower(message), {q("|".join(V.JAILBREAK_WORDS))}), false) AS asked FROM chat_messages""")
def deep_check_candidates(spark, d):
    return read(spark, d, "chat_messages").select("message_id", Q.needs_deep_check(F.col("message")).alias("asked"))


@query("""SELECT '{"title":"' || title || '","year":"' || year || '","source":"' || source || '"}' AS entry, count(*) OVER () AS n FROM papers""")
def publication_summary(spark, d):
    return S.summary(read(spark, d, "papers"))


@query(rf"""SELECT paper_id, stem, {sql_words("stem")} >= 4 AS long_stem, {sql_words("title")} AS title_words, regexp_matches(title, {one_of(V.BAD_TITLES)}) AS refused
    FROM (SELECT paper_id, title, {SQL_STEM.format("pdf_path")} AS stem FROM papers)""")
def title_debug(spark, d):
    stem, title = T.file_stem(F.col("pdf_path")), F.col("title")
    return read(spark, d, "papers").select(
        "paper_id", stem.alias("stem"), (T.word_count(stem) >= 4).alias("long_stem"), T.word_count(title).cast("long").alias("title_words"), title.rlike("(?i)" + V.any_of(V.BAD_TITLES)).alias("refused")
    )


@query("SELECT date_trunc('day', sent_at)::TIMESTAMP AS day, role, count(*) AS n FROM chat_messages GROUP BY ALL")
def stream_activity(spark, d):
    """Daily counts by a stream over the table; the memory sink holds a row for each day and role."""
    import uuid

    from quirework.streaming.pipelines import activity

    name = "activity_" + uuid.uuid4().hex
    schema = read(spark, d, "chat_messages").schema
    m = spark.readStream.schema(schema).parquet(f"{d}/chat_messages.parquet*")
    activity(m).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("day"), "role", "n")


@query()
def vec_ann_batch(spark, d):
    from quirework.operators import cells

    e = read(spark, d, "embeddings")
    index = cells.build(e, "vec_id", "embedding", scratch(spark, "cells"))
    return cells.search(index, e.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding")


@query()
def headers_by_provider(spark, d):
    from quirework.operators.providers import EchoChat

    s = P.sections(texts(spark, d), "doc_id", "text")
    return P.classify_unmatched(s, "doc_id", EchoChat()).select("doc_id", "section_no", "canonical", "confidence")
