"""Small literal tables for operators whose inputs the test tables lack, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BLOCK_COLUMNS = "doc, page, block_no, block_type, x0, y0, x1, y1, width, text"
BLOCKS = [
    (1, 1, 0, 0, 50.0, 40.0, 550.0, 60.0, 600.0, "A title over both columns"),
    (1, 1, 1, 0, 50.0, 300.0, 280.0, 320.0, 600.0, "left below"),
    (1, 1, 2, 0, 320.0, 90.0, 550.0, 110.0, 600.0, "right above"),
    (1, 1, 3, 0, 50.0, 90.0, 280.0, 110.0, 600.0, "left above"),
    (1, 1, 4, 1, 50.0, 120.0, 280.0, 250.0, 600.0, "an image"),
    (1, 1, 5, 0, 60.0, 255.0, 270.0, 275.0, 600.0, "Figure 1. Cells before and after"),
    (1, 1, 6, 0, 320.0, 500.0, 550.0, 520.0, 600.0, "Figure 2A - far below"),
    (1, 2, 0, 0, 50.0, 50.0, 280.0, 70.0, 600.0, "Figure 3 on the next page"),
    (1, 2, 1, 0, 320.0, 50.0, 550.0, 70.0, 600.0, "Supplemental Figure 1"),
    (2, 1, 0, 0, 50.0, 90.0, 280.0, 110.0, 600.0, "no figure here"),
]
IMAGE_COLUMNS = "doc, page, image_no, x0, y0, x1, y1, width_px, height_px"
IMAGES = [
    (1, 1, 0, 50.0, 120.0, 280.0, 250.0, 400, 300),
    (1, 1, 1, 320.0, 120.0, 550.0, 200.0, 400, 300),
    (1, 1, 2, 55.0, 125.0, 275.0, 250.0, 500, 300),
    (1, 1, 3, 60.0, 125.0, 275.0, 250.0, 90, 300),
    (2, 1, 0, 50.0, 120.0, 280.0, 250.0, 400, 300),
]
PAGES = [(1, 1, 4, 449, 0.1), (1, 2, 4, 450, 0.1), (1, 3, 1, 349, 0.1), (1, 4, 1, 900, 0.36), (2, 1, 0, 10, 0.0), (2, 2, 1, 350, 0.35)]


def _values(rows: list[tuple], columns: str) -> str:
    one = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else f"CAST({x} AS INT)"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({columns})"


BLOCKS_SQL, IMAGES_SQL, PAGES_SQL = _values(BLOCKS, BLOCK_COLUMNS), _values(IMAGES, IMAGE_COLUMNS), _values(PAGES, "doc, page, images, words, share")
FIGURES_SQL = rf"""WITH c AS (SELECT * FROM ({BLOCKS_SQL}) WHERE regexp_matches(text, '(?i)^figure\s*(\d+)[A-Z]?\s*([.\-–]|\s|$)')),
    j AS (SELECT i.*, c.text AS caption, c.y0 AS cy, least(abs(c.y0 - i.y1), abs(i.y0 - c.y1)) AS gap, c.page = i.page AS here, c.x1 >= i.x0 - 20 AND c.x0 <= i.x1 + 20 AS beside
        FROM ({IMAGES_SQL}) i JOIN c ON c.doc = i.doc AND c.page IN (i.page, i.page + 1)),
    s AS (SELECT *, CASE WHEN here AND beside AND gap <= 150 THEN 1 WHEN here AND beside AND gap <= 350 THEN 2 WHEN here THEN 3 WHEN cy <= 300 THEN 4 END AS step FROM j),
    b AS (SELECT doc, page, image_no, width_px, height_px, arg_min(caption, (step, gap, cy, caption)) AS caption, min(step) AS step FROM s WHERE step IS NOT NULL GROUP BY ALL),
    f AS (SELECT *, CAST(regexp_extract(caption, '(?i)^figure\s*(\d+)', 1) AS INT) AS figure_no FROM b WHERE width_px >= 100 AND height_px >= 100)
    SELECT doc, figure_no, image_no, caption, step FROM f QUALIFY row_number() OVER (PARTITION BY doc, figure_no ORDER BY page, image_no) = 1"""


def blocks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BLOCKS, "doc int, page int, block_no int, block_type int, x0 double, y0 double, x1 double, y1 double, width double, text string")


def images(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(IMAGES, "doc int, page int, image_no int, x0 double, y0 double, x1 double, y1 double, width_px int, height_px int")


def pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGES, "doc int, page int, images int, words int, share double")
