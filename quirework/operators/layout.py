"""Page layout: reading order, captions, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirework.functions import text as T


def reading_order(blocks: DataFrame, key: str, page_width: str) -> DataFrame:
    """key, text: full-width blocks, then the left, then the right column, each from the top. Other blocks are dropped."""
    wide = (F.col("x1") - F.col("x0")) > 0.65 * F.col(page_width)
    column = F.when(wide, 0).when(F.col("x0") < 0.45 * F.col(page_width), 1).otherwise(2)
    g = blocks.where("block_type = 0").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(column.alias("c"), "y0", "block_no", "text"))).alias("b"))
    return g.select(key, F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"))


CAPTION = r"(?i)^figure\s*(\d+)[A-Z]?\s*([.\-–]|\s|$)"


def figure_number(caption: Column) -> Column:
    """The number of a main figure's caption; null for other texts."""
    return F.when(caption.rlike(CAPTION), F.regexp_extract(caption, CAPTION, 1).cast("int"))


def match_captions(images: DataFrame, blocks: DataFrame, side: float = 20, near: float = 150, far: float = 350, top: float = 300) -> DataFrame:
    """Images with their caption: of the blocks whose text is a caption, the first pass that finds one decides: below or
    above within `near`, then within `far`, then anywhere on the page, then near the top of the next page."""
    c = blocks.where(figure_number(F.col("text")).isNotNull()).select(
        F.col("doc").alias("_doc"), F.col("page").alias("_page"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("y0").alias("_y0"), F.col("y1").alias("_y1"), F.col("text").alias("caption")
    )
    j = images.join(c, (F.col("doc") == F.col("_doc")) & F.col("_page").isin(F.col("page"), F.col("page") + 1), "left")
    beside = (F.col("_x1") >= F.col("x0") - side) & (F.col("_x0") <= F.col("x1") + side)
    gap = F.least(F.abs(F.col("_y0") - F.col("y1")), F.abs(F.col("y0") - F.col("_y1")))
    here = F.col("_page") == F.col("page")
    step = F.when(here & beside & (gap <= near), 1).when(here & beside & (gap <= far), 2).when(here, 3).when(~here & (F.col("_y0") <= top), 4)
    best = F.min(F.when(step.isNotNull(), F.struct(step.alias("step"), gap.alias("gap"), "_y0", "caption")))
    return j.groupBy(*images.columns).agg(best.alias("b")).select(*images.columns, F.col("b.caption").alias("caption"), F.col("b.step").alias("step"))


def main_figures(images: DataFrame, least_px: int = 100) -> DataFrame:
    """Captioned images of least_px by least_px or more, the first of each figure number in a document."""
    n = figure_number(F.col("caption"))
    f = images.where((F.col("width_px") >= least_px) & (F.col("height_px") >= least_px)).withColumn("figure_no", n).where("figure_no is not null")
    return f.withColumn("_r", F.row_number().over(W.partitionBy("doc", "figure_no").orderBy("page", "image_no"))).where("_r = 1").drop("_r")


def is_composite(images: Column, words: Column, largest_share: Column) -> Column:
    """Whether a page is one figure of many images."""
    return ((images >= 4) & (words < 450)) | (largest_share > 0.35) | ((images >= 1) & (words < 350))


def parse_vision(reply: Column) -> Column:
    """A vision model's reply as an array of figure, caption, description; a caption begins with its figure's number."""
    blocks = F.filter(F.split(reply, r"(?=FIGURE:)"), lambda b: b.rlike("FIGURE:"))
    part = lambda b, a: F.trim(F.regexp_extract(b, rf"{a}:[ \t]*([^\n]*)", 1))
    named = lambda f, c: F.when((c == "") | c.rlike(r"(?i)^figure\s+\d+"), c).otherwise(F.concat(F.lit("Figure "), f, F.lit(". "), c))
    return F.transform(blocks, lambda b: F.struct(part(b, "FIGURE").alias("figure"), named(part(b, "FIGURE"), part(b, "CAPTION")).alias("caption"), part(b, "DESCRIPTION").alias("description")))


CAPTION_PROMPT = "Give the full caption of the figure in this image, and nothing else; NONE if there is none."
PAGE_PROMPT = "For each figure on this page give lines FIGURE: number, CAPTION: full caption, DESCRIPTION: what it shows."


def read_captions(images: DataFrame, image: str, vision) -> DataFrame:
    """images with `caption` where they have none, as a vision model reads it; null where it finds none or fails."""
    from quirework.operators.providers import seen

    r = seen(images.withColumn("_i", F.when(F.coalesce("caption", F.lit("")) == "", F.col(image))), "_i", vision, CAPTION_PROMPT, "_c")
    said = F.trim("_c")
    return r.withColumn("caption", F.coalesce(F.nullif("caption", F.lit("")), F.when(~F.upper(said).isin("NONE", ""), said))).drop("_i", "_c")


def read_pages(pages: DataFrame, image: str, vision) -> DataFrame:
    """The figures of composite pages, as a vision model sees them: a row for each, with the pages' other columns. A page
    on which the model fails has none."""
    from quirework.operators.providers import seen

    r = seen(pages, image, vision, PAGE_PROMPT, "_r").select(*(c for c in pages.columns if c != image), F.explode(parse_vision(F.col("_r"))).alias("f"))
    return r.select(*(c for c in pages.columns if c != image), "f.*")


def diagnostics(images: DataFrame, blocks: DataFrame, height: float, most: int = 5) -> DataFrame:
    """doc, page, n_images, words, images, n_blocks, previews of each page with an image: sizes, places and shares of the
    page of its images, the beginnings of its first text blocks."""
    one = F.format_string("%dx%dpx pos=(%.0f,%.0f) %.0f%%", "width_px", "height_px", "x0", "y0", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * 100 / (F.col("width") * height))
    wide = blocks.groupBy("doc", "page").agg(F.max("width").alias("width"))
    i = images.join(wide, ["doc", "page"]).groupBy("doc", "page").agg(F.count("*").alias("n_images"), F.array_sort(F.collect_list(F.struct("image_no", one.alias("s")))).alias("i"))
    b = blocks.where("block_type = 0").groupBy("doc", "page").agg(
        F.sum(T.word_count(F.col("text"))).alias("words"), F.count("*").alias("n_blocks"),
        F.slice(F.array_sort(F.collect_list(F.struct("block_no", F.substring(F.replace(T.trim_ws(F.col("text")), F.lit("\n"), F.lit(" ")), 1, 80).alias("s")))), 1, most).alias("b"),
    )
    text = lambda c: F.array_join(F.transform(c, lambda x: x["s"]), "\n")
    return i.join(b, ["doc", "page"], "left").select("doc", "page", "n_images", F.coalesce("words", F.lit(0)).alias("words"), text("i").alias("images"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce(text("b"), F.lit("")).alias("previews"))
