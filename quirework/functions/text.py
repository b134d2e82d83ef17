"""Text functions on columns. A null text stays null unless the docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions import vocabularies as V

WS = r"[ \t\n\r\f\x0B]"


def trim_ws(c: Column) -> Column:
    """c without white space at both ends."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def word_count(c: Column) -> Column:
    """The number of runs without white space; 0 for a blank text."""
    t = trim_ws(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, rf"{WS}+"))).cast("int")


def clean_text(c: Column) -> Column:
    """Control characters dropped, words broken by hyphens joined, line ends bare, at most two blank lines on end."""
    t = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    t = F.regexp_replace(t, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    t = F.regexp_replace(t, r"[ \t\r\f]+(\n|$)", "$1")
    return trim_ws(F.regexp_replace(t, r"\n{4,}", "\n\n\n"))


def slug(c: Column) -> Column:
    """At most 50 characters of a-z, 0-9 and single underscores; may end in one, since it is trimmed before it is cut."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 50)


def paper_id(title: Column, year: Column) -> Column:
    return F.when(F.coalesce(year, F.lit("")) == "", slug(title)).otherwise(F.concat_ws("__", slug(title), year))


def doi(c: Column) -> Column:
    """The first DOI without closing marks; '' if there is none."""
    return F.regexp_replace(F.regexp_extract(c, r"(10\.\d{4,9}/[^ \t\n\r\f]+)", 1), r"[.,;)]+$", "")


def year(created: Column, first_page: Column) -> Column:
    """The first year of the creation date, else of the first page; '' if there is none."""
    on_page = F.regexp_extract(first_page, r"(^|[^\p{L}\p{N}_])((19|20)\d{2})($|[^\p{L}\p{N}_])", 2)
    return F.coalesce(F.nullif(F.regexp_extract(created, r"((19|20)\d{2})", 1), F.lit("")), F.nullif(on_page, F.lit("")), F.lit(""))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def title_from_stem(stem: Column) -> Column:
    """The stem without a leading year if that leaves four words, else null."""
    t = trim_ws(F.regexp_replace(stem, rf"^\d{{4}}{WS}+", ""))
    return F.when(word_count(t) >= 4, t)


def title_case(c: Column) -> Column:
    """Every run of letters with one capital in front, whatever stands before it."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)")), lambda x: F.initcap(x)), "")


def looks_like_title(c: Column) -> Column:
    return (word_count(c) >= 4) & ~c.rlike("(?i)" + V.any_of(V.BAD_TITLES))


def unspaced(c: Column) -> Column:
    """R E S U L T S as RESULTS."""
    return F.when(trim_ws(c).rlike(V.SPACED_CAPITALS), F.replace(c, F.lit(" "), F.lit(""))).otherwise(c)


def preview(c: Column, n: int) -> Column:
    """The first n characters on one line, with an ellipsis if there are more."""
    t = trim_ws(F.replace(c, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def is_boilerplate(line: Column, strict: bool = False) -> Column:
    """strict: research and article only as words; otherwise anywhere in the line, even spaced or inside a word."""
    p = [x for x in V.BOILERPLATE if not strict or not x.startswith((r"r\s*e", r"a\s*r"))]
    return trim_ws(line).rlike("(?i)" + V.any_of(p + ([r"\b(research|article)\b"] if strict else [])))


FIGURE_LABEL = r"(?i)^(figure|fig\.|table|scheme)\s*\d+\s*[.\-]?\s*$"


def is_figure_label(line: Column) -> Column:
    """Whether a line is a bare figure label."""
    return trim_ws(line).rlike(FIGURE_LABEL)


def strip_boilerplate(lines: Column) -> Column:
    """An array of lines without boilerplate, bare numbers or bare figure labels."""
    return F.filter(lines, lambda l: ~is_boilerplate(l) & ~is_figure_label(l))


def body_text(lines: Column) -> Column:
    """An array of lines as one text with at most one blank line on end."""
    return trim_ws(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def section_body(lines: Column) -> Column:
    """An array of lines as a section's text: no boilerplate, bare numbers or bare figure labels."""
    return body_text(strip_boilerplate(lines))
