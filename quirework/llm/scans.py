"""Problem 2: text read from scanned pages, repaired into continuous paragraphs.

Two scans of the values. The first counts, over all of them, words, neighbouring words and masked header lines; forms
are grouped by their skeleton of confusable glyphs, and a rare form of a group is a misreading of a frequent one. The
second scan finds the values that may be damaged (by a bitmap of the misread forms) and takes only these
apart into lines; what a line needs from the counts comes by joins. Windows over the lines put the text together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.llm.common import NUMBER, PAGE, WORD, bits_for, bits_of, by_size, in_bits, written
from quirework.llm.confusable import misreadings, skeleton

TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
CODE = re.compile(r"(?=.*\d)[A-Z0-9]+$")
#: A page number set apart from the rest of a header line.
FOLIO = re.compile(r"^\s*\d{1,5}\s{2,}|\s{2,}\d{1,5}\s*$")
BREAK = re.compile(r"([^\W\d_]+)([-\xad¬])\s*$")
ENTRY = re.compile(r"\s*(?:[-*•–]|\d{1,3}[.)])\s+\S")
LINES = re.compile(r"\r\n|\r|\n")
LINE = "struct<no:int,text:string,kind:string,header:string,a:string,b:string,mark:string,forms:array<struct<form:string,before:string,after:string>>>"


def _hash(word: str) -> int:
    """Spark's xxhash64 of a string."""
    return int(np.uint64(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)).astype(np.int64))


def without_folio(line: str) -> str:
    """A line without a page number set apart at its beginning or end."""
    bare = line.strip()
    return FOLIO.sub("", line) if bare[:1].isdigit() or bare[-1:].isdigit() else line


def without_omission(text: str) -> str:
    """A text without white space and marks of omission at its end, as OMISSION has them."""
    while True:
        t = text.rstrip()
        if t.endswith("…"):
            t = t[:-1]
        elif t.endswith("..."):
            t = t.rstrip(".")
        elif t.endswith("]") and (inner := t[t.rfind("[") + 1 : -1]) and (inner == "…" or len(inner) > 2 and not inner.strip(".")) and "[" in t:
            t = t[: t.rfind("[")]
        else:
            return t
        text = t


def header_key(line: str) -> str | None:
    """A header's masked form: no page number, no running title after a comma, digits as 0; None for other lines.

    A header has at least two long words and all its long words begin with a capital; it ends without punctuation.
    """
    core = without_folio(line).split(",")[0].strip()
    if not core or len(core) > 100 or core[-1] in ".!?;:" or not core[0].isalpha():
        return None
    long = [w for w in WORD.findall(core) if len(w) > 3 and w.isalpha()]
    if len(long) < 2 or not all(w[0].isupper() for w in long):
        return None
    return re.sub(r"\d+", "0", core.casefold())


def header_places(text: str) -> Iterator[tuple[str, str, str, bool]]:
    """A text's lines that may be headers, with the words around them: (masked form, before, after, stands out).

    before and after are the two words on either side, across blank lines and page numbers; after a text's last line,
    the two words before those. A line stands out where the long words next to it begin without a capital, which they
    don't in running text in capitals. A text's first line is no evidence: a header stands between or after lines.
    """
    lines = [x for x in LINES.split(text) if x.strip() and not PAGE.match(x)]
    for k, line in enumerate(lines):
        if k and (key := header_key(line)) is not None:
            above, below = ([w for x in near for w in WORD.findall(x)] for near in (lines[max(0, k - 4) : k], lines[k + 1 : k + 5]))
            beside = (next((w for w in ws if len(w) > 3 and w.isalpha()), "") for ws in (above[::-1], below))
            out = not any(w[:1].isupper() for w in beside)
            above, below = ([w.lower() for w in ws] for ws in (above, below))
            yield key, " ".join(above[-2:]), " ".join(below[:2]) if below else "\r" + " ".join(above[-4:-2]), out


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in (b.iloc[x:y] for b in batches for x, y in by_size(list(b["_value"]))):
        texts = list(d["_value"])
        lists = [TOKEN.findall(t) for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.empty(int(sizes.sum()), object)
        at = 0
        for x in lists:
            flat[at : at + len(x)] = x
            at += len(x)
        if not at:
            continue
        codes, distinct = pd.factorize(flat)
        n = np.bincount(codes)
        # a value's last word may be cut, so it is no evidence of a form
        ends = np.cumsum(sizes)[sizes > 0] - 1
        whole = n.copy()
        for k, t in zip(ends.tolist(), (t for t, s in zip(texts, sizes) if s)):
            if t.rstrip()[-1:] not in ".!?":
                whole[codes[k]] -= 1
        words: dict[str, int] = {}
        for t, c in zip(distinct.tolist(), whole.tolist()):
            if c and not CODE.match(t):
                low = t.lower()
                words[low] = words.get(low, 0) + c
                if "-" in low:
                    for part in low.split("-"):
                        words[part] = words.get(part, 0) + c
        for t in texts:
            if "\n" in t or "\r" in t:
                for key, before, after, out in header_places(t):
                    place = f"\n{key}\n{before}\n{after}\n{out:d}"
                    words[place] = words.get(place, 0) + 1
        lows = [t.lower() for t in distinct.tolist()]
        left = np.fromiter((_hash(t) for t in lows), np.int64, len(lows))
        right = np.fromiter((_hash(t + "\x01") for t in lows), np.int64, len(lows))
        pairs = left[codes[:-1]] ^ right[codes[1:]]
        inner = np.ones(max(0, at - 1), bool)
        inner[ends[:-1]] = False
        h, m = np.unique(pairs[inner], return_counts=True)
        yield pd.concat([pd.DataFrame({"word": list(words), "h": 0, "n": list(words.values())}), pd.DataFrame({"word": None, "h": h, "n": m})])


def _forms(line: str, known: set[str]) -> list[dict]:
    out, tokens = [], TOKEN.findall(line) if known else []
    for k, t in enumerate(tokens):
        low = t.lower()
        if low in known and not CODE.match(t):
            out.append({"form": low, "before": tokens[k - 1].lower() if k else "", "after": tokens[k + 1].lower() if k + 1 < len(tokens) else ""})
    return out


def _page_kinds(lines: list[str]) -> list[str]:
    """page for a line that is only a page number; figures for numbers under a label or in a column of numbers."""
    kinds, label = [], False
    for k, line in enumerate(lines):
        if not line.strip():
            kinds.append("blank")
        elif NUMBER.match(line):
            column = label or (kinds and kinds[-1] == "figures") or (k + 1 < len(lines) and NUMBER.match(lines[k + 1]) is not None)
            kinds.append("figures" if column else "page")
        elif PAGE.match(line):
            kinds.append("page")
        else:
            kinds.append("entry" if ENTRY.match(line) else "text")
        if line.strip():
            label = line.rstrip().endswith(":")
    return kinds


def apart(text: str, title: str, known: set[str]) -> list[dict] | None:
    """The lines of a value that may be damaged; None for a value without any sign of damage."""
    lines = LINES.split(text)
    kinds = _page_kinds(lines)
    ended = without_omission(text)[-1:] in ".!?" and not text.rstrip().endswith("..")
    out, sign, fold = [], len(lines) > 1 and "page" in kinds, title.casefold()
    for k, (line, kind) in enumerate(zip(lines, kinds)):
        row = {"no": k, "text": line, "kind": kind, "header": None, "a": None, "b": None, "mark": None, "forms": []}
        core = without_folio(line).strip()
        low = core.casefold()
        running = len(low) >= 15 and (fold.startswith(low) or "," in low and len(low.split(",", 1)[1]) > 4 and fold.startswith(low.split(",", 1)[1].strip()))
        if kind == "text" and len(lines) > 1:
            if k and running or core and len(core) < len(line.strip()) and re.search(r"[^\W\d_]{3}", core):
                row["kind"] = "header"
                sign = True
            elif (key := header_key(line)) is not None:
                row["header"] = key
                sign = True
        if row["kind"] != "header":
            row["forms"] = _forms(line, known)
        out.append(row)
    # a word broken at a line's end goes on in the next line that is neither a header nor a page number
    for k, row in enumerate(out):
        if row["kind"] == "text" and row["text"].rstrip()[-1:] in ("-", "\xad", "¬") and (m := BREAK.search(row["text"])):
            rest = next((x for x in out[k + 1 :] if x["kind"] == "text" and x["header"] is None), None)
            if rest and (b := re.match(r"\s*([^\W\d_]+)", rest["text"])) and b[1][0].islower():
                row |= {"a": m[1].lower(), "b": b[1].lower(), "mark": m[2]}
                sign = True
                row["forms"] = [f for f in row["forms"] if f["form"] != row["a"]]
                rest["forms"] = [f for f in rest["forms"] if f["form"] != row["b"]]
    if not ended:
        last = WORD.findall(text)[-1:]
        for row in out[-2:]:  # the value's last word may be cut
            row["forms"] = [f for f in row["forms"] if f["after"] or [f["form"]] != [x.lower() for x in last]]
    return out if sign or any(r["forms"] for r in out) else None


def _apart(batches: Iterator[pd.DataFrame], marks) -> Iterator[pd.DataFrame]:
    for d in (b.iloc[x:y] for b in batches for x, y in by_size(list(b["_value"]))):
        texts = list(d["_value"])
        lists = [TOKEN.findall(t) for t in texts]
        distinct = set().union(*lists) if lists else set()
        low = list({t.lower() for t in distinct})
        hit = in_bits(np.fromiter(map(_hash, low), np.int64, len(low)), marks.value)
        known = {t for t, x in zip(low, hit.tolist()) if x}
        cased = {t for t in distinct if t.lower() in known and not CODE.match(t)}
        held = [not cased.isdisjoint(x) for x in lists]
        lines = [apart(t, title or "", known if h else set()) if h or "\n" in t or "\r" in t else None for t, h, title in zip(texts, held, d["_title"])]
        keep = [x is not None for x in lines]
        if any(keep):
            yield d.loc[keep, ["_key", "field"]].assign(vid=[_hash(t) for t, k in zip(texts, keep) if k], lines=[x for x in lines if x is not None])


class Scans:
    """What the two scans find: misread (form, fix, n, fix_n), and lines of the damaged values with their repairs."""

    def __init__(self, df: DataFrame, key: str, fields: list[str], title: str | None = None, ratio: int = 8, least: int = 5):
        spark = df.sparkSession
        parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("_value")) for f in fields))
        t = F.col(title) if title else F.lit(None).cast("string")
        values = df.select(F.col(key).alias("_key"), t.alias("_title"), F.explode(parts).alias("v")).select("_key", "_title", "v.field", "v._value").where("length(_value) > 0")
        self.counts = counts = written(values.select("_value").mapInPandas(_counts, "word string, h bigint, n bigint").groupBy("word", "h").agg(F.sum("n").alias("n")), "counts")
        words = counts.where("word is not null").select("word", "n")
        plain = words.where(~F.col("word").contains("-") & ~F.col("word").startswith("\n") & (F.length("word") >= 3))
        shape = F.pandas_udf(lambda s: s.map(skeleton), T.StringType())
        plain = plain.withColumn("shape", shape("word"))
        # a shape's words are its frequent forms that are no misreadings of a far more frequent one
        top = plain.where(F.col("word").rlike(r"^\p{L}+$") & (F.col("n") >= least)).select("shape", F.col("word").alias("fix"), F.col("n").alias("fix_n"))
        likely = F.pandas_udf(_likely, T.BooleanType())
        enough = F.when(F.length("word") < 5, 10 * ratio).otherwise(ratio)
        meant = lambda forms, words, times: (
            forms.join(words, "shape").where((F.col("word") != F.col("fix")) & (F.col("fix_n") >= F.col("n") * times))
            .select(F.col("word").alias("form"), "fix", "n", "fix_n").where(likely("form", "fix"))
        )
        own = meant(top.select("shape", F.col("fix").alias("word"), F.col("fix_n").alias("n")), top, F.greatest(enough, F.lit(20))).select(F.col("form").alias("fix")).distinct()
        top = written(top.join(own, "fix", "left_anti"), "top")
        self.misread = misread = written(meant(plain.where(F.col("word").rlike(r"\p{L}")), top, enough), "misread")
        # a bitmap sized by the forms; where they are very many, more values are taken apart for nothing
        shared = spark.sparkContext.broadcast(bits_of(misread.select(F.xxhash64("form").alias("h")), "h", bits_for(misread.count(), 64)))
        kind = dict(values.dtypes)["_key"]
        self.key = key
        found = written(values.mapInPandas(lambda it: _apart(it, shared), f"_key {kind}, field string, vid bigint, lines array<{LINE}>").distinct(), "lines")
        each = found.select("_key", "field", "vid", F.inline("lines"))

        # misread words: the fix that stands beside the same neighbours elsewhere, else the most frequent
        f = each.select("_key", "field", "vid", "no", F.explode("forms").alias("f")).select("_key", "field", "vid", "no", "f.*").join(misread, "form")
        beside = counts.where("word is null").select("h", "n")
        hash_of = lambda a, b: F.xxhash64(a).bitwiseXOR(F.xxhash64(F.concat(b, F.lit("\x01"))))
        f = f.withColumn("h1", hash_of("before", "fix")).withColumn("h2", hash_of("fix", "after"))
        f = f.join(beside.select(F.col("h").alias("h1"), F.col("n").alias("s1")), "h1", "left").join(beside.select(F.col("h").alias("h2"), F.col("n").alias("s2")), "h2", "left")
        f = f.withColumn("support", F.coalesce("s1", F.lit(0)) + F.coalesce("s2", F.lit(0)))
        best = f.groupBy("_key", "field", "vid", "no", "form").agg(F.max(F.struct("support", "fix_n", "fix")).alias("b"), F.first("n").alias("n"))
        # a form of a word that isn't far more frequent needs a neighbour's support
        fixes = best.where((F.col("b.support") > 0) | (F.col("b.fix_n") >= 50 * F.col("n"))).groupBy("_key", "field", "vid", "no").agg(F.map_from_entries(F.collect_list(F.struct("form", "b.fix"))).alias("fixes"))

        # broken words: is the joined word or the compound with a hyphen of its own the more frequent one
        b = each.where("a is not null").select("_key", "field", "vid", "no", "a", "b", "mark")
        n_of = lambda c: words.select(F.col("word").alias(f"w_{c}"), F.col("n").alias(f"n_{c}"))
        b = b.withColumn("w_j", F.concat("a", "b")).withColumn("w_c", F.concat_ws("-", "a", "b")).withColumn("w_a", F.col("a")).withColumn("w_b", F.col("b"))
        for c in "jcab":
            b = b.join(n_of(c), f"w_{c}", "left")
        b = b.na.fill(0, ["n_j", "n_c", "n_a", "n_b"])
        broken = (F.col("mark") != "-") | ((F.col("n_j") > F.col("n_c")) & (F.col("n_j") > 1)) | ((F.col("n_j") <= 1) & (F.col("n_c") <= 1) & ~((F.col("n_a") >= least) & (F.col("n_b") >= least)))
        b = b.where(broken).join(misread.groupBy("form").agg(F.max_by("fix", "fix_n").alias("whole")), F.col("w_j") == F.col("form"), "left")
        b = b.select("_key", "field", "vid", "no", F.lit(True).alias("broken"), F.col("whole"))

        headers = _headers(words.where(F.col("word").startswith("\n")).select("word"))
        each = each.join(headers, "header", "left").withColumn("kind", F.when(F.col("is_header"), "header").otherwise(F.col("kind")))
        on = ["_key", "field", "vid", "no"]
        safe = lambda x, y: [x[c].eqNullSafe(y[c]) for c in on]
        x = each.join(fixes, safe(each, fixes), "left").select(each["*"], fixes["fixes"])
        x = x.join(b, safe(x, b), "left").select(x["*"], F.coalesce(b["broken"], F.lit(False)).alias("broken"), b["whole"])
        x = x.withColumn("n_lines", F.count("*").over(W.partitionBy("_key", "field", "vid")))
        self.lines = x.withColumn("damage", F.when(F.col("kind").isin("page", "header") & (F.col("n_lines") > 1), F.col("kind")).when(F.col("broken"), "broken").when(F.col("fixes").isNotNull(), "misread"))

    def found(self) -> DataFrame:
        """key, field of the damaged values."""
        return self.lines.where("damage is not null").select(F.col("_key").alias(self.key), "field").distinct()

    def repaired(self) -> DataFrame:
        """key, field, repaired: the damaged values as continuous paragraphs.

        Headers and page numbers go, broken words are joined, misread words replaced, lines of a paragraph joined by
        spaces. Blank lines, list entries and figures under a label keep lines of their own.
        """
        v = ["_key", "field", "vid"]
        bad = self.lines.groupBy(*v).agg(F.max("damage").alias("d")).where("d is not null").drop("d")
        doc = W.partitionBy(*v).orderBy("no")
        gone = lambda k: F.coalesce(k.isin("page", "header"), F.lit(False))
        margin = (F.col("kind") == "blank") & (gone(F.lag("kind").over(doc)) | gone(F.lead("kind").over(doc)))
        x = self.lines.withColumn("kind", F.when(margin, "page").otherwise(F.col("kind"))).join(bad, [self.lines[c].eqNullSafe(bad[c]) for c in v], "left_semi").where("kind not in ('page', 'header')")
        fix = F.pandas_udf(_fix_words, T.StringType())
        x = x.withColumn("text", F.when(F.col("fixes").isNotNull(), fix("text", F.to_json("fixes"))).otherwise(F.col("text")))
        w = W.partitionBy(*v).orderBy("no")
        own = F.col("kind").isin("blank", "entry", "figures")
        x = x.withColumn("starts", own | F.lag(own).over(w))
        x = x.withColumn("paragraph", F.sum(F.when(F.coalesce("starts", F.lit(True)), 1).otherwise(0)).over(w))
        # a broken word that is misread as a whole is put at the first line's end and taken from the second
        body = F.when(F.lag("whole").over(w).isNotNull(), F.regexp_replace(F.ltrim("text"), r"^\p{L}+", "")).otherwise(F.trim("text"))
        mended = F.when(F.col("whole").isNotNull(), F.concat(F.regexp_replace(body, r"\p{L}+[-\x{AD}¬]\s*$", ""), F.col("whole"))).otherwise(F.regexp_replace(body, r"[-\x{AD}¬]\s*$", ""))
        x = x.withColumn("piece", F.when(F.col("broken"), mended).otherwise(F.concat(body, F.lit(" "))))
        p = x.groupBy(*v, "paragraph").agg(F.array_sort(F.collect_list(F.struct("no", "piece"))).alias("l"), F.max("kind").alias("kind"))
        p = p.withColumn("line", F.rtrim(F.array_join(F.transform("l", lambda s: s["piece"]), "")))
        t = p.groupBy(*v).agg(F.array_sort(F.collect_list(F.struct("paragraph", "line"))).alias("p"))
        return t.select(F.col("_key").alias(self.key), "field", F.trim(F.array_join(F.transform("p", lambda s: s["line"]), "\n")).alias("repaired"))


def _headers(places: DataFrame, least: int = 3) -> DataFrame:
    """header, is_header of the masked lines that stand between unrelated texts. places: word, each place once.

    Copies of a text give one place. Places that share the words on one side (versions of a text) count together as
    one; there must be `least` of them and a tenth of all places, so that edits in many versions don't add up. Half of
    the places must stand out from their texts, so that lines of texts in capitals are none at any size.
    """
    part = F.split("word", "\n")
    p = places.select(part[1].alias("header"), part[2].alias("before"), part[3].alias("after"), part[4].cast("int").alias("out"))
    p = p.groupBy("header", "before", "after").agg(F.max("out").alias("out"))
    same = F.greatest(*(F.count("*").over(W.partitionBy("header", c)) for c in ("before", "after")))
    g = p.withColumn("share", 1 / same).groupBy("header").agg(F.sum("share").alias("apart"), F.count("*").alias("places"), F.avg("out").alias("out"))
    return g.where((F.col("apart") > least - 0.01) & (F.col("apart") >= F.col("places") / 10) & (F.col("out") >= 0.5)).select("header", F.lit(True).alias("is_header"))


def _likely(seen: pd.Series, meant: pd.Series) -> pd.Series:
    """One misreading, and one more for every five letters."""
    return pd.Series([(n := misreadings(a, b)) is not None and n <= 1 + len(b) // 5 for a, b in zip(seen, meant)], dtype=bool)


def _fix_words(text: pd.Series, fixes: pd.Series) -> pd.Series:
    import json

    def one(t: str, m: dict[str, str]) -> str:
        def put(x: re.Match) -> str:
            f = m.get(x[0].lower())
            return x[0] if f is None or CODE.match(x[0]) else f.upper() if x[0].isupper() and len(x[0]) > 1 else f.capitalize() if x[0][0].isupper() else f

        return TOKEN.sub(put, t)

    return pd.Series([one(t, json.loads(f)) if f else t for t, f in zip(text, fixes)], dtype=object)
