"""Problem 4: the names people typed, linked to persons and organisations.

Rows are first put together by place and normalised name, so that a hot name is one node. Nodes of a place whose padded
q-grams share a MinHash band are candidates; how many bands there are follows from the collision curve. Candidates are
verified by Monge-Elkan similarity and by given names (short forms, initials), and clustered by stars: in each round
the nodes that outrank all their unassigned neighbours become centres and take these.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirework.llm.common import mix, written

#: Given names and their short forms.
SHORT_FORMS = {
    "alexander": "alex sasha sandy", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "catherine": "cathy kate katie",
    "charles": "charlie chuck", "christina": "chris tina", "christopher": "chris kit", "daniel": "dan danny", "edward": "ed eddie ted ned",
    "eleanor": "ella nell nora", "elizabeth": "beth betty eliza lisa liz lizzie", "frederick": "fred freddie", "gabriella": "gaby gabby ella", "gregory": "greg",
    "harold": "hal harry", "henrietta": "etta hettie hattie", "henry": "hank harry hal", "isabella": "bella izzy", "james": "jim jimmy jamie",
    "john": "jack johnny", "joseph": "joe", "josephine": "jo josie", "katherine": "kate kathy katie", "lawrence": "larry laurie",
    "leonard": "leo len lenny", "margaret": "meg maggie peggy", "matthew": "matt", "michael": "mike mick", "nicholas": "nick",
    "oliver": "ollie", "patricia": "pat patty trish", "patrick": "pat paddy", "penelope": "penny nell", "richard": "rick dick",
    "robert": "bob rob bert", "samuel": "sam", "stephen": "steve", "susanna": "sue susie", "theodora": "dora thea",
    "theodore": "ted theo", "thomas": "tom tommy", "ursula": "ulla", "veronica": "vera ronnie", "victoria": "vicky tori",
    "william": "bill will billy", "winifred": "winnie freda", "yevgenia": "zhenya", "zachary": "zach zack",
}
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "phd", "md", "msc", "bsc", "mba", "jr", "sr", "dipl", "ing", "frcp"}
#: Kinds of organisation and the small words in their names.
KINDS = ["consortium", "network", "collaborative", "collaboration", "group", "alliance", "initiative", "society", "institute", "center", "centre", "committee", "association", "foundation"]
SMALL = {"the", "for", "of", "and", "f", "in", "on", "de", "la", "a"}
PLACE_WORDS = r"\b(institute|inst|of|dept|department|university|univ|hospital|center|centre|college|school)\b"


def bands(similarity: float, recall: float, rows: int) -> int:
    """The number of bands of `rows` hashes each with which pairs of that Jaccard similarity collide with that recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def plain(text: str) -> str:
    """Lower case without accents and marks."""
    t = unicodedata.normalize("NFKD", text.lower().replace("ß", "ss").replace("ø", "o").replace("ł", "l"))
    return "".join(c for c in t if not unicodedata.combining(c))


def fold(text: str) -> str:
    """plain, with written-out umlauts as the bare vowel."""
    return re.sub(r"([aou])e", r"\1", plain(text))


@lru_cache(1 << 17)
def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that turn a into b."""
    if a == b:
        return 0
    before, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            n = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                n = min(n, before[j - 2] + 1)
            row.append(n)
        before, prev = prev, row
    return prev[-1]


def alike(a: str, b: str) -> float:
    """1 less the share of edits; an abbreviation of three letters or more is alike its word."""
    if len(min(a, b, key=len)) >= 3 and (a.startswith(b) or b.startswith(a)):
        return 1.0 if min(len(a), len(b)) < 7 else max(0.9, 1 - abs(len(a) - len(b)) / max(len(a), len(b)))
    return 1 - edits(a, b) / max(len(a), len(b), 1)


def alike_either(a: tuple[str, str], b: tuple[str, str]) -> float:
    """alike of two words as (folded, plain), whichever is closer: a slip may tear or make what looks like an umlaut."""
    return 1.0 if a[0] == b[0] else max(alike(a[0], b[0]), alike(a[1], b[1]))


def swapped(a: str, b: str) -> bool:
    """Whether a is b with two neighbours swapped."""
    d = [k for k, (x, y) in enumerate(zip(a, b)) if x != y]
    return len(a) == len(b) and len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]


def monge_elkan(a: list[str], b: list[str], sim=alike) -> float:
    """The mean of each token's best similarity in the other name, from the side where it is less."""
    if not a or not b:
        return 0.0
    one = lambda p, q: sum(max(sim(x, y) for y in q) for x in p) / len(p)
    return min(one(a, b), one(b, a))


def letters(word: str) -> int:
    """The set of a word's letters as bits."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


class Given:
    """Given names: canonical names of a token, and the initials a name may be cut to."""

    def __init__(self, present: set[str]):
        """present: short forms that occur in the data; others lend no initials."""
        self.full: dict[str, set[str]] = {}
        self.initials: dict[str, set[str]] = {}
        for name, shorts in SHORT_FORMS.items():
            name = fold(name)
            own = [fold(s) for s in shorts.split()]
            for x in (name, *own):
                self.full.setdefault(x, set()).add(name)
            self.initials[name] = {name[0]} | {s[0] for s in own if s in present}
        self.known = [(k, letters(k)) for k in sorted(self.full) if len(k) >= 4]
        self.seen: dict[str, frozenset[str]] = {}

    def canonical(self, token: str) -> frozenset[str]:
        """Full names the token may stand for, one edit allowed (two in long ones); empty if none."""
        if token not in self.seen:
            got = self.full.get(token)
            if got is None and len(token) >= 4:
                most, own = 1 if len(token) < 7 else 2, letters(token)
                # an edit changes the set of letters by two at most
                near = (k for k, x in self.known if abs(len(k) - len(token)) <= most and (own ^ x).bit_count() <= 2 * most)
                best = min(((edits(token, k), k) for k in near), default=(9, ""))
                got = self.full[best[1]] if best[0] <= most else None
            self.seen[token] = frozenset(got or ())
        return self.seen[token]


def parse(name: str, place: str | None, given: Given) -> dict:
    """kind (person, org, acronym), family (or the organisation's words), names (full given names), initials; plain: the
    words of family as they are spelled."""
    bare = re.sub(r"(?<=\w)[\d*†‡]+(?:,\d+)*|[*†‡]", " ", name)
    acronym = re.findall(r"\(([A-Z]{2,8})\)", bare)
    bare = re.sub(r"\([^)]*\)", " ", bare)
    words = re.findall(r"[^\W\d_]+", bare)
    spelled = {fold(w): plain(w) for w in words}
    if len(words) == 1 and 3 <= len(words[0]) <= 8 and words[0].isupper():
        return {"kind": "acronym", "family": [words[0].lower()], "plain": [words[0].lower()], "names": [], "initials": []}
    low = [fold(w) for w in words]
    where = fold(place or "")
    if any(w == "for" for w in low) or where and where in low or any(w in ("cons", "netw", "collab") or len(w) > 4 and any(edits(w, k) <= 1 for k in KINDS if abs(len(k) - len(w)) < 2) for w in low):
        own = [w for w in low if w != where and w not in SMALL]
        return {"kind": "org", "family": own, "plain": [spelled[w] for w in own], "names": [x.lower() for x in acronym], "initials": []}
    left, _, right = bare.partition(",")
    has_titles = lambda s: [w for w in re.findall(r"[^\W\d_]+", s) if fold(w) not in TITLES]
    a, b = has_titles(left), has_titles(right)
    long = lambda ws: [fold(w) for w in ws if len(w) > 1 and not (len(w) == 2 and w.isupper() and fold(w) not in given.full)]
    single = lambda ws: [fold(c) for w in ws if not (len(w) > 1 and not (len(w) == 2 and w.isupper() and fold(w) not in given.full)) for c in w]
    if a and b:
        family, rest, first = long(a), long(b), single(b)
    else:
        ws = a or b
        lw, first = long(ws), single(ws)
        is_given = [bool(given.canonical(w)) for w in lw]
        if len(lw) == 1 or first and not any(is_given):
            family, rest = lw, []
        elif is_given[0] or not any(is_given):
            family, rest = lw[1:], lw[:1]
        elif is_given[-1]:
            family, rest = lw[:-1], lw[-1:]
        else:
            k = is_given.index(True)
            family, rest = lw[:k] + lw[k + 1 :], [lw[k]]
        if not any(len(w) > 1 for w in family) and rest:
            family, rest = rest, []
    names = sorted(given.canonical(rest[0]) or {rest[0]}) if rest else []
    initials = sorted(set().union(*(given.initials.get(n, {n[0]}) for n in names))) if names else first[:1]
    family = family or rest or first
    return {"kind": "person", "family": family, "plain": [spelled.get(w, w) for w in family], "names": names, "initials": initials}


def q_grams(words: list[str], q: int = 2) -> set[str]:
    """Padded q-grams of each word."""
    return {p[k : k + q] for w in words for p in [f"{'#' * (q - 1)}{w}{'$' * (q - 1)}"] for k in range(len(p) - q + 1)}


def _nodes(batches: Iterator[pd.DataFrame], present: set[str], n_bands: int, rows: int) -> Iterator[pd.DataFrame]:
    given = Given(present)
    seeds = mix(np.arange(1, n_bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    for d in batches:
        out = []
        for place, name in zip(d["place"], d["name"]):
            p = parse(name, place, given)
            words = sorted(p["family"])
            keys: list[int] = []
            if p["kind"] != "person":  # an acronym may stand for any organisation with its letters
                letters = p["family"][0] if p["kind"] == "acronym" else fold(place or "")[:1] + "".join(w[0] for w in p["family"])
                keys += [xxhash.xxh64_intdigest("acronym" + "".join(sorted(x))) for x in (letters, *p["names"])]
            if p["kind"] != "acronym":
                grams = q_grams(words)
                h = np.fromiter((xxhash.xxh64_intdigest(g) for g in grams), np.uint64, len(grams))
                if len(h):
                    with np.errstate(over="ignore"):
                        m = (h[:, None] * seeds[None, :]).min(0).reshape(n_bands, rows)
                        k = np.arange(1, n_bands + 1, dtype=np.uint64)
                        for r in range(rows):
                            k = mix(k * np.uint64(0x9E3779B97F4A7C15) + m[:, r])
                    keys += k.tolist()
            out.append((p["kind"], p["family"], p["plain"], p["names"], p["initials"], np.array(sorted(set(keys)), np.uint64).view(np.int64)))
        yield d.assign(**dict(zip(["kind", "family", "plain", "names", "initials", "bands"], zip(*out)))) if out else d.assign(kind=[], family=[], plain=[], names=[], initials=[], bands=[])


def same(a: dict, b: dict, place: str, least: float) -> float:
    """The Monge-Elkan similarity of two nodes' names if they can mean the same, else 0."""
    ka, kb = a["kind"], b["kind"]
    if "acronym" in (ka, kb):
        if "person" in (ka, kb):
            return 0.0
        if ka == kb:
            return float(a["family"] == b["family"])
        org, short = (b, a) if ka == "acronym" else (a, b)
        if short["family"][0] in org["names"]:
            return 1.0
        full = sorted(place[:1] + "".join(w[0] for w in org["family"]))
        return float(sorted(short["family"][0]) == full)
    if ka != kb:
        return 0.0
    sim = monge_elkan(*(list(zip(x["family"], x["plain"])) for x in (a, b)), alike_either)
    if sim < least or ka == "org":
        return sim if sim >= least else 0.0
    if len(a["family"]) != len(b["family"]) and "".join(sorted("".join(a["family"]))) != "".join(sorted("".join(b["family"]))):
        return 0.0
    # a spelling of the family name that several rows have is no slip of another one
    x, y = sorted((a["support"], b["support"]))
    if sorted(a["family"]) != sorted(b["family"]) and x >= max(2, 0.1 * y) and not any(swapped(p, q) for p in a["plain"] for q in b["plain"]):
        return 0.0
    if a["names"] and b["names"]:
        close = bool(set(a["names"]) & set(b["names"])) or any(p[0] == q[0] and alike(p, q) >= 0.75 for p in a["names"] for q in b["names"])
        return sim if close else 0.0
    return sim if set(a["initials"]) & set(b["initials"]) else 0.0


def _check(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    for d in batches:
        sims = [same({k: r[f"{k}_a"] for k in ("kind", "support")} | {k: list(r[f"{k}_a"]) for k in ("family", "plain", "names", "initials")},
                     {k: r[f"{k}_b"] for k in ("kind", "support")} | {k: list(r[f"{k}_b"]) for k in ("family", "plain", "names", "initials")}, fold(r["place_a"]), least)
                for r in d.to_dict("records")]
        yield d[["a", "b"]].assign(sim=np.array(sims, float))


def place_of(affiliation: Column) -> Column:
    """The place in an affiliation: what is left of its last part without the words for institutions, or what stands
    before the word institute where it is in one part."""
    a = F.trim(F.regexp_replace(F.lower(affiliation), r"\s+", " "))
    last = F.element_at(F.split(a, ","), -1)
    one = F.regexp_extract(a, r"^(.*?)\s*\b(?:institute|inst|university|univ|hospital)\b", 1)
    p = F.when(a.contains(","), F.regexp_replace(last, PLACE_WORDS, " ")).otherwise(one)
    return F.nullif(F.trim(F.regexp_replace(p, r"[\s.]+", " ")), F.lit(""))


class Names:
    def __init__(self, df: DataFrame, key: str, name: str, affiliation: str, least: float = 0.8, similarity: float = 0.35, recall: float = 0.999, rows: int = 2):
        """Rows without a name mean nobody. A row whose affiliation is null gets its place from a word of its name that
        is a place elsewhere; a row without any place is only the same as rows with the same name and no place.
        Repeated rows are repeated members. A tie of ranks goes to the lesser node id."""
        self.key = key
        base = df.select(F.col(key).alias("_key"), F.trim(F.regexp_replace(F.col(name), r"\s+", " ")).alias("name"), place_of(F.col(affiliation)).alias("place")).where("length(name) > 0")
        typed = base.groupBy("name", "place").agg(F.count("*").alias("n"))
        towns = typed.where("place is not null").select(F.col("place").alias("town")).distinct()
        lost = typed.where("place is null").select("name", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(r"(\p{L}+)")))).alias("town"))
        found = lost.join(towns, "town").groupBy("name").agg(F.min("town").alias("town")).withColumnRenamed("name", "_n")
        placed = typed.where("place is not null").unionByName(
            typed.where("place is null").join(found, F.col("name") == F.col("_n"), "left").select("name", F.col("town").alias("place"), "n")
        ).groupBy("name", "place").agg(F.sum("n").alias("n"))
        placed = placed.withColumn("node", F.xxhash64("name", F.lit("\x01"), F.coalesce("place", F.lit("\x02"))))
        # short forms that occur: as many rows as the table has at most
        shorts = [fold(s) for x in SHORT_FORMS.values() for s in x.split()]
        w = typed.select(F.explode(F.split(F.lower("name"), r"[^\p{L}]+")).alias("w")).where(F.col("w").isin(shorts)).distinct()
        present = {r[0] for r in w.collect()}
        n_bands = bands(similarity, recall, rows)
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a stated number isn't coalesced
        kinds = "node bigint, place string, name string, n bigint, kind string, family array<string>, plain array<string>, names array<string>, initials array<string>, bands array<bigint>"
        nodes = placed.select("node", "place", "name", "n").repartition(tasks, "node").mapInPandas(lambda it: _nodes(it, present, n_bands, rows), kinds)
        parsed = written(nodes, "parsed")
        # how many rows have a family name in its place, summed up before it meets the names
        family = F.array_sort("family")
        spelled = parsed.groupBy(F.coalesce("place", F.lit("\x02")).alias("_p"), F.col("kind").alias("_k"), family.alias("_f")).agg(F.sum("n").alias("support"))
        nodes = parsed.drop("bands").join(spelled, (F.coalesce("place", F.lit("\x02")) == F.col("_p")) & (F.col("kind") == F.col("_k")) & (family == F.col("_f"))).drop("_p", "_k", "_f")
        self.nodes = nodes = written(nodes, "nodes")

        # persons who mean the same share an initial, so it is part of the key: a town's common family name is divided by
        # it, and what meets are spellings of the same name. The key stands for place, band and initial
        initials = F.when((F.col("kind") == "person") & (F.size("initials") > 0), F.col("initials")).otherwise(F.array(F.lit("")))
        keys = parsed.where("place is not null").select("node", "place", "bands", F.explode(initials).alias("initial")).select("node", "place", "initial", F.explode("bands").alias("band"))
        keys = keys.select("node", F.xxhash64("place", "band", "initial").alias("key"))
        a, b = keys.withColumnRenamed("node", "a"), keys.withColumnRenamed("node", "b")
        pairs = a.join(b, "key").where("a < b").select("a", "b").distinct()
        own = ("place", "kind", "family", "plain", "names", "initials", "support")
        for x in "ab":
            pairs = pairs.join(nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in own)), x)
        pairs = pairs.where("place_a = place_b and (kind_a = 'person') = (kind_b = 'person')").repartition(tasks)
        links = pairs.mapInPandas(lambda it: _check(it, least), "a bigint, b bigint, sim double").where("sim > 0")
        self.links = written(links, "links")
        self.stars = self._stars()

    def _stars(self) -> DataFrame:
        """node, centre."""
        both = self.links.select("a", "b").unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        full = F.size("names") > 0
        rank = both.groupBy("a").agg(F.count("*").alias("degree")).join(self.nodes.select(F.col("node").alias("a"), "n", "support", full.alias("full")), "a")
        rank = rank.select(F.col("a").alias("node"), F.struct("support", "degree", "full", "n", F.negative("a").alias("id")).alias("rank"))
        edges = written(both.join(rank.select(F.col("node").alias("b"), F.col("rank").alias("rank_b")), "b").join(rank.select(F.col("node").alias("a"), F.col("rank").alias("rank_a")), "a"), "edges")
        done = None
        while True:
            best = edges.groupBy("a").agg(F.max("rank_b").alias("best"), F.first("rank_a").alias("own"))
            centres = best.where("own > best").select(F.col("a").alias("centre"), F.col("own").alias("rank"))
            taken = edges.join(centres.select(F.col("centre").alias("b")), "b").groupBy("a").agg(F.max_by("b", "rank_b").alias("centre"))
            stars = written(taken.select(F.col("a").alias("node"), "centre").unionByName(centres.select(F.col("centre").alias("node"), "centre")), "stars")
            done = stars if done is None else done.unionByName(stars)
            out = stars.select("node")
            edges = written(edges.join(out.withColumnRenamed("node", "a"), "a", "left_anti").join(out.withColumnRenamed("node", "b"), "b", "left_anti"), "edges")
            if edges.isEmpty():
                break
        # a node left alone, all of whose neighbours other centres took, goes with the one of highest rank
        done = written(done, "stars")
        alone = done.groupBy("centre").agg(F.count("*").alias("c")).where("c = 1").select(F.col("centre").alias("a"))
        near = both.join(alone, "a").join(rank.select(F.col("node").alias("b"), "rank"), "b").join(done.select(F.col("node").alias("b"), "centre"), "b")
        moved = near.join(alone.select(F.col("a").alias("centre")), "centre", "left_anti").groupBy("a").agg(F.max_by("centre", "rank").alias("to"))
        out = done.join(moved, done["node"] == moved["a"], "left").select("node", F.coalesce("to", "centre").alias("centre"))
        return written(out, "stars")

    def members(self) -> DataFrame:
        """key, entity: one row for each row with a name."""
        s = self.nodes.join(self.stars, "node", "left").select("name", "place", F.coalesce("centre", "node").alias("entity"))
        return s

    def credits(self, df: DataFrame, name: str, affiliation: str) -> DataFrame:
        """key, entity of all rows with a name."""
        base = df.select(F.col(self.key), F.trim(F.regexp_replace(F.col(name), r"\s+", " ")).alias("name"), place_of(F.col(affiliation)).alias("place")).where("length(name) > 0")
        m = self.members().withColumnsRenamed({"name": "_n", "place": "_p"})
        placed = base.join(m, (F.col("name") == F.col("_n")) & F.col("place").eqNullSafe(F.col("_p"))).select(self.key, "entity")
        # rows whose place came from their name
        rest = base.where("place is null").join(m.where("_p is not null"), (F.col("name") == F.col("_n")) & F.lower("name").contains(F.col("_p"))).select(self.key, "entity")
        return placed.unionByName(rest).distinct()


def entities(df: DataFrame, key: str, name: str, affiliation: str, **kw) -> DataFrame:
    """key, entity: rows with the same entity mean the same person or organisation. See Names."""
    return Names(df, key, name, affiliation, **kw).credits(df, name, affiliation)


def entity_pairs(df: DataFrame, key: str, name: str, affiliation: str, **kw) -> DataFrame:
    """key_a < key_b of the rows that mean the same: by definition as many as there are."""
    e = written(entities(df, key, name, affiliation, **kw), "entities")
    a, b = (e.select("entity", F.col(key).alias(f"key_{x}")) for x in "ab")
    return a.join(b, "entity").where("key_a < key_b").select("key_a", "key_b").distinct()
