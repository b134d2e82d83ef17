"""Problems 4, 5 and 7 against brute force, and their edge cases."""

import random
import re

import pytest

from quirework.llm import contamination, names, versions

WORD = re.compile(r"[^\W_]+")


def near(spark_rows, run, least, threshold):
    sets = [(k, set(zip(*(w[i:] for i in range(run))))) for k, t, c in spark_rows if len(WORD.findall((c or "").lower())) >= least for w in [WORD.findall(f"{t or ''} {c or ''}".lower())]]
    out = set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if a != b and x and y and len(x & y) / len(x | y) >= threshold:
                out.add((min(a, b), max(a, b)))
    return out


def version_rows(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randint(45, 120))]
        rows.append((f"c{k}", f"title {k}", " ".join(base)))
        for v in range(r.randint(0, 3)):
            w = list(base)
            for _ in range(r.randint(0, 9)):
                p = r.randrange(len(w))
                w[p : p + r.randint(0, 1)] = [r.choice(vocabulary)]
            rows.append((f"c{k}v{v}", f"Title, {k}", " ".join(w).upper() if v == 2 else " ".join(w)))
    rows += [("copy", "title 0", rows[0][2]), ("c0", "title 0", rows[0][2]), ("short", "t", "a b c"), ("null", None, None), ("empty", "", "")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_versions_against_brute_force(spark, seed):
    rows = version_rows(seed)
    df = spark.createDataFrame([(*x, "clash") for x in rows], "id string, t string, c string, text_id string")
    v = versions.Versions(df, "id", "t", "c", 0.6, 3, 40)
    got = {tuple(r) for r in v.pairs().collect()}
    assert got == near(rows, 3, 40, 0.6)
    c = {(r.id, r.class_id) for r in v.classes().collect()}
    group = dict(c)
    assert {k for k, *_ in rows} - {"short", "null", "empty"} == set(group)
    # classes are what links lead to, though no pairs within a family are needed for them
    root = {k: k for k in group}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in got:
        root[find(a)] = find(b)
    assert len({(find(k), group[k]) for k in group}) == len({find(k) for k in group}) == len(set(group.values()))


@pytest.mark.parametrize("threshold", [0.8, 0.9])
def test_close_versions_against_brute_force(spark, threshold):
    rows = version_rows(3)
    df = spark.createDataFrame([(*x, "clash") for x in rows], "id string, t string, c string, text_id string")
    v = versions.CloseVersions(df, "id", "t", "c", threshold, 5, 40)
    want = near(rows, 5, 40, threshold)
    assert want and {tuple(r) for r in v.pairs().collect()} == want
    group = {r.id: r.class_id for r in v.classes().collect()}
    assert all(group[a] == group[b] for a, b in want)
    assert versions.CloseVersions(df.limit(0), "id", "t", "c").classes().count() == 0


def test_versions_of_hot_text(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(f"k{i}", "t", text) for i in range(200)] + [("x", "t", text + " more"), (None, "t", text)]
    df = spark.createDataFrame(rows, "id string, t string, c string")
    v = versions.Versions(df, "id", "t", "c", 0.6, 3, 40)
    assert v.links.count() == 1
    c = v.classes().collect()
    assert len({r.class_id for r in c}) == 1 and {(r.id, r.n_same) for r in c if r.id in (None, "x", "k0")} == {(None, 201), ("x", 1), ("k0", 201)}
    assert v.pairs().count() == 201 * 200 // 2


def test_classes_of_a_large_family(spark):
    r = random.Random(9)
    base = [f"w{k}" for k in range(100)]
    family = [(f"f{k}", "t", " ".join(w if j != k % 100 else f"x{k}" for j, w in enumerate(base))) for k in range(3000)]
    # texts in pairs that have half of the words in common with all others, and a chain of edits
    plain = [(f"p{k}{x}", "t", " ".join(base[:60] + [f"y{k // 2}z{j}" for j in range(30)] + [f"{x}{k}"])) for k in range(0, 400, 2) for x in "ab"]
    chain = [(f"c{k}", "t", " ".join(f"v{j}" for j in range(5 * k, 5 * k + 60))) for k in range(40)]
    df = spark.createDataFrame(family + plain + chain, "id string, t string, c string")
    v = versions.Versions(df, "id", "t", "c", 0.6, 3, 40)
    group = {x.id: x.class_id for x in v.classes().collect()}
    assert len({group[k] for k, *_ in family}) == 1 and len({group[k] for k, *_ in chain}) == 1
    assert all(group[f"p{k}a"] == group[f"p{k}b"] for k in range(0, 400, 2)) and len(set(group.values())) == 202
    assert v.stars.count() < 12 * len(group)


def test_versions_of_nothing(spark):
    df = spark.createDataFrame([], "id string, t string, c string")
    v = versions.Versions(df, "id", "t", "c")
    assert v.pairs().count() == 0 and v.classes().count() == 0


def test_leaks_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 40)))) for k in range(20)] + [(98, None), (99, "")]
    docs = []
    for k in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if k % 3 == 0:
            w = (items[k % 20][1] or "").split()
            a = r.randrange(max(1, len(w) - 5))
            words[5:5] = [x.upper() + "," for x in w[a : a + r.randint(8, 25)]]
        docs.append((k, "  ".join(words)))
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, items[0][1] * 2), (202, items[0][1] * 2)]
    grams = lambda t: {tuple(w[i : i + 13]) for w in [WORD.findall((t or "").lower())] for i in range(len(w) - 12)}
    want = {(d, i) for d, t in docs if d is not None for i, u in items if grams(t) & grams(u)}
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(x) for x in contamination.leaks(d, i).select("doc_id", "item_id").collect()} == want
    assert {tuple(x) for x in contamination.leaks(d, i, max_grams=1).select("doc_id", "item_id").collect()} == want
    a, b = (sorted((r.doc_id, r.item_id, r.n_words) for r in contamination.leaks(d, i, **kw).collect()) for kw in ({}, {"max_grams": 1}))
    assert set(a) == set(b)
    for r in contamination.leaks(d, i).collect():
        text = dict(docs)[r.doc_id]
        assert len(WORD.findall(text[r.start : r.stop])) == r.n_words
    clean = contamination.without_leaks(d, i)
    assert clean.count() == len(docs)
    assert contamination.leaks(clean, i).count() == 0
    whole = {r.doc_id for r in contamination.without_leaks(d, i, whole_documents=True).collect()}
    assert whole == {k for k, _ in docs} - {k for k, _ in want}
    assert contamination.leaks(d.limit(0), i).count() == 0 and contamination.leaks(d, i.limit(0)).count() == 0


def test_name_parts():
    g = names.Given({"nell", "liz"})
    p = lambda n, place="kibi": names.parse(n, place, g)
    assert p("Prof. Orlov, Penelope J.")["family"] == ["orlov"] and p("Orlov, P.")["initials"] == ["p"]
    assert p("ORLOV Nell")["family"] == ["orlov"] and set(p("Nell Orlov")["initials"]) >= {"n", "p"}
    assert p("J. Balöbera2,3")["family"] == p("J. Baloebera")["family"] == ["balobera"]
    assert p("Kibi Network for Cell Engineering (KNCE)")["kind"] == "org" and p("KNCE")["kind"] == "acronym"
    assert names.edits("abcd", "abdc") == 1 and names.edits("abc", "abxc") == 1 and names.edits("", "ab") == 2
    assert names.bands(0.35, 0.999, 2) == 53
    assert names.monge_elkan(["cons", "cell"], ["cell", "consortium"]) > 0.9


def test_names_of_a_large_town(spark):
    """A common family name: what is compared are spellings of the same name and initial, not all rows or all bearers."""
    given = ["Anna", "Boris", "Clara", "Daniel", "Emma", "Frank", "Gerda", "Hugo", "Ivan", "Karl", "Laura", "Marta", "Wanda", "Otto", "Petra", "Quentin", "Rosa", "Sven", "Tilda", "Urs"]
    a = "Institute of Imaging, Kibi"
    typed = lambda g: [f"{g} Orlovtonen", f"Orlovtonen, {g}", f"{g[0]}. Orlovtonen", f"{g} Orlovotnen", f"Dr. {g} Orlovtonen"]
    rows = [(k, typed(given[k % 20])[k // 20 % 5], a) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, n string, a string")
    n = names.Names(df, "id", "n", "a")
    assert n.nodes.count() == 100 and n.links.count() <= 20 * 10
    group = {r.id: r.entity for r in n.credits(df, "n", "a").collect()}
    assert len(group) == 3000 and len(set(group.values())) == 20 and all(group[k] == group[k % 20] for k in group)


def test_names(spark):
    a = "Institute of Imaging, Kibi"
    rows = [
        (1, "Penelope Orlovtonen", a), (2, "Orlovtonen, P.", "Kibi Institute of Imaging"), (3, "Nell J. Orlovtonen", a.lower()), (4, "Penelope Orlovotnen", a), (5, "Penelope Orlovtonen", "Institute of Trials, Mola"),
        (6, "Harold Orlovtonen", a), (7, "Kibi Network for Cell Engineering", None), (8, "The Kibi Network for Cell Enigneering", a), (9, "KNCE", a), (10, "Network for Cell Engineering, Kibi", None),
        (11, None, a), (12, "", a), (13, "Penelope Orlovtonen", a), (13, "Penelope Orlovtonen", a), (14, "Nobody Anywhere", None), (15, "Nobody Anywhere", None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, n string, a string, node string")
    got = {tuple(r) for r in names.entity_pairs(df, "id", "n", "a").collect()}
    groups = [{1, 2, 3, 4, 13}, {7, 8, 9, 10}, {14, 15}]
    assert got == {(x, y) for g in groups for x in g for y in g if x < y}
    assert {r.id for r in names.entities(df, "id", "n", "a").collect()} == {r[0] for r in rows} - {11, 12}
    assert names.entity_pairs(df.limit(0), "id", "n", "a").count() == 0
