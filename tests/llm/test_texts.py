"""Problems 1, 2 and 8: held-out accuracy on damaged texts, and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import confusable, scans, stuffing, truncation

NOUNS = ["treatment", "response", "carcinoma", "membrane", "receptor", "antibody", "expression", "dose", "patient", "sample", "tissue", "margin", "volume", "protein", "infiltration"]
VERBS = ["improved", "reduced", "confirmed", "limited", "preserved", "followed", "measured"]


def sentence(r):
    return f"The {r.choice(NOUNS)} of the {r.choice(NOUNS)} {r.choice(VERBS)} the {r.choice(NOUNS)} in {r.randint(2, 90)} cases."


def test_left_open():
    assert truncation.left_open("He said (p = 0.") == "bracket"
    assert truncation.left_open("a “quote") == "quote"
    assert truncation.left_open("<b>bold") == "markup" and truncation.left_open("text <a hre") == "markup"
    assert truncation.left_open("at 1.5 �") == "bytes"
    assert truncation.left_open("fish &am") == "escape" and truncation.left_open("line\\u00") == "escape"
    assert truncation.left_open("(odd. The next sentence ends") is None
    assert truncation.left_open("all (well) “here”. <i>x</i>") is None
    for text in ("Budget for R&D", "Costs of Q&A", "Calls by AT&T", "Smith &Co"):
        assert truncation.left_open(text) is None
    assert truncation.left_open("a &#12") == "escape" and truncation.left_open("R&am") == "escape"


def test_truncation_accuracy(spark):
    r = random.Random(1)
    rows, cut = [], set()
    for k in range(1500):
        text = " ".join(sentence(r) for _ in range(r.randint(1, 4)))
        feed = r.choice(["good", "bad", None])
        if feed == "bad" and r.random() < 0.5:
            p = r.randrange(len(text) // 2, len(text) - 1)
            if text[:p].rstrip()[-1] not in ".!?":
                text, _ = text[:p] + r.choice(["", "…", "\n", "..."]), cut.add(k)
        rows.append((k, feed, text, None, "clash"))
    rows += [(9000, "good", None, None, ""), (9001, "good", "", " \n", ""), (9002, None, "word " * 20000, "Total n = 5", "")]
    df = spark.createDataFrame(rows, "id long, feed string, content string, caption string, field string")
    got = {x.id for x in truncation.truncated(df, "id", "feed", ["content", "caption"]).where("field = 'content'").collect()}
    assert len(got & cut) / len(cut) > 0.97 and len(got - cut - {9002}) <= 0.02 * len(cut) + 2
    rates = {x.feed: x for x in truncation.truncation_rates(df, "id", "feed", ["content", "caption"]).collect()}
    assert rates["bad"].rate > 0.3 and rates["good"].rate < 0.02 and set(rates) == {"good", "bad", None}
    assert truncation.truncated(df.limit(0), "id", "feed", ["content"]).count() == 0


def test_endings_that_are_weighed(spark):
    r = random.Random(3)
    text = lambda n: " ".join(sentence(r) for _ in range(n))
    rows = [(k, "good", f"{text(2)} The {r.choice(NOUNS)} was seen in {'group (B)' if k % 3 else '(B) and after'}.", r.choice(["Budget for R&D", "Costs of Q&A", "Calls by AT&T", f"Response of the {r.choice(NOUNS)} (A)", "Panel [b]"])) for k in range(300)]
    # an intake that cuts, sometimes just behind a bracket
    cut = [f"{text(2)} The {r.choice(NOUNS)} (B) of" if k % 2 else f"{text(2)} The {r.choice(NOUNS)} of the {r.choice(NOUNS)[:1 + k % 3]}" for k in range(200)]
    rows += [(1000 + k, "bad", t, None) for k, t in enumerate(cut)]
    df = spark.createDataFrame(rows, "id long, feed string, content string, caption string")
    got = {(x.id, x.field) for x in truncation.truncated(df, "id", "feed", ["content", "caption"]).collect()}
    assert got == {(1000 + k, "content") for k in range(200)}


def test_parts_of_words_prove_no_end(spark):
    r = random.Random(5)
    text = lambda n: " ".join(sentence(r) for _ in range(n))
    rows = [(k, f"{text(2)} Cells were kept in ice.") for k in range(60)]
    rows += [(100 + k, f"{text(2)} Cells were kept in ice") for k in range(80)]
    # the same parts of words before marks of omission, page numbers and broken lines of other texts
    for k in range(12):
        rows += [(2000 + k, f"{text(1)} The {NOUNS[k]} of the infil..."), (2100 + k, f"{text(1)} The {NOUNS[k]} of the in-\np. {k + 1}\nfiltration was measured.")]
        rows += [(2200 + k, f"{text(1)} The {NOUNS[k]} of the\np. {k + 1}\nprotein was measured."), (2300 + k, f"{text(1)} The {NOUNS[k]} of the tis [...]")]
    cut = {3000: "The membrane of the infil", 3001: "The antibody of the p", 3002: "The antibody of the tis", 3003: "The sample of the infil"}
    rows += [(k, f"{text(1)} {t}") for k, t in cut.items()]
    df = spark.createDataFrame(rows, "id long, content string").withColumn("feed", F.lit("mixed"))
    want = set(cut) | {2000 + k for k in range(12)} | {2300 + k for k in range(12)}
    assert {x.id for x in truncation.truncated(df, "id", "feed", ["content"]).collect()} == want


def test_copies_prove_nothing(spark):
    r = random.Random(6)
    rows = [(k, f"{sentence(r)} Cells were kept in ice.") for k in range(60)]
    rows += [(100 + k, f"{sentence(r)} Cells were kept in ice") for k in range(40)]
    rows += [(200 + k, f"{sentence(r)} The {r.choice(NOUNS)} of the {r.choice(NOUNS)} improved the") for k in range(40)]
    # what one text says of a word is no support, however often that text is there
    rows += [(300, f"{sentence(r)} Cells were kept in the wes."), (301, f"{sentence(r)} Cells were kept in the wes"), (302, f"{sentence(r)} Nothing was said of the wes")]
    df = spark.createDataFrame(rows, "id long, content string").withColumn("feed", F.lit("mixed"))
    want = [*range(200, 240), 301, 302]
    for n in (1, 20):
        got = truncation.truncated(df.crossJoin(spark.range(n).withColumnRenamed("id", "copy")).drop("copy"), "id", "feed", ["content"])
        assert sorted(x.id for x in got.collect()) == [k for k in want for _ in range(n)]


def test_last_tokens_go_back_as_far_as_they_lie():
    long = " ".join(["x" * 150] * 9)
    assert truncation._last_tokens(long) == ["x" * 150] * 8
    assert truncation._last_tokens("a b") == ["a", "b"] and truncation._last_tokens("") == []


def test_confusables():
    assert confusable.misreadings("rnodern", "modern") == 1 and confusable.misreadings("cydes", "cycles") == 1 and confusable.misreadings("imagmg", "imaging") == 1
    assert confusable.misreadings("and", "alter") is None and confusable.misreadings("cat", "dog") is None
    for a, b in confusable.READS:
        assert confusable.misreadings(f"x{b}y", f"x{a}y") is not None


def scanned(r, text):
    """text as lines with breaks, misread letters, a header and a page number."""
    words, out, line = text.split(" "), [], ""
    for w in words:
        if len(w) > 8 and r.random() < 0.2 and w.isalpha():
            out.append(line + w[:4] + "-")
            line = w[4:] + " "
            continue
        line += w + " "
        if len(line) > 60:
            out.append(line.strip())
            line = ""
    out.append(line.strip())
    out[1:1] = ["- 17 -", "Journal Of Imagined Tissue Studies"]
    return "\n".join(x for x in out if x)


def test_scans(spark):
    r = random.Random(2)
    rows, bad, whole = [], set(), {}
    for k in range(1200):
        text = " ".join(sentence(r) for _ in range(4))
        whole[k] = text
        if k % 20 == 0:
            text = scanned(r, text.replace("membrane", "mernbrane", 1))
            bad.add(k)
        elif k % 20 == 1:
            text = text.replace(" in ", "\nin ") + "\nCohort sizes:\n12\n15"
        rows.append((k, text, None, "clash"))
    rows += [(9000, None, None, ""), (9001, "", "", ""), (9002, "a\n\n\n", None, ""), (5, rows[5][1], None, "")]
    df = spark.createDataFrame(rows, "id long, content string, caption string, field string")
    s = scans.Scans(df, "id", ["content", "caption"])
    assert {(x.id, x.field) for x in s.found().collect()} == {(k, "content") for k in bad}
    fixed = {x.id: x.repaired for x in s.repaired().collect()}
    assert {k: fixed[k] for k in bad} == {k: whole[k] for k in bad}
    assert scans.Scans(df.limit(0), "id", ["content"]).found().count() == 0


def brute_runs(w, sizes):
    """Places in repeated runs of the least words and characters that can be made longer on neither side."""
    out = np.zeros(len(w), bool)
    for n in range(stuffing.RUN_WORDS, len(w)):
        places = {}
        for i in range(len(w) - n + 1):
            places.setdefault(tuple(w[i : i + n]), []).append(i)
        for at in places.values():
            around = [{w[k] if 0 <= k < len(w) else ("end", k) for k in ks} for ks in ([i - 1 for i in at], [i + n for i in at])]
            if len(at) > 1 and all(len(x) > 1 for x in around):
                for i in at:
                    if sum(sizes[i : i + n]) >= stuffing.RUN_CHARS:
                        out[i : i + n] = True
    return out


@pytest.mark.parametrize("seed", range(8))
def test_maximal_runs_against_brute_force(seed):
    r = random.Random(seed)
    pages = [[r.randrange(2 + seed) for _ in range(r.randint(0, 40))] for _ in range(6)]
    sizes = [[1 + x % 4 for x in p] for p in pages]
    flat, size = (np.array([x for p in y for x in p], np.int64) for y in (pages, sizes))
    firsts = np.concatenate([[0], np.cumsum([len(p) for p in pages])[:-1]])
    want = [x for p, z in zip(pages, sizes) for x in brute_runs(p, z)]
    assert stuffing.covered(flat, size, firsts).tolist() == want


def test_runs_and_not_words_decide(monkeypatch):
    r = random.Random(6)
    topics = ["tissue", "margin", "plasma", "imaging", "outcome", "receptor", "membrane", "volume"]
    once = [f"{a}{b}" for a in ("cyto", "histo", "immuno", "radio", "neuro", "onco") for b in ("metry", "logy", "graphy", "genesis", "therapy", "plasty", "pathy", "scopy")]
    # a title in many words that come again one by one, and a list of two keywords that come again together
    title = " ".join(f"{r.choice(topics)} {x}" for x in once[:24])
    stuffed = " ".join(f"{r.choice(['cheap tissue', 'tissue margin'])} {x}" for x in once[:12])
    _, coverage, share = stuffing.profiles([title, stuffed])
    assert coverage[0] < 0.05 and share[0] == 0 and coverage[1] > 0.4 and share[1] == 1

    def words(symbols, sizes, firsts):
        page = np.searchsorted(firsts, np.arange(len(symbols)), "right")
        _, where, times = np.unique(page * (symbols.max() + 1) + symbols, return_inverse=True, return_counts=True)
        return times[where] > 1

    monkeypatch.setattr(stuffing, "covered", words)
    assert stuffing.profiles([title])[2][0] == 1
    monkeypatch.setattr(stuffing, "covered", lambda s, *_: np.zeros(len(s), bool))
    assert stuffing.profiles([stuffed])[2][0] == 0


def test_stuffed(spark):
    r = random.Random(4)
    prose = lambda: " ".join(sentence(r) for _ in range(8))
    spam = [
        "buy cheap tissue cheap tissue buy online tissue price cheap tissue sale " * 3,
        "\n".join(f"https://a{k}.example/p/x{k}.html" for k in range(9)),
        "#a_b #cd #ef #gh #liver #margin #plasma #serum",
        "\n".join(f"tissue {k} mg - {k}.50 - sale" for k in range(9)),
        "liver\nplasma\nserum\ntumor margin\nspleen\nsaliva\nurine",
    ]
    fine = [prose(), prose() + "\n\nSee also:\nhttp://a.example/x\nhttp://b.example/y", "Keywords: liver, plasma, serum\n\n" + prose(), "Methods\n" + prose(), "Resistance was linked to loss of the receptor."]
    rows = [(k, t) for k, t in enumerate(spam)] + [(100 + k, t) for k, t in enumerate(fine)] + [(200, None), (201, ""), (202, "\n"), (203, "..."), (0, spam[0])]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "id long, t string, coverage string")
    assert {x.id for x in stuffing.stuffed(df, "id", "t").collect()} == set(range(len(spam)))
    p = stuffing.page_profiles(df, "id", "t").collect()
    assert len(p) == len(spam) + 1 + len(fine)
    assert stuffing.stuffed(df.limit(0), "id", "t").count() == 0
