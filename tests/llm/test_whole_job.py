"""Cases that copies, size or a cap once hid from the operators for training data."""

import random

from quirework.llm import contamination, scans, split, truncation

NOUNS = ["treatment", "response", "carcinoma", "membrane", "receptor", "antibody", "tissue", "margin", "volume", "protein"]


def test_headers_by_unrelated_places(spark):
    r = random.Random(7)
    prose = lambda: " ".join(r.choice(NOUNS) for _ in range(8))
    loud = "The trial was closed early.\nESCALATION COHORT TO CONTINUE AT 1.5 MG, ALTHOUGH BINDING OF\nRUBAQUARIN TO TISSUE WAS VARIABLE.\nIt was small."
    rows = [(k, loud) for k in range(30)]
    # versions: words beside the line are edited
    rows += [(100 + k, loud.replace("early", f"late{k}") if k % 2 else loud.replace("RUBAQUARIN", f"RUB{'ABCDEFGHIJKLMNO'[k]}")) for k in range(15)]
    # a line that recurs in unrelated texts in capitals
    rows += [(200 + k, f"{prose().upper()}\nTISSUE RESPONSE\n{prose().upper()}.") for k in range(20)]
    rows += [(300 + k, f"{prose()}\nLetters In Tissue Research\n{prose()}.") for k in range(3)]
    df = spark.createDataFrame(rows, "id long, content string")
    s = scans.Scans(df, "id", ["content"])
    assert {x["_key"] for x in s.lines.where("damage = 'header'").collect()} == {300, 301, 302}
    assert {x.id for x in s.repaired().where("repaired not like '%Letters%'").collect()} == {300, 301, 302}


def test_every_word_of_a_shape_may_be_meant(spark):
    words = ["battle", "baffle", "baille", "bajtle", "balfle", "bartle", "bafile", "battie", "batile"]
    assert len({scans.skeleton(w) for w in words}) == 1
    rows = [(100 * k + j, f"The {w} improved the outcome.") for k, w in enumerate(words) for j in range(90 - k)]
    rows += [(9000, "The bat1le improved the outcome.")]
    df = spark.createDataFrame(rows, "id long, content string")
    s = scans.Scans(df, "id", ["content"])
    assert "batile" in {x.fix for x in s.misread.where("form = 'bat1le'").collect()}
    assert {x.id for x in s.found().collect()} == {9000}


def test_leaks_joined_give_the_same_spans(spark):
    w = [f"w{k}" for k in range(60)]
    items = spark.createDataFrame([(1, " ".join(w[:30])), (1, " ".join(w[20:50])), (2, " ".join(w[5:25]).upper())], "item_id long, text string")
    docs = [(1, "Before, " + "  ".join(w[3:28]) + ". After."), (1, "Other text: " + " ".join(w[10:40])), (2, " ".join(w[:12])), (3, "İ " + " ".join(w[:20])), (4, "x " + " ".join(w[:14])), (4, "x " + " ".join(w[:14])), (None, " ".join(w)), (6, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = [sorted(map(tuple, contamination.leaks(docs, items, max_grams=m).collect())) for m in (2_000_000, 0)]
    assert got[0] == got[1] and len(got[0]) > 6
    clean = [sorted(map(repr, contamination.without_leaks(docs, items, max_grams=m).collect())) for m in (2_000_000, 0)]
    assert clean[0] == clean[1] and len(clean[0]) == 8
    text = [(r.doc_id, r.text) for r in contamination.without_leaks(docs, items).collect()]
    assert (1, "Before, . After.") in text and (1, "Other text: ") in text and (3, "İ ") in text and text.count((4, "x ")) == 2 and (None, " ".join(w)) in text
    whole = [sorted(map(repr, contamination.without_leaks(docs, items, whole_documents=True, max_grams=m).collect())) for m in (2_000_000, 0)]
    assert whole[0] == whole[1] and len(whole[0]) == 3


def test_values_that_only_look_ended(spark):
    whole = "The dose (in mg) was reduced [see there] for “all” patients."
    cut = ["The response of the [...]", "The dose was reduced. [...] ", "The dose (as stated [here] and in all of it.", "Shown (in {one of [them]} only.", "The <b>dose was reduced.", "The tissue of the\n- 17 !"]
    rows = [(k, "a", whole) for k in range(100, 160)] + [(k, "a", t) for k, t in enumerate(cut)]
    df = spark.createDataFrame(rows, "id long, feed string, content string")
    assert {x.id for x in truncation.truncated(df, "id", "feed", ["content"]).collect()} == set(range(len(cut)))
    rates = truncation.truncation_rates(df, "id", "feed", ["content"]).first()
    assert (rates.n_values, rates.n_cut) == (66, 6)


def test_pieces_repeat_words_from_many_ranges_back(spark):
    words = ["a" * 30 if 100 <= k < 160 else f"w{k}" for k in range(400)]
    df = spark.createDataFrame([(1, " ".join(words))], "id long, content string")
    p = split.split_texts(df, "id", "content", max_words=50, overlap=20, range_chars=64).orderBy("piece_no").collect()
    got = p[0].piece.split()
    for x in p[1:]:
        n = min(20, len(got))
        assert x.piece.split()[:n] == got[-n:]
        got += x.piece.split()[n:]
    assert got == words
