"""Problem 8: pages of repeated keywords, keyword or tag lists, links or price lines instead of sentences.

A page is a row of symbols: its words, numbers as one symbol, links as another. A suffix automaton over them finds the
page's maximal repeated runs: those that occur at least twice and can be made longer on neither side without losing an
occurrence. Coverage is the share of characters in maximal runs of at least RUN_WORDS words and RUN_CHARS characters.
Clause structure is judged for each sentence or line: prose has function words among its words, ends with a mark and
has few marks of lists. A sentence or line is stuffing if its missing clause structure and its coverage together are
enough (see `stuffing_of`); a page is reported if most of its words stand in such.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import WORD, by_size

#: Words that hold clauses together, of English, German, French and Spanish.
FUNCTION_WORDS = frozenset("""
a about above after all also although an and another any are as at be because been before being below between both but by can cannot could did do does
during each either for from had has have having he her here his how however if in into is it its itself led less may more most must neither no nor not of on once one
only or other our out over rather she should since so some such than that the their them then there therefore these they this those through to too
under until up upon was we were what when where whereas whether which while who whose why will with within without would you your
ab aber alle als also am an auch auf aus bei beim bis bleibt blieb da dabei damit dann das dass dem den denn der deren des die dies diese dieser dieses doch dort durch ein eine
einem einen einer eines er es für gegen hat hatte haben ihr ihre im in ins ist ja jede jeder kann kein keine können man mehr mit nach nicht noch nun nur ob oder ohne
schon sehr sein seine sich sie sind so über um und uns unter vom von vor war waren was weil wenn werden wie wieder wir wird wurde wurden zu zum zur zwischen
à afin ainsi après au aussi aux avant avec c car ce ces cet cette chez ci comme d dans de depuis des dès deux donc dont du elle elles en entre est et étaient était être été
eux fait il ils j je jusqu l la le les leur leurs lors lui m mais même moins n ne ni non nos notre nous on ont ou où par pas pendant peu plus pour pourrait qu quand que
quel quelle qui reste s sa sans se selon sera ses si son sont sous sur tous tout très un une vers vos votre vous y a
al algo ante aquí así aún bajo cada como con contra cual cuando cuyo de del desde después donde durante e el ella ellos en entre era eran es esa ese eso esta estaba estas
este esto está están fue fueron ha haber había hacia han hasta hay la las le les lo los más me mediante mientras mucho muy ni no nos nuestro o otra otro para
pero poco por porque pues que qué quien se según ser será si sido sin sobre son su sus también tan tanto tiene todo todos tras tu un una unas unos y ya
""".split())
#: What a page is read as: links, words, marks of lists, ends of sentences, line ends. A word may begin an address.
TOKEN = re.compile(r"https?://\S+|\]\([^)\s]*\)|[^\W_]+(?:[.\w-]*\.[\w-]+/\S*)?|[.!?][\"'”’»)\]]*(?=\s+[^\Wa-z]|\s*$)|\n+|[|#,;•·>»_-]|/(?=\s)|:(?=\S)")
WORDS, LINKS, MARKS, ENDS, BREAKS = range(5)
#: A repeated run counts from so many words and characters.
RUN_WORDS, RUN_CHARS = 2, 6


class Automaton:
    """A suffix automaton over several rows of symbols at once; each row ends with a mark of its own.

    A state stands for the runs that end at the same places; its longest one can't be made longer to the left.
    """

    def __init__(self, rows: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.ends: list[list[int]] = []  # for each row the state of each of its beginnings
        mark, last = -1, 0
        for row in rows:
            at = []
            for symbol in row:
                last = self._add(last, symbol)
                at.append(last)
            self.ends.append(at)
            last = self._add(last, mark)
            mark -= 1
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        for s in order[:0:-1]:
            self.count[self.link[s]] += self.count[s]
        #: The longest maximal repeated run, of RUN_WORDS or more, that is a suffix of the state's runs.
        self.run = [0] * len(order)
        for s in order[1:]:
            maximal = self.count[s] > 1 and len(self.next[s]) > 1 and self.length[s] >= RUN_WORDS
            self.run[s] = self.length[s] if maximal else self.run[self.link[s]]

    def _add(self, last: int, symbol: int) -> int:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        count.append(1)
        p = last
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                count.append(0)
                while p >= 0 and nxt[p].get(symbol) == q:
                    nxt[p][symbol] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        return cur


def covered(symbols: np.ndarray, sizes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Which symbols lie in a maximal repeated run of their page. sizes: characters; firsts: where the pages begin.

    Symbols in no pair of neighbours that their page has twice can't lie in such a run; the others are the rows of the
    page's automaton.
    """
    n = len(symbols)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    page = np.zeros(n, np.int64)
    page[firsts[firsts < n]] = 1
    page = np.cumsum(page) - 1
    # a pair's page and symbols as one number: exact while pages times symbols squared stay below 2^64
    k = int(symbols.max()) + 1
    pair = (page[:-1] * k + symbols[:-1]) * k + symbols[1:]
    own = page[:-1] == page[1:]
    _, where, times = np.unique(pair, return_inverse=True, return_counts=True)
    twice = own & (times[where] > 1)
    near = np.concatenate([twice, [False]]) | np.concatenate([[False], twice])
    joined = np.concatenate([[False], twice])  # goes on from the symbol before
    at = np.flatnonzero(near)
    if not len(at):
        return out
    starts = at[~joined[at]]
    stops = np.append(starts[1:], n)
    ends = at[np.searchsorted(at, stops) - 1] + 1
    chars = np.concatenate([[0], np.cumsum(sizes)])
    depth = np.zeros(n + 1, np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], page[starts[1:]] != page[starts[:-1]], [True]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        spans = list(zip(starts[a:b].tolist(), ends[a:b].tolist()))
        automaton = Automaton([symbols[x:y].tolist() for x, y in spans])
        run = automaton.run
        length = np.array([run[s] for row in automaton.ends for s in row], np.int64)
        stop = np.concatenate([np.arange(x, y) for x, y in spans]) + 1
        ok = (length > 0) & (chars[stop] - chars[stop - length] >= RUN_CHARS)
        np.add.at(depth, stop[ok] - length[ok], 1)
        np.add.at(depth, stop[ok], -1)
    return np.cumsum(depth[:-1]) > 0


def _kind(token: str) -> int:
    first = token[0]
    if first == "\n":
        return BREAKS
    if first in ".!?":
        return ENDS
    if first.isalnum():
        return LINKS if "/" in token or "." in token else WORDS
    return LINKS if first == "]" else MARKS


def stuffing_of(words: np.ndarray, held: np.ndarray, linked: np.ndarray, marks: np.ndarray, ended: np.ndarray, coverage: np.ndarray, page: np.ndarray) -> np.ndarray:
    """How many words of each sentence or line are stuffing.

    words: their number; held: function words; linked: words in links; marks: marks of lists; ended: whether it ends with
    a mark; coverage: the share of its characters in maximal repeated runs; page: its page. A sentence or line of prose
    has a share of function words above a limit that rises with coverage, with marks of lists and where no mark ends it.
    Without function words a long line is stuffing only where repeated runs or marks of lists show it to be no title or
    address; one of less than eight words may be a short sentence or a heading, unless it has marks of lists, three such
    lines stand together, most of the page are such or repeated runs cover most of it. A link's own words are no prose; what stands around it may be.
    """
    n = np.maximum(words, 1)
    clause, lists = held / n, np.clip((marks - ended) / (0.3 * n), 0, 1)
    limit = 0.06 + np.where(ended, 0.04, 0.1) * coverage + 0.16 * lists + np.where(ended, 0.0, 0.06)
    bare = (words > 0) & (clause < limit)
    repeated = (coverage > 0.5) & (words > 1)
    entry = bare & (words < 8) & (held == 0) & ~ended
    # how many entries stand together
    edge = np.ones(len(words), bool)
    edge[1:] = (page[1:] != page[:-1]) | (entry[1:] != entry[:-1])
    group = np.cumsum(edge) - 1
    together = np.bincount(group, weights=words > 0)[group] if len(words) else np.zeros(0)
    short = np.where(ended, repeated, repeated | (marks > 0) | entry & (together >= 3))
    # a page at least half of whose sentences have few words each is a list of entries that end like sentences
    few = ended & (words > 0) & (words <= 5) & (clause < 0.35)
    of_page = lambda w: np.bincount(page, weights=w)[page] if len(page) else w
    dense = few & (of_page(few) >= 3) & (2 * of_page(few) >= of_page(words > 0))
    long = (words >= 8) & (coverage + lists > 0.2)
    plain = np.where(dense | bare & (long | short & (words < 8)), words, 0)
    rest = words - np.minimum(words, linked)
    return np.where(linked > 0, np.where((rest < 4) | (clause < 0.15), words, np.minimum(words, linked)), plain)


def profiles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: words, share of the characters of words in maximal repeated runs, share of the words that are stuffing."""
    found = [TOKEN.findall(t) for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    total = int(counts.sum())
    flat = np.empty(total, object)
    at = 0
    for x in found:
        flat[at : at + len(x)] = x
        at += len(x)
    codes, distinct = pd.factorize(flat)
    low, distinct = pd.factorize(np.array([t.lower() for t in distinct], object))  # ends are told by the case of what follows
    codes = low[codes]
    of = lambda f, kind: np.fromiter(map(f, distinct), kind, len(distinct))
    kinds = of(_kind, np.int8)
    n_words = np.where(kinds == LINKS, of(lambda t: len(WORD.findall(t)) if len(t) > 1 else 0, np.int64), kinds == WORDS)
    held = of(FUNCTION_WORDS.__contains__, bool)
    sizes = of(len, np.int64)
    # symbols of the automaton: numbers are one, links another
    symbol = np.where(kinds == LINKS, len(distinct), np.where(of(str.isdigit, bool), len(distinct) + 1, np.arange(len(distinct))))
    page = np.repeat(np.arange(len(texts)), counts)
    kind, words = kinds[codes], n_words[codes]
    used = kind <= LINKS
    runs = np.zeros(total, bool)
    firsts = np.concatenate([[0], np.cumsum(np.bincount(page[used], minlength=len(texts)))[:-1]]) if len(texts) else np.zeros(0, np.int64)
    runs[used] = covered(symbol[codes][used], sizes[codes][used], firsts)
    # sentences and lines: a token is of the next one if an end or a break stands before it
    close = np.isin(kind, (ENDS, BREAKS))
    begins = np.zeros(total, bool)
    begins[1:] = close[:-1] | (page[1:] != page[:-1])
    part = np.cumsum(begins)
    m = int(part[-1]) + 1 if total else 0
    add = lambda w: np.bincount(part, weights=w, minlength=m)
    chars = np.where(used, sizes[codes], 0)
    in_part = add(words)
    stuffing = stuffing_of(
        in_part, add(held[codes]), add(np.where(kind == LINKS, words, 0)), add(kind == MARKS), add(kind == ENDS) > 0,
        add(chars * runs) / np.maximum(add(chars), 1), page[np.flatnonzero(np.diff(part, prepend=-1))] if total else page,
    )
    by_page = lambda w: np.bincount(page, weights=w, minlength=len(texts))
    all_words = by_page(words)
    of_page = page[np.flatnonzero(np.diff(part, prepend=-1))] if total else page
    bad = np.bincount(of_page, weights=stuffing, minlength=len(texts)) if total else np.zeros(len(texts))
    return all_words.astype(np.int64), by_page(chars * runs) / np.maximum(by_page(chars), 1), bad / np.maximum(all_words, 1)


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        texts = d.pop("_text").tolist()
        for a, b in by_size(texts):
            n, coverage, stuffing = profiles(texts[a:b])
            yield d.iloc[a:b].assign(n_words=n, coverage=coverage, stuffing=stuffing)


def page_profiles(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_words, coverage, stuffing of every text with a word.

    Null, blank and wordless texts give no rows; repeated rows are repeated. Whole texts are read.
    """
    t = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("length(_text) > 0")
    out = t.mapInPandas(_profiles, f"_key {dict(t.dtypes)['_key']}, n_words bigint, coverage double, stuffing double")
    return out.where("n_words > 0").withColumnRenamed("_key", key)


def stuffed(df: DataFrame, key: str, text: str, most: float = 0.5) -> DataFrame:
    """page_profiles of the pages most of whose words stand in lists, links or repeated keywords.

    Repeated runs over most of a page lower the share that is needed by a fifth.
    """
    p = page_profiles(df, key, text)
    return p.where(F.col("stuffing") > F.when(F.col("coverage") > 0.5, most * 0.8).otherwise(most))
