"""Problem 1: values that stop before their end because an intake cut them.

A stack automaton reads a value's delimiters and tells whether it ends with something open: a bracket, a quote, markup,
an escape, a broken multibyte sequence. A value that ends so, or lacks a terminator, is a suspect. For a suspect
without such proof the missing terminator is judged against two baselines, both counted over all values: how often its
last words are followed by a sentence end elsewhere, and how often its source's values of that field are cut at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import name2codepoint

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import NUMBER, PAGE, bits_for, bits_of, by_size, in_bits, mix, written
from quirework.llm.confusable import skeleton

OMISSION = re.compile(r"(?:\s|…|\.{3,}|\[(?:…|\.{3,})\])+$")
#: A value ends well with one of these, perhaps within closing quotes or brackets.
ENDED = re.compile(r"[.!?。！？][\"'”’»)\]}]*$")
OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“"}
DELIMITERS = re.compile(r"[()\[\]{}“”«»„\"]|</?[A-Za-z][^<>]*>|<(?:/?[A-Za-z][^<>]*)?$|[.!?](?=\s+[^\W\d_a-z])|\n\s*\n")
DANGLING = re.compile(r"(?:\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?|&(?:#x?[0-9A-Fa-f]{0,6}|[A-Za-z0-9]{2,8})|(?<=%[0-9A-Fa-f]{2})%[0-9A-Fa-f]?|�+|[\ud800-\udbff])$")
#: What an escape of a named character may be cut to; one letter after & is rather an abbreviation (R&D).
NAMED = {name[:k] for name in name2codepoint for k in range(2, len(name) + 1)}
OPENERS = "([{“«„\"<"
CLOSERS = ")]}”»\"'’"
_ANY = r"[^()\[\]{}“”«»„]*"
#: What needs a look at a value that ends well: broken bytes, markup, and an opening delimiter whose next delimiter
#: isn't its own closing one (Java's syntax; one class first, so that other characters are passed over quickly).
DOUBTFUL = r"[(\[{“«„<\x{FFFD}](?:" + "|".join(rf"(?<={a})(?!{_ANY}{b})" for a, b in [(r"\(", r"\)"), (r"\[", r"\]"), (r"\{", r"\}"), "“”", "«»", "„“"]) + r"|(?<=<)(?=/?[A-Za-z])|(?<=\x{FFFD}))"
#: A last line that may be a page number.
FOOT = r"\n[^\n]*\d[^\n\p{L}]*$"
VOID = {"br", "hr", "img", "input", "meta", "link"}
TOKEN = re.compile(r"[^\W_]+(?:[-'’./_][^\W_]+)*%?|[.!?;]+(?=\s|$)|[^\w\s]")
CODE = re.compile(r"[A-Z]{2,}[A-Z0-9]*\d+[A-Z0-9]*(?:-[a-z]+)?$")
#: A word broken over two lines.
BROKEN = re.compile(r"(?<=[^\W\d_])[-\xad¬][ \t]*\r?\n[ \t]*(?=[a-z])")
#: Contexts of a last word: (tokens, how they are told apart), the first with enough support counts. 0: letter by letter;
#: 1: long words by their last letters; 2: long words not at all.
CONTEXTS = [(6, 2), (4, 1), (3, 0), (3, 1), (2, 0), (2, 1), (1, 0)]


def left_open(text: str) -> str | None:
    """What the automaton finds open at the end of text: bracket, quote, markup, escape, bytes; None if nothing.

    Brackets and quotes are forgotten at a sentence end before a capital and at a blank line, so that one odd bracket
    in a long text is no proof; markup elements are kept on the stack to the end.
    """
    if (m := DANGLING.search(text)) and not (m[0][0] == "&" and m[0][1:2] != "#" and m[0][1:] not in NAMED):
        return "bytes" if "�" in m[0] or m[0] >= "\ud800" else "escape"
    if not any(c in text for c in OPENERS):
        return None
    stack: list[str] = []
    for m in DELIMITERS.finditer(text):
        s = m[0]
        if s[0] == "<":
            if not s.endswith(">"):
                if len(s) > 1:
                    return "markup"
                continue
            name = re.match(r"</?([A-Za-z0-9]+)", s)[1].lower()
            if s[1] == "/":
                if name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(name) :]
            elif name not in VOID and not s.endswith("/>"):
                stack.append(name)
        elif s == '"':
            stack.pop() if stack and stack[-1] == '"' else stack.append('"')
        elif stack and s == stack[-1]:
            stack.pop()
        elif s in OPEN:
            stack.append(OPEN[s])
        elif s[0] in ".!?\n":
            stack = [x for x in stack if x[0].isalpha()]
    if not stack:
        return None
    return "markup" if stack[-1][0].isalpha() else "quote" if stack[-1] in "”»“\"" else "bracket"


def _literal(token: str) -> str:
    """A number as 0, a code as #, a long word by its letters' shapes, so that a misread one counts as itself."""
    if token[0].isdigit() and token.rstrip("%").replace(".", "").isdigit():
        return "0"
    return "#" if CODE.match(token) else skeleton(token) if len(token) > 5 else token.lower()


def _class(token: str, ending: int = 3) -> str:
    return "~" + token[len(token) - ending :].lower() if len(token) >= 9 and token.isalpha() else _literal(token)


def _hashes(tokens: np.ndarray) -> list[np.ndarray]:
    """Hashes of the tokens by each way of telling them apart; never 0, which stands for no token."""
    of = lambda f: pd.util.hash_array(np.array([f(t) for t in tokens], object), categorize=False) | np.uint64(1)
    return [of(_literal), of(_class), of(lambda t: _class(t, 0))] if len(tokens) else [np.empty(0, np.uint64)] * 3


def _contexts(before: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Hashes of each of CONTEXTS. before: for each way the hashes of the last tokens, the nearest first; 0 for none."""
    done: dict[tuple[int, int], np.ndarray] = {}
    with np.errstate(over="ignore"):
        for way, parts in enumerate(before):
            out = np.full(len(parts[0]), np.uint64(way + 1), np.uint64)
            for n, part in enumerate(parts, 1):
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
                done[n, way] = out + np.uint64(n)
    return [done[c] for c in CONTEXTS]


#: Of each way, the tokens its longest context has.
LONGEST = [max(n for n, way in CONTEXTS if way == w) for w in range(3)]


def _last_tokens(body: str) -> list[str]:
    """The last tokens of a value, as many as a context may have, two more and a broken word; read from as far back as they lie."""
    size = 200
    while True:
        tail = BROKEN.sub("", body[-size:])
        tokens = TOKEN.findall(tail[tail.find(" ") + 1 :] if len(body) > size else tail)
        if len(tokens) > max(LONGEST) + 1 or size >= len(body):
            return tokens[-max(LONGEST) - 2 :]
        size *= 4


def _body(value: str) -> tuple[str, str]:
    """A value without a page number that stands after its text, and that without marks of omission at the end."""
    body = OMISSION.sub("", value) if value[-1] in " \t\r\n\f\v…]." or value[-1].isspace() else value
    if "\n" in body and PAGE.match(line := body.rsplit("\n", 1)[1]) and not NUMBER.match(line):
        value = body = OMISSION.sub("", body.rsplit("\n", 1)[0])
    return value, body


def _running(value: str) -> str:
    """What of a value is counted: without marks of omission at its end and lines that are a page's name and number, broken
    words joined. Else parts of words that are cut or broken would count as words, and before `...` or as `p. 12` as ones
    that end sentences; the larger the table, the more of them would be frequent."""
    body = _body(value)[1]
    if "\n" not in body:
        return body
    return BROKEN.sub("", "\n".join(x for x in body.split("\n") if not PAGE.match(x) or x.lower() == x.upper()))


def _suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        rows, ends = [], []
        for value, body in map(_body, d.pop("_value")):
            omitted = bool(body) and value[len(body) :].strip() != ""
            proof = left_open(body) if body else None
            tokens = _last_tokens(body)
            if not body:
                verdict, proof = "complete", "blank"
            elif proof:
                verdict = "open" if proof == "escape" and "&" in body[-10:] else "cut"
            elif ENDED.search(body) and not (len(tokens) > 1 and tokens[-1] == "." and tokens[-2].isdigit()):
                verdict, proof = ("complete", "terminator") if not omitted else ("open", "omission")
            elif body[-1] in CLOSERS:
                verdict, proof = "open", "omission" if omitted else "closed"
            elif re.search(r"[^\W_]%?$|\.$", body) is None:
                verdict, proof = "cut", "punctuation"
            else:
                verdict, proof = "open", "omission" if omitted else "terminator missing"
            if len(tokens) > 1 and tokens[-1] == ".":
                tokens = tokens[:-1]
            ends.append(tokens)
            line = re.sub(r"\d", "0", body.rsplit("\n", 1)[-1]).strip() if "\n" in body or proof == "closed" else ""
            # 1: a last word of one or two letters; 2: a capital, which stands for something (R&D, group A)
            brief = 0 if not tokens or len(tokens[-1]) > 2 or not tokens[-1].isalpha() else 1 + (len(tokens[-1]) == 1 and tokens[-1].isupper())
            rows.append((verdict, proof, omitted, len(value), line if 0 < len(line) < 60 else None, brief))
        if not rows:
            yield pd.DataFrame()
            continue
        last = [[x[-k] if len(x) >= k else "" for x in ends] for k in range(1, max(LONGEST) + 1)]
        codes, distinct = pd.factorize(np.array([t for x in last for t in x], object))
        none = distinct == ""
        hashes = [np.where(none, np.uint64(0), h)[codes].reshape(len(last), -1) for h in _hashes(np.array([t or "_" for t in distinct], object))]
        ctx = np.stack(_contexts([list(h[:n]) for h, n in zip(hashes, LONGEST)]), axis=1).view(np.int64)
        out = d.assign(**dict(zip(["verdict", "proof", "omitted", "n_chars", "line", "brief"], zip(*rows))))
        yield out.assign(ctx=[c if x else c[:0] for c, x in zip(ctx, ends)])


def _count(batches: Iterator[pd.DataFrame], marks) -> Iterator[pd.DataFrame]:
    for d in (b.iloc[x:y] for b in batches for x, y in by_size(list(b["_value"]))):
        lists = [TOKEN.findall(_running(t)) for t in d["_value"]]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.empty(int(counts.sum()), object)
        at = 0
        for x in lists:
            flat[at : at + len(x)] = x
            at += len(x)
        if not at:
            continue
        codes, distinct = pd.factorize(flat)
        hashes = _hashes(distinct)
        stop = np.fromiter((t[0] in ".!?;" for t in distinct), bool, len(distinct))[codes]
        word = np.fromiter((t[0].isalnum() or t in CLOSERS for t in distinct), bool, len(distinct))[codes]
        last = np.zeros(at, bool)
        last[np.cumsum(counts)[counts > 0] - 1] = True
        ended = np.concatenate([stop[1:], [False]]) & ~last
        use = np.flatnonzero(word & ~last)  # what follows the last token of an unterminated value is unknown
        # tokens before a value's first one are none
        place = use - np.repeat(np.cumsum(counts) - counts, counts)[use]
        before = [[np.where(place >= k, h[codes[np.maximum(use - k, 0)]], np.uint64(0)) for k in range(n)] for h, n in zip(hashes, LONGEST)]
        text = np.uint64(1) << (pd.util.hash_array(d["_value"].to_numpy(object), categorize=False) >> np.uint64(58))
        done, texts, out = ended[use].astype(np.int64), np.repeat(text, counts)[use], []
        for h in _contexts(before):
            known = np.flatnonzero(in_bits(h, marks.value))
            if len(known):
                known = known[np.argsort(h[known], kind="stable")]
                at = np.flatnonzero(np.concatenate([[True], np.diff(h[known]) != 0]))
                n = np.diff(np.concatenate([at, [len(known)]]))
                out.append(pd.DataFrame({"h": h[known[at]].view(np.int64), "ended": np.add.reduceat(done[known], at), "n": n, "texts": np.bitwise_or.reduceat(texts[known], at).view(np.int64)}))
        if out:
            yield pd.concat(out)


def _distinct(texts: Column, n: Column) -> Column:
    """About how many different texts n places lie in, told by the bits (of 64) that these set; n where all are set."""
    unset = 64 - F.bit_count(texts)
    return F.when(unset == 0, n).otherwise(F.least(n, -64 * F.log(unset / 64.0)))


def judged(df: DataFrame, key: str, source: str, fields: list[str], support: int = 5) -> DataFrame:
    """The suspects among the fields' values: key, source, field, verdict (cut or complete), proof, p_end.

    A value that is null or blank is none; so is one with a terminator and nothing open. Repeated rows are repeated in
    the result. A null source is a source. A tie of the odds counts as complete. Tables without values give no rows.
    """
    spark = df.sparkSession
    values = df.select(
        F.col(key).alias("_key"), F.col(source).alias("_source"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("_value")) for f in fields))).alias("_v"),
    ).select("_key", "_source", "_v.field", "_v._value").where("length(_value) > 0")
    # a stop after a stop or a digit may be a mark of omission or a number's point
    ended = r"(?<![.\d])[.!?。！？][\"'”’»)\]}]*\s*$"
    v = F.col("_value")
    well = v.rlike(ended) & ~v.contains('"') & ~v.rlike(DOUBTFUL) & ~(v.contains("\n") & v.rlike(FOOT))
    kinds = {f.name: f.dataType.simpleString() for f in values.schema}
    own = f"_key {kinds['_key']}, _source {kinds['_source']}, field string"
    seen = written(
        values.where(~well).mapInPandas(_suspects, f"{own}, verdict string, proof string, omitted boolean, n_chars bigint, line string, brief int, ctx array<bigint>"),
        "suspects",
    )
    open_ = seen.where("verdict = 'open'")
    asked = open_.select(F.explode("ctx").alias("h"))
    # a bitmap sized by the suspects' contexts; where they are very many, more of the corpus's contexts pass it, which are
    # summed up before they are shuffled
    shared = spark.sparkContext.broadcast(bits_of(asked, "h", bits_for(len(CONTEXTS) * open_.count())))
    counts = values.select("_value").mapInPandas(lambda it: _count(it, shared), "h bigint, ended bigint, n bigint, texts bigint")
    counts = counts.groupBy("h").agg(F.sum("ended").alias("ended"), F.sum("n").alias("n"), F.bit_or("texts").alias("texts"))
    # copies of a text tell no more than the text: a context's places count as the different texts they lie in
    counts = counts.withColumn("_of", _distinct(F.col("texts"), F.col("n"))).select("h", (F.col("ended") / F.col("n") * F.col("_of")).alias("ended"), F.col("_of").alias("n"))

    # how often a suspect's last line is a whole line of its own: list entries, counts, identifiers
    n_values = F.broadcast(values.groupBy("field").agg(F.count("*").alias("_values")))
    lines = open_.where("line is not null").groupBy("line").agg(F.count("*").alias("_same"))

    o = open_.withColumn("_id", F.xxhash64("_key", "_source", "field", "n_chars", "ctx"))
    each = o.select("_id", "brief", F.posexplode("ctx").alias("place", "h")).distinct()
    alone = F.col("place") == len(CONTEXTS) - 1
    best = (
        each.join(counts, "h", "left")
        .na.fill(0.0, ["ended", "n"])
        .groupBy("_id")
        .agg(
            F.min(F.when(F.col("n") >= support, F.struct("place", "ended", "n"))).alias("b"),
            F.max(F.when(alone & (F.col("n") > 0), F.struct("ended", "n"))).alias("rare"),
            F.max(F.when(alone, F.col("n"))).alias("known"),
            F.first("brief").alias("brief"),
        )
        # without support the last word alone counts, but only against an end: few places prove none
        .withColumn("p_end", F.coalesce((F.col("b.ended") + 0.02) / (F.col("b.n") + 1.0), F.least((F.col("rare.ended") + 0.02) / (F.col("rare.n") + 1.0), F.lit(0.02))))
        .withColumn("alone", (F.col("b.place") == len(CONTEXTS) - 1) & (F.col("brief") > 0))
        # one or two letters alone are no sign of an end: they may be the beginning of any word; a capital alone is none at all
        .select("_id", F.when(F.col("alone"), F.when(F.col("brief") == 1, F.least("p_end", F.lit(0.02)))).otherwise(F.col("p_end")).alias("p_end"), "known")
    )
    o = o.join(best, "_id", "left").join(lines, "line", "left").join(n_values, "field")
    o = o.withColumn("_whole_line", F.coalesce(F.col("_same") >= F.greatest(F.lit(3.0), F.col("_values") * 1e-4), F.lit(False)))
    certain = F.when(F.col("_whole_line") & ~F.col("omitted"), "complete").when((F.col("proof") == "closed") & (F.coalesce("known", F.lit(0)) == 0), "complete").when(F.col("omitted") | (F.coalesce("known", F.lit(0)) == 0) & (F.col("brief") < 2), "cut")
    o = o.withColumn("_sure", certain).withColumn("_p", F.coalesce("p_end", F.lit(0.02)))
    # the source's baseline: cut and complete among its open values, first guessed, then by the odds they give; summed
    # up before it is joined to the source's values, since one source may have most of them
    sure = F.when(F.col("_sure") == "cut", 1.0).when(F.col("_sure") == "complete", 0.0)
    # complete phrases often end just behind a bracket or quote or with a capital (group A, R&D), where a cut seldom falls
    phrase = (F.col("proof") == "closed") | (F.col("brief") == 2)
    guess = F.coalesce(sure, F.when((F.col("_p") < 0.1) & ~phrase, 0.9).otherwise(0.2))
    o = written(o, "open")
    for _ in range(2):
        o = o.withColumn("_g", guess)
        base = o.groupBy(F.col("_source").alias("_s"), F.col("field").alias("_f")).agg((F.sum("_g") + 0.5).alias("_cut"), (F.sum(F.when(F.col("_sure").isNull(), 1 - F.col("_g")).otherwise(0)) + 0.5).alias("_done"))
        o = o.drop("_cut", "_done").join(base, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("field") == F.col("_f"))).drop("_s", "_f")
        # a sentence has about 12 words
        odds = F.col("_cut") / F.col("_done") / 12.0 / F.col("_p") * F.when(phrase, 0.1).otherwise(1.0)
        guess = F.coalesce(sure, odds / (1 + odds))
    o = o.withColumn("verdict", F.when(guess > 0.5, "cut").otherwise("complete"))
    rest = seen.where("verdict <> 'open'").withColumn("p_end", F.lit(None).cast("double"))
    cols = [F.col("_key").alias(key), F.col("_source").alias(source), "field", "verdict", "proof", "p_end"]
    return o.select(*cols).unionByName(rest.select(*cols))


def truncated(df: DataFrame, key: str, source: str, fields: list[str], **kw) -> DataFrame:
    """key, source, field, proof of the values that were cut."""
    return judged(df, key, source, fields, **kw).where("verdict = 'cut'").drop("verdict")


def truncation_rates(df: DataFrame, key: str, source: str, fields: list[str], **kw) -> DataFrame:
    """Per source: n_values that are not empty, n_cut of them, rate."""
    some = [F.when(F.length(F.regexp_replace(f, r"\s", "")) > 0, 1).otherwise(0) for f in fields]
    n = df.groupBy(F.col(source).alias(source)).agg(F.sum(sum(some[1:], some[0])).alias("n_values"))
    c = truncated(df, key, source, fields, **kw).groupBy(F.col(source).alias("_s")).agg(F.count("*").alias("n_cut"))
    out = n.join(c, n[source].eqNullSafe(c["_s"]), "left").select(source, "n_values", F.coalesce("n_cut", F.lit(0)).alias("n_cut"))
    return out.withColumn("rate", F.when(F.col("n_values") > 0, F.round(F.col("n_cut") / F.col("n_values"), 6)))
