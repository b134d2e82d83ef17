"""Words by the shapes of their letters."""

from __future__ import annotations

#: Glyphs that scanners take for each other, drawn with the same strokes (| is one upright).
STROKES = str.maketrans({
    "i": "|", "l": "|", "1": "|", "r": "|", "t": "|", "f": "|", "j": "|", "ı": "|", "!": "|", "ﬁ": "||", "ﬂ": "||",
    "n": "||", "u": "||", "m": "|||",
    "h": "b", "8": "b", "6": "b",
    "e": "c", "d": "c|", "ɑ": "a", "α": "a", "0": "o", "ο": "o", "5": "s", "9": "g", "q": "g", "w": "vv", "2": "z",
})


def skeleton(word: str) -> str:
    """The same for words that differ only by glyphs a scanner confuses, as modern and modem, close and dose."""
    return word.lower().translate(STROKES)


#: What a scanner reads for what.
READS = [
    ("m", "rn"), ("m", "in"), ("m", "nn"), ("n", "ri"), ("n", "ii"), ("u", "ii"), ("u", "n"), ("d", "cl"), ("w", "vv"), ("h", "b"), ("h", "li"), ("b", "6"), ("b", "8"), ("e", "c"), ("c", "o"), ("t", "f"), ("t", "l"), ("t", "i"), ("f", "l"), ("r", "t"), ("i", "l"), ("i", "1"), ("l", "1"), ("i", "j"), ("i", "ı"), ("a", "ɑ"), ("a", "α"), ("o", "0"), ("o", "ο"), ("s", "5"), ("g", "9"), ("g", "q"), ("q", "9"), ("z", "2"), ("fi", "ﬁ"), ("fl", "ﬂ"),
]
PAIRS = {(a, b) for x, y in READS for a, b in ((x, y), (y, x))}


def misreadings(seen: str, meant: str) -> int | None:
    """The least number of misreadings that turn meant into seen; None if they don't."""
    best = {(0, 0): 0}
    for i in range(len(meant) + 1):
        for j in range(len(seen) + 1):
            n = best.get((i, j))
            if n is None:
                continue
            if i < len(meant) and j < len(seen) and meant[i] == seen[j]:
                best[i + 1, j + 1] = min(n, best.get((i + 1, j + 1), n))
            for a in (1, 2):
                for b in (1, 2):
                    if (meant[i : i + a], seen[j : j + b]) in PAIRS:
                        best[i + a, j + b] = min(n + 1, best.get((i + a, j + b), n + 1))
    return best.get((len(meant), len(seen)))
