"""Models behind an interface, with stand-ins that need no network and always answer the same.

A provider is sent to each Python worker and given batches. No call is made for a null; a batch on which a provider fails
is tried again row by row, and a row on which it fails gets null, so that one bad row or a service that is down stops no
job. What a null means is for the caller: guards let a message pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Chat(Protocol):
    def answer(self, prompts: list[str]) -> list[str]: ...


class HashedWords:
    """A bag of words hashed into `size` signed places and scaled to length 1; zeros for a text without words."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for k, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[k, h % self.size] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


class EchoChat:
    """Says how long the prompt is."""

    def answer(self, prompts: list[str]) -> list[str]:
        return [f"({len(p or '')} characters read)" for p in prompts]


class Moderator(Protocol):
    def flagged(self, texts: list[str]) -> list[bool]: ...


class Vision(Protocol):
    def read(self, images: list[bytes], prompt: str) -> list[str]: ...


class WordModerator:
    """Flags texts that contain one of some words."""

    def __init__(self, words: list[str]):
        self.words = [w.lower() for w in words]

    def flagged(self, texts: list[str]) -> list[bool]:
        return [any(w in t.lower() for w in self.words) for t in texts]


class PatternChat:
    """Answers YES where one of some patterns is found in what stands between the prompt's last quotes, else NO."""

    def __init__(self, patterns: list[str]):
        self.pattern = "|".join(patterns)

    def answer(self, prompts: list[str]) -> list[str]:
        return ["YES" if re.search(self.pattern, p[p.find('"') + 1 : p.rfind('"')]) else "NO" for p in prompts]


class SizeVision:
    """Says how large the image is."""

    def read(self, images: list[bytes], prompt: str) -> list[str]:
        return [f"FIGURE: {len(x) % 10}\nCAPTION: An image of {len(x)} bytes\nDESCRIPTION: none" for x in images]


def called(values: list, call: Callable[[list], Sequence]) -> list:
    """The results of a call for the values that aren't null; null where it fails."""
    at = [k for k, v in enumerate(values) if v is not None]
    out: list = [None] * len(values)
    if not at:
        return out
    try:
        got = list(call([values[k] for k in at]))
        if len(got) != len(at):
            raise ValueError("a provider must answer each row")
    except Exception:  # noqa: BLE001
        got = []
        for k in at:
            try:
                got.append(list(call([values[k]]))[0])
            except Exception:  # noqa: BLE001
                got.append(None)
    for k, g in zip(at, got):
        out[k] = g
    return out


def _column(df: DataFrame, of: str, call: Callable[[list], Sequence], column: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(called([None if v is None else v for v in s.tolist()], call), dtype=object)

    return df.withColumn(column, F.pandas_udf(run, kind)(of))


def embedded(df: DataFrame, text: str, embedder: Embedder, column: str = "embedding") -> DataFrame:
    """df with the vectors of a text; null where there is no text or the embedder fails."""
    return _column(df, text, embedder.embed, column, "array<float>")


def answered(df: DataFrame, prompt: str, chat: Chat, column: str = "answer") -> DataFrame:
    """df with a model's answer; null where there is no prompt or the model fails."""
    return _column(df, prompt, chat.answer, column, "string")


def moderated(df: DataFrame, text: str, moderator: Moderator, column: str = "flagged") -> DataFrame:
    """df with whether a text is flagged; null where there is no text or the moderator fails."""
    return _column(df, text, moderator.flagged, column, "boolean")


def seen(df: DataFrame, image: str, vision: Vision, prompt: str, column: str = "reply") -> DataFrame:
    """df with what a vision model reads in an image; null where there is none or the model fails."""
    return _column(df, image, lambda x: vision.read(x, prompt), column, "string")


def expanded(df: DataFrame, query: str, chat: Chat, most_words: int = 3) -> DataFrame:
    """Queries of few words with a sentence of the model appended; only these are sent to it. Failures leave them be."""
    from quirework.functions import text as T

    asked = F.when(T.word_count(F.col(query)) <= most_words, F.col(query))
    said = answered(df.withColumn("_asked", asked), "_asked", chat, "_said")
    return said.withColumn(query, F.when(F.col("_said").isNull(), F.col(query)).otherwise(F.concat_ws(" ", query, "_said"))).drop("_asked", "_said")
