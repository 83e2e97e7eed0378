"""Length units: characters, and tokens of a WordPiece vocabulary, as prefix sums over a text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfathom.schemas import WHITE

WORD_START = "▁"
#: Characters that are words of their own.
PUNCTUATION = [(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E), (0xA1, 0xA1), (0xA7, 0xA7), (0xAB, 0xAB), (0xB6, 0xB7), (0xBB, 0xBB), (0xBF, 0xBF), (0x2010, 0x2027), (0x2030, 0x205E), (0x3000, 0x303F)]
CJK = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0x2F800, 0x2FA1F)]


class Measure:
    """cum[i]: units before character i."""

    def __init__(self, cum):
        self.cum = np.asarray(cum)

    def length(self, a: int, b: int) -> int:
        return int(self.cum[b] - self.cum[a])

    def advance(self, start, n: int):
        """The furthest place with at most n units from start, or from each of an array of places."""
        return np.maximum(start, np.searchsorted(self.cum, self.cum[start] + n, side="right") - 1)

    def retreat(self, end, n: int):
        """The first place with at most n units up to end, or up to each of an array of places."""
        return np.minimum(end, np.searchsorted(self.cum, self.cum[end] - n, side="left"))


class Chars:
    name = "chars"

    def measure(self, text: str) -> Measure:
        return Measure(np.arange(len(text) + 1))

    def count(self, text: str) -> int:
        return len(text)


def _set(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)


_SPACES, _RUNS = re.compile(f"[{WHITE}]+"), re.compile(f"[^{WHITE}]+")
_ALONE = re.compile(f"[{_set(PUNCTUATION + CJK)}]")
_PARTS = re.compile(f"[{_set(PUNCTUATION + CJK)}]|[^{_set(PUNCTUATION + CJK)}]+")


@cache
def _letter(char: str) -> str:
    """What a character is in a word: decomposed, without marks and control characters, in lower case where it is no word of its own."""
    kept = (c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c)[0] != "M" and unicodedata.category(c) != "Cc" and c != "\ufffd")
    return "".join(c if _ALONE.match(c) else c.lower() for c in kept)


class WordPiece:
    """Greedy longest match over lower-case words without accents; a word with a part that no piece fits is one token."""

    name = "tokens"

    def __init__(self, pieces: list[str]):
        if not pieces:
            raise ValueError("the vocabulary is empty")
        if any(p.startswith("##") for p in pieces):
            pieces = [p[2:] if p.startswith("##") else p if p.startswith("[") and p.endswith("]") else WORD_START + p for p in pieces]
        self.pieces = frozenset(pieces)
        self.longest = max(map(len, pieces))
        self.known: dict[str, tuple[list[int], int]] = {}

    def words(self, text: str) -> Iterator[tuple[int, str]]:
        """Place of the first character and letters of each word."""
        for run in _RUNS.finditer(text):
            for at, word in self._split(run[0]):
                yield run.start() + at, word

    @staticmethod
    def _split(run: str) -> list[tuple[int, str]]:
        """Words of a run without white space: what stands between punctuation and ideographs, and each of those."""
        if run.isascii() and run.isalnum():
            return [(0, run.lower())]
        made = [_letter(c) for c in run]
        place = [i for i, m in enumerate(made) for _ in m]
        return [(place[m.start()], m[0]) for m in _PARTS.finditer("".join(made))]

    def _tokens(self, run: str) -> tuple[list[int], int]:
        """Places of the words of a run, one for each token, and their number; kept for runs that come again."""
        if (known := self.known.get(run)) is None:
            places = [at for at, word in self._split(run) for _ in range(self.word_tokens(word))]
            known = places, len(places)
            if len(self.known) >= 200_000:
                self.known.clear()
            if len(run) <= 64:
                self.known[run] = known
        return known

    def word_tokens(self, word: str) -> int:
        """The longest piece that fits comes first, again and again; one token where at some place none fits."""
        rest, n = WORD_START + word, 0
        at = 0
        while at < len(rest):
            size = next((k for k in range(min(self.longest, len(rest) - at), 0, -1) if rest[at : at + k] in self.pieces), 0)
            if not size:
                return 1
            at, n = at + size, n + 1
        return n

    def count(self, text: str) -> int:
        return sum(self._tokens(run)[1] for run in _SPACES.split(text) if run)

    def measure(self, text: str) -> Measure:
        cum = np.zeros(len(text) + 1, np.int64)
        for run in _RUNS.finditer(text):
            places, n = self._tokens(run[0])
            if n:
                np.add.at(cum, np.array(places) + run.start() + 1, 1)
        return Measure(np.cumsum(cum))


def token_count(text: Column, pieces: list[str]) -> Column:
    """Tokens of a text, special ones not counted."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        units = WordPiece(pieces)
        for batch in batches:
            yield batch.map(units.count, na_action="ignore").astype("Int64")

    return F.pandas_udf(count, "long")(text)


def check_budget(units, sizes: list[int], prefix: str, num_ctx: int) -> None:
    """Token units only: the largest chunk with its prefix and two special tokens fits the model's context."""
    if units.name == "tokens" and (need := max(sizes) + units.count(prefix) + 2) > num_ctx:
        raise ValueError(f"chunks of up to {need} tokens do not fit a context of {num_ctx}")
