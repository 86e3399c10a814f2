"""Splitting oversized texts at natural boundaries by balanced targets.

The size of a text is the larger of its UTF-16 units divided by 3.6, rounded up, and its number of words between white
space. For a text over ``maximum`` the least number of pieces of at most ``target`` follows from its size and the
overlap; equally spaced targets are placed, each is snapped to the strongest boundary near it (blank line, line end,
sentence end, clause end, word end, any place between characters) and, where a piece breaks the limit, the number of
pieces grows by one and everything is placed anew. Every piece after the first also begins with about ``overlap``
tokens of the one before it, from the word start nearest to that length. Pieces cover the whole text.

Places are counted in the measure that dominates the text (units or words); if that can't meet the limit because a
text mixes both kinds, in the sum over words of the larger of the two.

Defined cases: null, empty and blank texts are never oversized; a text of just ``maximum`` isn't split; a text without
any boundary is cut between characters, never within a surrogate pair, a CR LF or before a combining mark (only where a
run of marks alone fills a piece is it cut inside); repeated rows of an id are deliveries of one text, of which the latest
counts, be it short or null (of equal times that of the larger hash); null ids are skipped; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.session import ship

UNITS_PER_TOKEN = 3.6
#: Boundaries lie after these matches, from weak to strong.
BOUNDARIES = (
    (1, re.compile(r"\s+")),
    (2, re.compile(r"[,;:][\"')\]]*\s+|[，；：、]\s*")),
    (3, re.compile(r"[.!?]+[\"')\]]*\s+|[。！？]+[”’」』）]*\s*")),
    (4, re.compile(r"\r?\n[^\S\n]*|\r")),
    (5, re.compile(r"(?:\r?\n[^\S\r\n]*){2,}")),
)
WINDOW = 0.25
#: Zero-width joiner and emoji presentation: they and, after a joiner, what follows belong to the character before.
JOINERS = "\u200d\ufe0f"


@dataclass(frozen=True)
class Limits:
    """One chunking profile, in tokens."""

    name: str
    target: int
    maximum: int
    overlap: int


@dataclass(frozen=True)
class Piece:
    """text[start:end] in code points; text[fresh:end] is what the pieces before don't hold."""

    start: int
    fresh: int
    end: int
    tokens: int
    boundary: int


def utf16_units(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def size_of(text: str) -> int:
    return max(math.ceil(utf16_units(text) / UNITS_PER_TOKEN), len(text.split()))


class _Measured:
    """Prefix sums of a text: units, word starts and boundary strengths at every place 0..len(text)."""

    def __init__(self, text: str):
        self.n = n = len(text)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = np.zeros(n, bool)
        for m in re.finditer(r"\s+", text):
            blank[m.start() : m.end()] = True
        self.units = np.zeros(n + 1, np.int32)
        np.cumsum(1 + (codes > 0xFFFF), out=self.units[1:])
        self.word = ~blank
        begins = self.word & np.r_[True, blank[:-1]]
        self.words = np.zeros(n + 1, np.int32)
        np.cumsum(begins, out=self.words[1:])
        self.strength = np.zeros(n + 1, np.int8)
        for level, pattern in BOUNDARIES:
            for m in pattern.finditer(text):
                self.strength[m.end()] = level
        if not text.isascii():
            known, at = np.unique(codes, return_inverse=True)
            marks = np.array([c >= 0x300 and (chr(c) in JOINERS or unicodedata.combining(chr(c)) > 0) for c in known.tolist()])
            inside = marks[at] | np.r_[False, (codes == 0x200D)[:-1]]
            self.strength[:-1][inside] = -1
        for m in re.finditer("\r\n", text):
            self.strength[m.start() + 1] = -1
        self.begins = begins
        #: The last place up to each one that doesn't lie inside a character.
        self.whole = np.maximum.accumulate(np.where(self.strength >= 0, np.arange(n + 1, dtype=np.int32), 0))

    def size(self, s: int, e: int) -> int:
        words = int(self.words[e] - self.words[s])
        if s < e and self.word[s] and not self.begins[s]:
            words += 1  # the piece begins inside a word
        return max(math.ceil(int(self.units[e] - self.units[s]) / UNITS_PER_TOKEN), words)

    def measures(self) -> Iterator[np.ndarray]:
        units = self.units / UNITS_PER_TOKEN
        yield units if units[-1] >= self.words[-1] else self.words.astype(float) + units * 1e-6
        which = np.maximum(self.words[1:] - 1, 0)
        per_word = np.bincount(which, np.diff(units), minlength=int(self.words[-1]) or 1)
        cost = np.maximum(per_word, 1) / np.maximum(per_word, 1e-9)
        yield np.r_[0, np.cumsum(np.diff(units) * cost[which])]


def _whole_character(m: _Measured, at: int, low: int) -> int:
    """Step back to the start of a character with its marks; if they reach back beyond ``low`` it is cut where it is."""
    back = int(m.whole[at])
    return back if back >= low else at


def _snap(m: _Measured, place: np.ndarray, at: float, reach: float, low: int, high: int, least: int = 0) -> int:
    """The strongest, then nearest, place within reach of ``at``, kept within [low, high]."""
    a = max(low, int(np.searchsorted(place, at - reach, side="left")))
    b = min(high, int(np.searchsorted(place, at + reach, side="right")) - 1)
    mid = min(max(int(np.searchsorted(place, at, side="left")), low), high)
    if a > b:
        return mid
    window = m.strength[a : b + 1]
    best = int(window.max())
    if best <= 0 or best < least:
        return _whole_character(m, mid, low)
    options = a + np.flatnonzero(window == best)
    return int(options[np.argmin(np.abs(place[options] - at))])


def _nearest_word(m: _Measured, place: np.ndarray, at: float, reach: float, low: int, high: int) -> int:
    a = max(low, int(np.searchsorted(place, at - reach, side="left")))
    b = min(high, int(np.searchsorted(place, at + reach, side="right")) - 1)
    options = a + np.flatnonzero(m.strength[a : b + 1] > 0) if a <= b else np.empty(0, int)
    if len(options):
        return int(options[np.argmin(np.abs(place[options] - at))])
    mid = min(max(int(np.searchsorted(place, at, side="left")), low), high)
    return _whole_character(m, mid, low)


def _place(m: _Measured, place: np.ndarray, k: int, limits: Limits) -> list[Piece]:
    total, o = float(place[-1]), min(limits.overlap, limits.target // 2)
    length = (total + (k - 1) * o) / k
    fresh = max(length - o, total / (4 * k))
    reach = max(min(WINDOW * fresh, limits.maximum - length), 0.0)
    cuts = [0]
    for i in range(1, k):
        at = length + (i - 1) * fresh
        cuts.append(_snap(m, place, at, reach, cuts[-1] + 1, m.n - (k - i)))
    cuts.append(m.n)
    pieces = []
    for i in range(k):
        start = cuts[i]
        if i and o:
            start = _nearest_word(m, place, float(place[cuts[i]]) - o, 0.25 * o, cuts[i - 1] + 1 if i > 1 else 0, cuts[i] - 1)
        pieces.append(Piece(start, cuts[i], cuts[i + 1], m.size(start, cuts[i + 1]), max(int(m.strength[cuts[i + 1]]), 0)))
    return pieces


def split(text: str, limits: Limits, measured: _Measured | None = None) -> list[Piece]:
    """The pieces of a text; one that isn't larger than the maximum is a single piece."""
    whole = size_of(text)
    if whole <= limits.maximum:
        return [Piece(0, 0, len(text), whole, 0)]
    m = measured or _Measured(text)
    pieces: list[Piece] = []
    for place in m.measures():
        o = min(limits.overlap, limits.target // 2)
        least = max(2, math.ceil((float(place[-1]) - o) / (limits.target - o)))
        for k in range(least, min(least + max(4, least // 2), m.n) + 1):
            pieces = _place(m, place, k, limits)
            if all(p.tokens <= limits.maximum and p.fresh < p.end for p in pieces):
                return pieces
    k = len(pieces)
    while any(p.tokens > limits.maximum for p in pieces) and k < m.n:
        k = min(m.n, k + max(1, k // 8))
        pieces = _place(m, place, k, limits)
    return pieces


PIECE_COLUMNS = "profile_name string, node_id string, piece_no int, pieces int, start int, fresh int, `end` int, tokens int, boundary int"


def oversized_pieces(nodes: DataFrame, profiles: list[Limits], with_text: bool = True) -> DataFrame:
    """One row per piece of every node larger than a profile's maximum; start, fresh and end count code points."""
    ship(nodes.sparkSession)
    least = min((p.maximum for p in profiles), default=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for node, text in zip(pdf["id"], pdf["text"], strict=True):
                size = size_of(text)
                measured = _Measured(text) if size > least else None
                for limits in profiles:
                    if size <= limits.maximum:
                        continue
                    pieces = split(text, limits, measured)
                    for i, p in enumerate(pieces):
                        row = (limits.name, node, i, len(pieces), p.start, p.fresh, p.end, p.tokens, p.boundary)
                        rows.append((*row, text[p.start : p.end]) if with_text else row)
            names = ["profile_name", "node_id", "piece_no", "pieces", "start", "fresh", "end", "tokens", "boundary"]
            yield pd.DataFrame(rows, columns=names + ["text"] * with_text)

    # The latest delivery counts, then its size. A token takes at least two bytes (a word and white space), so of most
    # texts only that they are short leaves the scan.
    long = F.when(F.octet_length("text") >= 2 * least, F.col("text"))
    sized = nodes.where(F.col("id").isNotNull()).select("id", long.alias("text"), F.struct("indexed_at", F.xxhash64("text")).alias("at"))
    latest = sized.groupBy("id").agg(F.max_by("text", "at").alias("text")).where(F.col("text").isNotNull())
    return latest.mapInPandas(run, PIECE_COLUMNS + ", text string" * with_text)
