"""Byte-level BPE over a whole corpus by batched numpy merge rounds.

Pre-tokens ("words") of a batch are encoded together: all their symbols lie in one flat array with the index of the
word each belongs to. A round looks every adjacent pair up by binary search over the sorted pair keys, takes each
word's lowest rank, merges all its occurrences at once (left to right where they overlap) and drops the words without
a pair left. Merging all occurrences of the lowest pair equals merging one by one, since a merge can only make pairs
of higher rank. Words already met in a task come from a table of bounded size (it is emptied when full, which costs
time, not results), so texts cost one pattern scan and one gather.

Defined ids: a null text and an empty text give an empty list; special-token strings are ordinary text; blank texts,
control characters and unpaired line ends are encoded as they stand. Very long texts and words need no special case.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.session import ship

VOCABULARY = os.environ.get("STRATALITH_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
#: Words kept per task; beyond it the table starts anew.
TABLE_WORDS = 1_000_000
BATCH_CHARS = 4_000_000
SHIFT = 17
NO_RANK = np.int32(2**31 - 1)

#: White space as the pattern of the public vocabulary means it, and the pattern itself.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{S}{l}{n}]+|[{S}]+(?![^{S}])|[{S}]+"


def _pattern(letters: str, numbers: str, space: str) -> str:
    out = _PATTERN.replace("{L}", f"[{letters}]").replace("{N}", f"[{numbers}]")
    return out.replace("{l}", letters).replace("{n}", numbers).replace("{S}", space)


WORDS = regex.compile(_pattern(r"\p{L}", r"\p{N}", _SPACE))
ASCII_WORDS = re.compile(_pattern("A-Za-z", "0-9", r"\t-\r "), re.ASCII)


def words_of(text: str) -> list[str]:
    return ASCII_WORDS.findall(text) if text.isascii() else WORDS.findall(text)


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """byte_ids: id of each single byte; pair_keys: sorted ``left << SHIFT | right``; pair_ids: what the pair becomes."""

    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ids: np.ndarray
    pair_ranks: np.ndarray

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, stand_in = model["vocab"], _byte_chars()
        byte_ids = np.zeros(256, np.int32)
        for ch, b in stand_in.items():
            byte_ids[b] = ids[ch]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] << SHIFT | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys)
        return cls(byte_ids, keys[order], made[order], np.arange(len(pairs), dtype=np.int32)[order])


def encode_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, number of ids of each word) of non-empty words."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    sym = v.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    word = np.repeat(np.arange(len(raw), dtype=np.int32), lens)
    done_sym: list[np.ndarray] = []
    done_word: list[np.ndarray] = []
    while len(sym):
        inside = np.empty(len(sym), bool)
        inside[-1] = False
        np.equal(word[1:], word[:-1], out=inside[:-1])
        key = np.full(len(sym), -1, np.int64)
        key[:-1] = sym[:-1].astype(np.int64) << SHIFT | sym[1:]
        at = np.searchsorted(v.pair_keys, key)
        at[at == len(v.pair_keys)] = 0
        hit = inside & (v.pair_keys[at] == key)
        rank = np.where(hit, v.pair_ranks[at], NO_RANK)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[first, len(sym)])
        lowest = np.repeat(np.minimum.reduceat(rank, first), size)
        ended = lowest == NO_RANK
        if ended.any():
            done_sym.append(sym[ended])
            done_word.append(word[ended])
            keep = ~ended
            sym, word, rank, lowest, at = sym[keep], word[keep], rank[keep], lowest[keep], at[keep]
            if not len(sym):
                break
        chosen = np.flatnonzero(rank == lowest)
        if len(chosen) > 1:  # in a run of overlapping pairs every second one merges
            run = np.r_[True, np.diff(chosen) != 1]
            start = np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - start) % 2 == 0]
        sym[chosen] = v.pair_ids[at[chosen]]
        keep = np.ones(len(sym), bool)
        keep[chosen + 1] = False
        sym, word = sym[keep], word[keep]
    flat, of = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(of, kind="stable")
    return flat[order], np.bincount(of, minlength=len(words))


class Encoder:
    """Encodes texts batch by batch, keeping the ids of words already met."""

    def __init__(self, vocabulary: Vocabulary, table_words: int = TABLE_WORDS):
        self.v, self.table_words = vocabulary, table_words
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = _Numbering()
        self.ids = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def _grow(self) -> None:
        new = list(self.index.fresh)
        if not new:
            return
        self.index.fresh.clear()
        flat, lens = encode_words(new, self.v)
        self.ids = np.concatenate([self.ids, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lens)])

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.table_words:
            self.clear()
        number, flat, counts = self.index.__getitem__, [], []
        for t in texts:
            words = words_of(t) if t else []
            counts.append(len(words))
            flat.append(np.fromiter(map(number, words), np.int64, len(words)))
        self._grow()
        return (np.concatenate(flat) if flat else np.empty(0, np.int64)), np.array(counts, np.int64)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        numbers, counts = self._numbers(texts)
        sizes = np.r_[0, np.cumsum(np.diff(self.starts)[numbers])]
        ends = np.cumsum(counts)
        return sizes[ends] - sizes[ends - counts]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets): the ids of text i are flat[offsets[i]:offsets[i + 1]]."""
        numbers, counts = self._numbers(texts)
        begin, lens = self.starts[:-1][numbers], np.diff(self.starts)[numbers]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.arange(total) - np.repeat(ends - lens - begin, lens)]
        ends = np.r_[0, ends]
        return flat, np.r_[0, ends[np.cumsum(counts)]]


class _Numbering(dict):
    """Numbers words in order of first appearance; ``fresh`` lists those without ids yet."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def text_blocks(batch: pa.RecordBatch, column: str, most: int = BATCH_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of slices of at most about ``most`` characters; one longer text is a slice of its own."""
    texts = batch.column(column).to_pylist()
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > most:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += n
    if begin < len(texts) or not texts:
        yield begin, texts[begin:]


def with_ids(df: DataFrame, text: str = "text", key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row. The vocabulary, of fixed size, goes out once per executor."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            keys = batch.column(0)
            for begin, texts in text_blocks(batch, "_text"):
                flat, offsets = encoder.encode(texts)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(begin, len(texts)), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def with_counts(df: DataFrame, text: str = "text", key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """(key, tokens int): the length of each text in ids; 0 for null and empty texts."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            counts = [encoder.count(texts) for _, texts in text_blocks(batch, "_text")]
            tokens = pa.array(np.concatenate(counts), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens], names=[key, "tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, tokens int")
