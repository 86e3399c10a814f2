"""Reading level of each document: a linear pairwise ranker over syntax and vocabulary features, calibrated into levels.

Running prose is cut out of the text first: paragraphs, list items and steps, without front matter, code, table rows
and headings. Its features are means over sentences and words (sentence length, clauses, word length, long words,
subordinating words) and the relative frequencies of plain lower-case words. The ranker learns from pairs of graded
documents which of the two is harder (logistic loss on score differences, L2 penalty); isotonic regression (pool
adjacent violators) maps scores to levels, interpolating between the pooled blocks.

Whether a document without a language is English is learned too: from the words of at most ``LANGUAGE_DOCS`` documents of
each language that is given (naive Bayes over words and single CJK characters, the ``LANGUAGE_WORDS`` most frequent of
each language).

Everything but the fits covers all documents. The fits use at most ``LABEL_BOUND`` graded documents, drawn by a hash of
their key, at most ``PAIR_BOUND`` pairs and ``VOCABULARY_BOUND`` words of them, and the documents drawn for the languages,
so what the driver holds doesn't grow with the corpus.

Defined cases: a document without prose (null, empty or blank text, code, tables) has 0 words, language as given or
null and no level; without any document whose language is given only those given as English count; equal scores have equal levels; a repeated label counts once, of differing labels of a document the
smallest; without any label or with labels of one level there is no ranking and each level is that one or null;
documents of other languages have no level; very long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalith.session import cut, ship

LABEL_BOUND = 3_000
PAIR_BOUND = 200_000
VOCABULARY_BOUND = 6_000
LEAST_WORDS = 60
LANGUAGE_DOCS = 200
LANGUAGE_WORDS = 2_000

#: Words that join or subordinate clauses.
CLAUSE_WORDS = frozenset(
    "although because whereas while unless which whose that provided so if when whether consequently insofar until since "
    "before after despite without however therefore thereby whereby upon whom as than once though and but or nor neither".split()
)

_FENCE = re.compile(r"^\s*(```|~~~)")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+")
_TABLE = re.compile(r"^\s*\|.*\||^\s*\|?\s*:?-{3,}:?\s*\|")
_RULE = re.compile(r"^\s*(?:-{3,}|={3,}|\*{3,}|_{3,})\s*$")
#: A line of front matter: a key, an item, something indented, a comment or nothing.
_SETTING = re.compile(r"^(?:[\w.\"'-][\w .\"'-]*:(?:\s|$)|\s*-\s|\s+\S|\s*#|\s*$|\s*[\]}])")
_SPEAKER = re.compile(r"^[^\W\d_][\w'’-]*:\s+")
_CODE = re.compile(
    r"[;{}]\s*$|^\s*(?:def |class |import |from \S+ import|return\b|const |let |var |export |function |SELECT |for \(|if \(|while \(|#\s|//|\$ )|\w+\([^)]*\)\s*[;:{]|--\w+"
)
_SENTENCE_END = re.compile(r"[.!?]+[\"'”’)\]]*(?:\s|$)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_INVISIBLE = re.compile("[​‌‍⁠­﻿\x00-\x08\x0e-\x1f]")
DENSE = ("words_per_sentence", "commas_per_sentence", "clauses_per_sentence", "letters_per_word", "share_7", "share_10", "share_13", "vowel_groups")


def _front_matter(lines: list[str]) -> int:
    """The first line after front matter that opens in line 0, or 0 if what follows isn't any, however long it is."""
    for i in range(1, len(lines)):
        if lines[i].strip() in ("---", "..."):
            return i + 1
        if not _SETTING.match(lines[i]):
            return 0
    return 0


def prose_of(text: str | None) -> list[str]:
    """Paragraphs, list items and steps of a text, each as one line."""
    if not text or not text.strip():
        return []
    lines = _INVISIBLE.sub("", text).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    begin = 0
    if lines[0].strip() == "---":
        begin = _front_matter(lines)
    out: list[str] = []
    block: list[str] = []
    item = False
    fenced: str | None = None

    def flush() -> None:
        nonlocal block, item
        if block:
            joined = " ".join(block)
            # A short line of its own that ends without punctuation is a heading.
            if item or len(block) > 1 or joined[-1] in ".!?:;…\"'”’)" or joined.count(" ") >= 12:
                if not joined.isupper():
                    out.append(_SPEAKER.sub("", joined))
        block, item = [], False

    for line in lines[begin:]:
        mark = _FENCE.match(line)
        if mark:
            flush()
            fenced = None if fenced == mark[1] else (fenced or mark[1])
            continue
        if fenced:
            continue
        bare = line.strip()
        if not bare:
            flush()
        elif bare[0] == "#" and bare.lstrip("#")[:1] in ("", " ", "\t"):
            flush()
        elif _RULE.match(line):
            block = [] if len(block) == 1 and not item and bare[0] in "-=" else block
            flush()
        elif _TABLE.match(line) or bare.count(" | ") >= 2:
            flush()
        elif (m := _ITEM.match(line)) is not None:
            flush()
            block, item = [line[m.end() :].strip()], True
            if not block[0]:
                block, item = [], False
        elif (line.startswith(("    ", "\t")) and not item) or _CODE.search(line):
            flush()
        else:
            block.append(bare)
    flush()
    return out


def language_words(text: str) -> Counter:
    """What tells a language: lower-case words, and CJK characters one by one."""
    found = Counter(_CJK.findall(text))
    found.update(w.lower() for w in _WORD.findall(_CJK.sub(" ", text)))
    return found


@dataclass
class Languages:
    """Naive Bayes over words; words that no language knows tell nothing."""

    names: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def learn(cls, counts: dict[str, Counter]) -> Languages:
        names = sorted(counts)
        known = sorted({w for c in counts.values() for w in c})
        if not known:
            return cls(names, {})
        table = np.array([[counts[n][w] for n in names] for w in known], float) + 0.1
        weights = np.log(table / table.sum(axis=0))
        return cls(names, dict(zip(known, weights - weights.mean(axis=1, keepdims=True), strict=True)))

    def tell(self, words: Counter) -> str | None:
        """The likeliest language, or null if no word is known."""
        hits = [(self.weights[w], c) for w, c in words.items() if w in self.weights]
        if not hits:
            return None
        total = sum(v * c for v, c in hits)
        return self.names[int(np.argmax(total))]


@dataclass
class Features:
    """What a document's prose shows: number of words, the dense features and the counts of plain words."""

    words: int
    english: bool
    dense: list[float] = field(default_factory=list)
    plain: Counter = field(default_factory=Counter)


_VOWELS = re.compile("[aeiouy]+")
_GROUPS: dict[str, int] = {}


def _vowel_groups(word: str) -> int:
    n = _GROUPS.get(word)
    if n is None:
        if len(_GROUPS) > 100_000:
            _GROUPS.clear()
        n = _GROUPS[word] = len(_VOWELS.findall(word))
    return n


def features_of(text: str | None, lang: str | None, languages: Languages | None = None) -> Features:
    if lang is not None and lang != "en":
        return Features(0, False)
    prose = prose_of(text)
    if not prose:
        return Features(0, lang == "en")
    joined = "\n".join(prose)
    words = _WORD.findall(joined)
    n = sum(len(p.split()) for p in prose)
    english = lang == "en" or (languages is not None and languages.tell(language_words(joined)) == "en")
    if not english or not words:
        return Features(n, english)
    sentences = sum(max(1, len(_SENTENCE_END.findall(p))) for p in prose)
    plain = Counter(w for w in words if w.islower() and w.isascii())
    total = sum(plain.values()) or 1
    clauses = sum(plain[w] for w in CLAUSE_WORDS if w in plain)
    letters = groups = s7 = s10 = s13 = 0
    for w, c in plain.items():
        size = len(w)
        letters += size * c
        groups += _vowel_groups(w) * c
        s7 += c if size >= 7 else 0
        s10 += c if size >= 10 else 0
        s13 += c if size >= 13 else 0
    dense = [
        float(np.log(n / sentences)), (joined.count(",") + joined.count(";")) / sentences, clauses / sentences,
        letters / total, s7 / total, s10 / total, s13 / total, groups / total,
    ]
    return Features(n, True, dense, plain)


@dataclass
class Ranker:
    """score = dense part + sum of word weights over the share of each word; level by interpolation over the knots."""

    mean: np.ndarray
    scale: np.ndarray
    dense: np.ndarray
    word_weight: dict[str, float]
    word_base: float
    knots: np.ndarray
    levels: np.ndarray

    def score(self, f: Features) -> float:
        total = sum(f.plain.values()) or 1
        known = self.word_weight
        vocabulary = sum(known[w] * (c / total) ** 0.5 for w, c in f.plain.items() if w in known)
        return float(((np.array(f.dense) - self.mean) / self.scale) @ self.dense + vocabulary - self.word_base)

    def level(self, score: float) -> float:
        return float(np.interp(score, self.knots, self.levels))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y over x: pool adjacent violators, equal x pooled first."""
    xs, inverse = np.unique(x, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y) / weight
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for m, w, at in zip(mean, weight, xs, strict=True):
        blocks.append([m, w, at, at])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    knots = np.array([k for b in blocks for k in (b[2], b[3])])
    return knots, np.array([b[0] for b in blocks for _ in (0, 1)])


def fit(graded: list[tuple[Features, int]], penalty: float = 1e-3, steps: int = 300, seed: int = 7) -> Ranker | None:
    """The ranker and its calibration from graded documents with prose; None without any."""
    graded = [(f, y) for f, y in graded if f.dense]
    if not graded:
        return None
    y = np.array([g[1] for g in graded], float)
    dense = np.array([g[0].dense for g in graded])
    mean, scale = dense.mean(axis=0), dense.std(axis=0) + 1e-9
    seen = Counter(w for f, _ in graded for w in f.plain)
    vocabulary = {w: i for i, (w, c) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY_BOUND]) if c > 1}
    k = dense.shape[1]
    x = np.zeros((len(graded), k + len(vocabulary)), np.float32)
    x[:, :k] = (dense - mean) / scale
    for i, (f, _) in enumerate(graded):
        total = sum(f.plain.values()) or 1
        for w, c in f.plain.items():
            if w in vocabulary:
                x[i, k + vocabulary[w]] = (c / total) ** 0.5
    center = x[:, k:].mean(axis=0)
    x[:, k:] -= center
    x[:, k:] *= 4
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(graded), (2, PAIR_BOUND))
    keep = y[a] != y[b]
    a, b = a[keep], b[keep]
    a, b = np.where(y[a] > y[b], a, b), np.where(y[a] > y[b], b, a)
    w = np.zeros(x.shape[1], np.float32)
    if len(a):
        m, v = np.zeros_like(w), np.zeros_like(w)
        n = len(graded)
        for step in range(1, steps + 1):
            s = x @ w
            pull = 1 / (1 + np.exp(np.clip(s[a] - s[b], -30, 30)))
            per_doc = np.bincount(b, pull, n) - np.bincount(a, pull, n)
            grad = x.T @ (per_doc / len(a)).astype(np.float32) + penalty * w
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = {word: float(4 * w[k + i]) for word, i in vocabulary.items()}
    base = float(4 * (center @ w[k:]))
    ranker = Ranker(mean, scale, w[:k].astype(float), weights, base, np.zeros(1), np.zeros(1))
    scores = np.array([ranker.score(f) for f, _ in graded])
    ranker.knots, ranker.levels = isotonic(scores, y)
    return ranker


def learned(documents: DataFrame, labels: DataFrame, bound: int = LABEL_BOUND, per_language: int = LANGUAGE_DOCS) -> tuple[Languages, list[tuple[Features, int]]]:
    """(languages, features of graded documents) from at most ``bound`` graded documents and ``per_language`` of each
    given language, all drawn by a hash of their key; one pass over the texts."""
    ship(documents.sparkSession)
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    graded = (
        labels.where(F.col("doc_id").isNotNull() & F.col("reading_level").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("reading_level").alias("reading_level"))
        .orderBy(*by_hash)
        .limit(bound)
    )
    spoken = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.lit(True).alias("spoken"), F.row_number().over(Window.partitionBy("lang").orderBy(*by_hash)).alias("no")
    )
    drawn = (
        graded.select("doc_id", "reading_level", F.lit(None).cast("boolean").alias("spoken"))
        .unionByName(spoken.where(F.col("no") <= per_language).select("doc_id", F.lit(None).cast("int").alias("reading_level"), "spoken"))
        .groupBy("doc_id")
        .agg(F.max("reading_level").cast("int").alias("reading_level"), F.max("spoken").alias("spoken"))
    )
    # The drawn keys are bounded by the two numbers above, so the texts stay where they are.
    texts = documents.select("doc_id", "text", "lang").join(F.broadcast(drawn), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, lang, level, spoken in pdf[["doc_id", "text", "lang", "reading_level", "spoken"]].itertuples(index=False):
                prose = "\n".join(prose_of(text))
                if spoken is True or spoken == 1:
                    counts = language_words(prose)
                    rows.append((doc_id, None, lang, 0, [], list(counts), list(counts.values()), None))
                if not pd.isna(level):
                    f = features_of(text, "en" if lang is None else lang)
                    told = None if lang is not None else language_words(prose)
                    rows.append((doc_id, int(level), lang, f.words, f.dense, list(f.plain), list(f.plain.values()), None if told is None else sorted(told.elements())))
            names = ["doc_id", "level", "lang", "words", "dense", "plain", "counts", "told"]
            yield pd.DataFrame(rows, columns=names).astype({"level": "Int32"})

    schema = "doc_id bigint, level int, lang string, words int, dense array<double>, plain array<string>, counts array<int>, told array<string>"
    seen = cut(texts.mapInPandas(run, schema))
    # Of each language only its most frequent words reach the driver.
    words = seen.where("level IS NULL").select("lang", F.inline(F.arrays_zip(F.col("plain").alias("word"), F.col("counts").alias("n"))))
    summed = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    ranked = summed.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    counts: dict[str, Counter] = {}
    for r in ranked.where(F.col("no") <= LANGUAGE_WORDS).collect():
        counts.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    languages = Languages.learn(counts)
    got = seen.where("level IS NOT NULL").collect()
    got.sort(key=lambda r: r["doc_id"])
    return languages, [
        (Features(r["words"], True, r["dense"], Counter(dict(zip(r["plain"], r["counts"], strict=True)))), r["level"])
        for r in got
        if r["lang"] == "en" or (r["told"] and languages.tell(Counter(r["told"])) == "en")
    ]


def cross_validated(graded: list[tuple[Features, int]], folds: int = 5, hard: int = 4) -> tuple[float, float]:
    """(share of levels told right, share of documents told right as ``hard`` or not) on folds held out of the fit."""
    graded = [(f, y) for f, y in graded if f.dense]
    right = sides = 0
    for k in range(folds):
        ranker = fit([g for i, g in enumerate(graded) if i % folds != k])
        for f, y in graded[k::folds]:
            level = int(np.floor(ranker.level(ranker.score(f)) + 0.5)) if ranker is not None else None
            right += level == y
            sides += level is not None and (level >= hard) == (y >= hard)
    return right / max(1, len(graded)), sides / max(1, len(graded))


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, words, english, score, level_value, level): level is 1 to 5 for English documents with prose, else null."""
    spark = documents.sparkSession
    languages, graded = learned(documents, labels)
    shared = spark.sparkContext.broadcast((fit(graded), languages))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, spoken = shared.value
        for pdf in batches:
            rows = []
            for doc_id, text, lang in zip(pdf["doc_id"], pdf["text"], pdf["lang"], strict=True):
                f = features_of(text, lang, spoken)
                score = model.score(f) if model is not None and f.dense else None
                rows.append((doc_id, f.words, f.english, score, None if score is None else model.level(score)))
            yield pd.DataFrame(rows, columns=["doc_id", "words", "english", "score", "level_value"])

    got = documents.select("doc_id", "text", "lang").mapInPandas(
        run, "doc_id bigint, words int, english boolean, score double, level_value double"
    )
    return got.withColumn("level", F.floor(F.col("level_value") + 0.5).cast("int"))
