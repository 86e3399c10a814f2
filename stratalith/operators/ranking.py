"""Ranking of candidates: scores, visibility, near duplicates, diversity and the reason each dropped one was dropped.

Candidates come as rows (query_id, query, chunk_id, artifact_id, relative_path, title, heading_path, text, status,
authority, estimated_tokens, bm25), many queries at once. The greedy step takes a query of up to 500 candidates (the
candidate depth of a search) in one piece and a larger one in rounds over its near pairs; both give the same result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith import constants as C
from stratalith.functions.text import basename, normalize, round6, shingles, stem, words_of
from stratalith.session import cut, ship


def candidate_count(limit: int) -> int:
    return min(C.CANDIDATE_MAXIMUM, max(C.CANDIDATE_MINIMUM, limit * C.CANDIDATE_MULTIPLIER))


def authority_multiplier(a: Column) -> Column:
    """Two straight lines: 0 to 0.75, 50 to 1, 100 to 1.25."""
    low = C.AUTHORITY_MINIMUM + (1 - C.AUTHORITY_MINIMUM) * a / C.AUTHORITY_NEUTRAL
    high = 1 + (C.AUTHORITY_MAXIMUM - 1) * (a - C.AUTHORITY_NEUTRAL) / (100 - C.AUTHORITY_NEUTRAL)
    return F.when(a <= C.AUTHORITY_NEUTRAL, low).otherwise(high)


def status_factor(status: Column) -> Column:
    out = F.lit(1.0)
    for name, factor in C.STATUS_FACTORS.items():
        out = F.when(status == name, factor).otherwise(out)
    return out


def scored(candidates: DataFrame, superseded: DataFrame | None = None) -> DataFrame:
    """Candidates with their score components, ``score`` (6 decimals) and ``labels``.

    superseded(artifact_id) lists artifacts that others supersede; without it none is.
    """
    if superseded is not None:
        flags = superseded.select("artifact_id").distinct().withColumn("superseded", F.lit(True))
        candidates = candidates.join(flags, "artifact_id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))
    elif "superseded" not in candidates.columns:
        candidates = candidates.withColumn("superseded", F.lit(False))
    q = normalize(F.col("query"))
    path, title = F.coalesce("relative_path", F.lit("")), F.coalesce("title", F.lit(""))
    headings = F.coalesce("heading_path", F.array().cast("array<string>"))
    hay = normalize(F.concat_ws(" ", path, F.array_join(headings, " "), F.coalesce("text", F.lit(""))))
    raw = F.greatest(F.lit(0.0), -F.coalesce("bm25", F.lit(0.0)))
    # Generated, the two normalized texts are made once a row; as columns they'd be folded into the test of every word.
    rows = (
        candidates.select("*", F.inline(F.array(F.struct(q.alias("_q"), hay.alias("_hay")))))
        .withColumn("lexical_raw", raw)
        .withColumn("lexical", F.col("lexical_raw") / (F.col("lexical_raw") + C.SATURATION))
        .withColumn(
            "path_exact",
            F.when((F.col("_q") != "") & ((normalize(basename(path)) == F.col("_q")) | (normalize(stem(path)) == F.col("_q"))), C.BOOST_PATH).otherwise(0.0),
        )
        .withColumn("title_exact", F.when((F.col("_q") != "") & (normalize(title) == F.col("_q")), C.BOOST_TITLE).otherwise(0.0))
        .withColumn("heading_exact", F.when(F.exists(headings, lambda h: normalize(h) == F.col("_q")), C.BOOST_HEADING).otherwise(0.0))
        .withColumn(
            "all_terms",
            F.when(
                (F.size(words_of(F.col("_q"))) > 1) & F.forall(words_of(F.col("_q")), lambda t: F.contains(F.col("_hay"), t)),
                C.BOOST_ALL_TERMS,
            ).otherwise(0.0),
        )
        .withColumn("status_factor", status_factor(F.col("status")))
        .withColumn("authority_factor", authority_multiplier(F.coalesce("authority", F.lit(C.DEFAULT_AUTHORITY))))
        .withColumn("superseded_factor", F.when(F.col("superseded"), C.SUPERSEDED_FACTOR).otherwise(1.0))
    )
    added = F.col("lexical") + F.col("path_exact") + F.col("title_exact") + F.col("heading_exact") + F.col("all_terms")
    total = added * F.col("status_factor") * F.col("authority_factor") * F.col("superseded_factor")
    labels = F.array_compact(
        F.array(
            F.when(F.col("status") == "draft", "draft"),
            F.when(F.col("status") == "archived", "archived"),
            F.when(F.col("superseded"), "superseded"),
        )
    )
    return rows.withColumn("score", round6(total)).withColumn("labels", labels).drop("_q", "_hay")


def rank_order() -> list[Column]:
    return [F.desc("score"), F.col("relative_path"), F.col("chunk_id")]


def with_visibility(rows: DataFrame) -> DataFrame:
    """``shown``: neither archived nor superseded; where a query has no such candidate all are shown."""
    visible = (F.coalesce("status", F.lit("")) != "archived") & ~F.col("superseded")
    return rows.withColumn("shown", visible | (F.count_if(visible).over(Window.partitionBy("query_id")) == 0))


def greedy_duplicates(rows: DataFrame, overlap: float = C.NEAR_DUPLICATE_OVERLAP, most: int = C.CANDIDATE_MAXIMUM, bounded: bool = False) -> DataFrame:
    """(query_id, chunk_id) of shown candidates that nearly equal a better one which is itself kept.

    Greedy in rank order and against kept candidates only: a near b and b near c, but a not near c, keeps a and c.
    Queries of more than ``most`` shown candidates are decided in rounds, which one action looks for; not so where the
    caller knows that there are none (``bounded``).
    """
    ship(rows.sparkSession)
    w = Window.partitionBy("query_id").orderBy(*rank_order())
    sets = (
        rows.where("shown")
        .withColumn("rank", F.row_number().over(w))
        .select("query_id", "chunk_id", "rank", normalize(F.coalesce("text", F.lit(""))).alias("plain"))
    )
    if bounded:
        return _greedy_whole(sets, overlap)
    large = rows.where("shown").groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("query_id")
    if large.isEmpty():
        return _greedy_whole(sets, overlap)
    large = cut(large)
    return _greedy_whole(sets.join(large, "query_id", "left_anti"), overlap).unionByName(
        _greedy_rounds(sets.join(large, "query_id", "left_semi"), overlap)
    )


def _greedy_whole(sets: DataFrame, overlap: float) -> DataFrame:
    """The greedy step with all candidates of a query in one task."""

    def of_query(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[set[tuple[str, ...]]] = []
        gone = []
        for chunk, plain in pdf.sort_values("rank")[["chunk_id", "plain"]].itertuples(index=False):
            words = plain.split()
            k = C.SHINGLE_WORDS
            own = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
            if own and any(_near(own, other, overlap) for other in kept):
                gone.append(chunk)
            else:
                kept.append(own)
        return pd.DataFrame({"query_id": [key[0]] * len(gone), "chunk_id": gone}, dtype=object)

    kind = sets.schema["query_id"].dataType.simpleString()
    return sets.groupBy("query_id").applyInPandas(of_query, f"query_id {kind}, chunk_id string")


def _greedy_rounds(sets: DataFrame, overlap: float) -> DataFrame:
    """The greedy step over all near pairs at once.

    Copies of a better candidate are gone whatever becomes of it: it is kept, or both are near what it is gone for. Of
    the others, a round keeps those that no undecided better one is near and drops what is near them.
    """
    sets = cut(sets.select("query_id", "chunk_id", "rank", _hashed_shingles(F.col("plain")).alias("s")).where(F.size("s") > 0).withColumn("set_key", F.sha2(F.array_join(F.transform("s", lambda x: x.cast("string")), ","), 256)))
    heads = sets.groupBy("query_id", "set_key").agg(F.min("rank").alias("first"))
    first = sets.join(heads, ["query_id", "set_key"])
    gone = first.where(F.col("rank") > F.col("first")).select("query_id", "chunk_id")
    first = first.where(F.col("rank") == F.col("first"))
    near = _near_sets(first.select("query_id", F.col("rank").alias("chunk_id"), "s"), overlap)
    left = cut(near.select("query_id", F.col("chunk_a").alias("better"), F.col("chunk_b").alias("worse")))
    while not left.isEmpty():
        worse = left.select("query_id", F.col("worse").alias("better")).distinct()
        out = cut(left.join(worse, ["query_id", "better"], "left_anti").select("query_id", F.col("worse").alias("rank")).distinct())
        gone = gone.unionByName(first.join(out, ["query_id", "rank"], "left_semi").select("query_id", "chunk_id"))
        for side in ("better", "worse"):
            left = left.join(out.select("query_id", F.col("rank").alias(side)), ["query_id", side], "left_anti")
        left = cut(left.select("query_id", "better", "worse"))
    return gone


def _near(a: set, b: set, overlap: float) -> bool:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if not small or len(small) < overlap * len(large):
        return False
    both = sum(x in large for x in small)
    return both >= overlap * (len(a) + len(b) - both)


def near_duplicate_pairs(rows: DataFrame, overlap: float = C.NEAR_DUPLICATE_OVERLAP) -> DataFrame:
    """(query_id, chunk_a, chunk_b): candidates of one query whose shingle sets overlap enough.

    Prefix filtering: two sets as similar as that share one of the few shingles of each that come first in the order of their hashes, so candidates
    come from an equi-join on these, not from all pairs of a query.
    """
    sets = rows.select("query_id", "chunk_id", _hashed_shingles(normalize(F.coalesce("text", F.lit("")))).alias("s")).where(F.size("s") > 0)
    return _near_sets(sets, overlap)


def _hashed_shingles(plain: Column) -> Column:
    return F.array_sort(F.transform(shingles(plain), lambda x: F.xxhash64(x)))


def _near_sets(sets: DataFrame, overlap: float) -> DataFrame:
    """Pairs of sets(query_id, chunk_id, s) that overlap enough. Only keys and sizes meet in the first join; the sets
    follow for the pairs it leaves."""
    size = F.size("s")
    prefix = size - F.ceil(size * overlap).cast("int") + 1
    keys = sets.select("query_id", "chunk_id", size.alias("n"), F.explode(F.slice("s", F.lit(1), prefix)).alias("key"))
    a = keys.select("query_id", "key", F.col("chunk_id").alias("chunk_a"), F.col("n").alias("na"))
    b = keys.select("query_id", "key", F.col("chunk_id").alias("chunk_b"), F.col("n").alias("nb"))
    met = a.join(b, ["query_id", "key"]).where((F.col("chunk_a") < F.col("chunk_b")) & (F.col("na") >= overlap * F.col("nb")) & (F.col("nb") >= overlap * F.col("na")))
    pairs = met.select("query_id", "chunk_a", "chunk_b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sets.select("query_id", F.col("chunk_id").alias(f"chunk_{side}"), F.col("s").alias(side)), ["query_id", f"chunk_{side}"])
    both = F.size(F.array_intersect("a", "b"))
    return pairs.where(both >= overlap * (F.size("a") + F.size("b") - both)).select("query_id", "chunk_a", "chunk_b")


def ranked(candidates: DataFrame, limit: int, superseded: DataFrame | None = None, bounded: bool = False) -> DataFrame:
    """Every candidate with score, labels, ``position`` on the page (null if dropped) and ``reason`` it was dropped.

    The first cause wins: superseded or archived, then duplicate, then diversity, then budget (past the page).
    """
    rows = with_visibility(scored(candidates, superseded))
    gone = greedy_duplicates(rows, bounded=bounded).withColumn("duplicate", F.lit(True))
    rows = rows.join(gone, ["query_id", "chunk_id"], "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))
    live = F.col("shown") & ~F.col("duplicate")
    per_artifact = Window.partitionBy("query_id", live, "artifact_id").orderBy(*rank_order())
    rows = rows.withColumn("_in_artifact", F.row_number().over(per_artifact))
    kept = live & (F.col("_in_artifact") <= C.MAX_CHUNKS_PER_ARTIFACT)
    rows = rows.withColumn("_kept", kept)
    page = Window.partitionBy("query_id", "_kept").orderBy(*rank_order())
    rows = rows.withColumn("_position", F.row_number().over(page))
    reason = (
        F.when(~F.col("shown"), F.when(F.col("superseded"), "superseded").otherwise("archived"))
        .when(F.col("duplicate"), "duplicate")
        .when(~F.col("_kept"), "diversity")
        .when(F.col("_position") > limit, "budget")
    )
    return (
        rows.withColumn("reason", reason)
        .withColumn("position", F.when(F.col("reason").isNull(), F.col("_position")))
        .drop("_in_artifact", "_kept", "_position")
    )

