"""The inverted index: written once, then searched with weighted BM25, for one query or for many at once.

Chunks come as (chunk_id, artifact_id, path, title, heading, body, ...). An index is four tables in one folder:

* ``entries``: one row per term and chunk with the chunk's length, the term's weighted frequency and its places;
* ``terms``: in how many chunks each term occurs, and how often;
* ``lengths``: the length of each chunk in terms;
* ``totals``: one row, the number of chunks and the sum of their lengths.

Entries are dealt by chunk over shards and sorted by term within each, so a build moves every text once, a frequent term is
spread over all shards, and a search reads of each shard only the pages of its own terms. What a search needs besides
(document frequencies, totals) is read from the small tables; texts are never scanned.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stratalith.constants import BM25_B, BM25_K1, COLUMN_WEIGHTS, IDF_FLOOR
from stratalith.functions.globs import sqlite_glob
from stratalith.functions.text import fold_terms, index_terms
from stratalith.session import at_once, small_session

COLUMNS = tuple(COLUMN_WEIGHTS)
SHARDS = 4_096
ROW_GROUP_BYTES = 8 * 1024 * 1024
HITS = "key string, chunk_id string, dl int, tf double"


def tokenized(chunks: DataFrame, *more: str) -> DataFrame:
    """(chunk_id, more..., path_terms, title_terms, heading_terms, body_terms, dl); nulls count as empty."""
    got = chunks.select("chunk_id", *more, *[index_terms(F.coalesce(c, F.lit(""))).alias(f"{c}_terms") for c in COLUMNS])
    return got.withColumn("dl", sum((F.size(f"{c}_terms") for c in COLUMNS), F.lit(0)))


def entries_of(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, dl, tf, places array<struct<col, at>>); positions count from 0 within a column.

    One exchange of the chunks; everything else stays within a shard.
    """
    lists = F.array(*[F.struct(F.lit(i).alias("col"), F.lit(w).alias("w"), F.col(f"{c}_terms").alias("terms")) for i, (c, w) in enumerate(COLUMN_WEIGHTS.items())])
    dealt = chunks.select("chunk_id", *COLUMNS).withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.lit(SHARDS))).repartition("shard")
    every = tokenized(dealt, "shard").select("shard", "chunk_id", "dl", F.inline(lists)).select("shard", "chunk_id", "dl", "col", "w", F.posexplode("terms").alias("at", "term"))
    return (
        every.groupBy("shard", "chunk_id", "dl", "term")
        .agg(F.sum("w").alias("tf"), F.array_sort(F.collect_list(F.struct("col", "at"))).alias("places"))
        .select("term", "chunk_id", "dl", "tf", "places")
    )


def query_phrases(query: str) -> list[list[str]]:
    """White-space parts of a query; a part of several index terms (``a-b``) is a phrase. Parts without terms drop."""
    return [p for p in (fold_terms(part) for part in query.split()) if p]


def named_phrases(queries: DataFrame) -> DataFrame:
    """(query_id, key, words, times) of queries(query_id, query): the phrases of each and how often it names them."""
    parts = queries.select("query_id", F.explode(F.split(F.trim("query"), r"\s+")).alias("part"))
    terms = parts.select("query_id", index_terms(F.col("part")).alias("words")).where(F.size("words") > 0)
    return terms.groupBy("query_id", F.array_join("words", " ").alias("key"), "words").agg(F.count(F.lit(1)).alias("times"))


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(IDF_FLOOR)


def term_score(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / avgdl))


def _weight(col: str = "col") -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in COLUMN_WEIGHTS.values()]), F.col(col) + 1)


class SearchIndex:
    """An index that lies in a folder; every search reads it as it was written."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._tables: dict[str, DataFrame] = {}
        totals = self.table("totals").first()
        self.n, self.avgdl = float(totals["n"]), float(totals["length"] or 0) / max(1, totals["n"]) or 1.0

    @staticmethod
    def write(chunks: DataFrame, root: str) -> None:
        """Write the index of a set of chunks; ``totals`` comes last and marks it as whole."""
        spark, root = chunks.sparkSession, root.rstrip("/")

        def put(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{root}/{name}.parquet")
            return spark.read.parquet(f"{root}/{name}.parquet")

        entries = put(entries_of(chunks).sortWithinPartitions("term", "chunk_id"), "entries")
        terms = entries.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("places")).alias("occurrences")).sort("term")
        held = entries.select("chunk_id", "dl").distinct()
        # Chunks without a single term have no entry, but count.
        every = chunks.select("chunk_id").distinct().join(held, "chunk_id", "left").select("chunk_id", F.coalesce("dl", F.lit(0)).alias("dl"))
        _, lengths = at_once(lambda: put(terms, "terms"), lambda: put(every, "lengths"))
        put(lengths.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("length")).coalesce(1), "totals")

    def table(self, name: str) -> DataFrame:
        """A table of the folder; it is listed and its schema read once."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._tables[name]

    def postings(self) -> DataFrame:
        """(term, chunk_id, col, positions): one row per term, chunk and column."""
        def of(i: int) -> Column:
            return F.transform(F.filter("places", lambda p: p["col"] == i), lambda p: p["at"])

        per_column = F.array(*[F.struct(F.lit(c).alias("col"), of(i).alias("positions")) for i, c in enumerate(COLUMNS)])
        return self.table("entries").select("term", "chunk_id", F.inline(per_column)).where(F.size("positions") > 0)

    def _phrase_hits(self, wanted: DataFrame) -> DataFrame:
        """Hits of phrases given as wanted(key, n, k, term): term k of n. A phrase occurs where its terms stand at
        consecutive places of one column."""
        met = self.table("entries").join(wanted, "term").select("key", "n", "k", "chunk_id", "dl", F.inline("places"))
        starts = met.groupBy("key", "n", "chunk_id", "dl", "col", (F.col("at") - F.col("k")).alias("start")).agg(F.count(F.lit(1)).alias("terms"))
        whole = starts.where(F.col("terms") == F.col("n"))
        return whole.groupBy("key", "chunk_id", "dl").agg(F.sum(_weight()).alias("tf"))

    def hits(self, phrases: Sequence[Sequence[str]]) -> DataFrame:
        """(key, chunk_id, dl, tf): in which chunks each of the phrases occurs; ``key`` is its terms with spaces between."""
        single = sorted({p[0] for p in phrases if len(p) == 1})
        longer = sorted({tuple(p) for p in phrases if len(p) > 1})
        got = self.table("entries").where(F.col("term").isin(*single)).select(F.col("term").alias("key"), "chunk_id", "dl", "tf")
        if longer:
            rows = [(" ".join(p), len(p), k, t) for p in longer for k, t in enumerate(p)]
            got = got.unionByName(self._phrase_hits(self.spark.createDataFrame(rows, "key string, n int, k int, term string")))
        return got

    def _frequencies(self, phrases: Sequence[Sequence[str]], hits: DataFrame) -> dict[str, int]:
        """In how many chunks each phrase occurs: terms as noted, longer phrases counted."""
        single = sorted({p[0] for p in phrases if len(p) == 1})
        out = {r["term"]: r["df"] for r in self.table("terms").where(F.col("term").isin(*single)).select("term", "df").collect()}
        longer = sorted({" ".join(p) for p in phrases if len(p) > 1})
        if longer:
            counted = hits.where(F.col("key").isin(*longer)).groupBy("key").agg(F.count(F.lit(1)).alias("df"))
            out |= {r["key"]: r["df"] for r in counted.collect()}
        return out

    def _by_chunk(self, phrases: Sequence[Sequence[str]], hits: DataFrame, mode: str) -> tuple[DataFrame, list[str]]:
        keys = list(dict.fromkeys(" ".join(p) for p in phrases))
        tfs = [F.max(F.when(F.col("key") == k, F.col("tf"))).alias(f"tf{i}") for i, k in enumerate(keys)]
        rows = hits.groupBy("chunk_id").agg(F.max("dl").alias("dl"), *tfs)
        if mode == "all":
            for i in range(len(keys)):
                rows = rows.where(F.col(f"tf{i}").isNotNull())
        return rows, keys

    def match(self, query: str, mode: str = "all") -> DataFrame:
        """(chunk_id) of chunks that hold all (or any) phrases of the query. A query without terms matches nothing."""
        phrases = query_phrases(query)
        if not phrases:
            return self.table("lengths").where("false").select("chunk_id")
        return self._by_chunk(phrases, self.hits(phrases), mode)[0].select("chunk_id")

    def bm25(self, query: str, mode: str = "all", within: DataFrame | None = None) -> DataFrame:
        """(chunk_id, bm25) of the matching chunks; negative, the best lowest. A phrase named twice counts twice.

        within(chunk_id) restricts what is scored, not the statistics.
        """
        phrases = query_phrases(query)
        if not phrases:
            return self.table("lengths").where("false").select("chunk_id", F.lit(0.0).alias("bm25"))
        hits = self.hits(phrases)
        known = self._frequencies(phrases, hits)
        rows, keys = self._by_chunk(phrases, hits, mode)
        if within is not None:
            rows = rows.join(within.select("chunk_id"), "chunk_id", "left_semi")
        at = {k: i for i, k in enumerate(keys)}
        total = F.lit(0.0)
        for p in phrases:
            key = " ".join(p)
            part = idf(F.lit(self.n), F.lit(float(known.get(key, 0)))) * term_score(F.col(f"tf{at[key]}"), F.col("dl"), F.lit(self.avgdl))
            total = total + F.coalesce(part, F.lit(0.0))
        return rows.select("chunk_id", (-total).alias("bm25"))

    def batch_bm25(self, queries: DataFrame, mode: str = "any") -> DataFrame:
        """(query_id, chunk_id, bm25) for queries(query_id, query): all queries in one dataflow of equi-joins.

        The same meaning as ``bm25``, phrases included. Only entries of the queries' terms are read; what a shard holds is
        added up per query and chunk before anything is exchanged.
        """
        named = named_phrases(queries)
        wanted = named.select("key", "words").distinct()
        single = wanted.where(F.size("words") == 1).select(F.col("key").alias("term"))
        longer = wanted.where(F.size("words") > 1).select("key", F.size("words").alias("n"), F.posexplode("words").alias("k", "term"))
        hits = (
            self.table("entries").join(single, "term", "left_semi").select(F.col("term").alias("key"), "chunk_id", "dl", "tf")
            .unionByName(self._phrase_hits(longer))
        )
        df = self.table("terms").select(F.col("term").alias("key"), "df").join(single.withColumnRenamed("term", "key"), "key", "left_semi")
        df = df.unionByName(self._phrase_hits(longer).groupBy("key").agg(F.count(F.lit(1)).alias("df")))
        weights = named.join(df, "key").select("query_id", "key", (F.col("times") * idf(F.lit(self.n), F.col("df"))).alias("w"))
        part = F.col("w") * term_score(F.col("tf"), F.col("dl"), F.lit(self.avgdl))
        got = (
            hits.join(weights, "key")
            .groupBy("query_id", "chunk_id")
            # Parts add up as integers of 1e-12, which no order of rows can change.
            .agg(F.sum((part * 1e12).cast("bigint")).alias("parts"), F.count(F.lit(1)).alias("hits"))
            .withColumn("bm25", -F.col("parts") / F.lit(1e12))
        )
        if mode == "all":
            got = got.join(named.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id").where(F.col("hits") == F.col("n"))
        return got.select("query_id", "chunk_id", "bm25")


def filtered(
    chunks: DataFrame, path: str | None = None, extension: str | None = None, artifact: str | None = None, statuses: Sequence[str] | None = None
) -> DataFrame:
    """Search filters: a path glob, a file extension (any ASCII case), an artifact by id or path, a set of statuses."""
    if path is not None:
        chunks = chunks.where(F.col("path").rlike(sqlite_glob(path)))
    if extension is not None:
        chunks = chunks.where(F.lower("path").endswith("." + extension.lstrip(".").lower()))
    if artifact is not None:
        chunks = chunks.where((F.col("artifact_id") == artifact) | (F.col("path") == artifact))
    if statuses is not None:
        chunks = chunks.where(F.col("status").isin(*statuses))
    return chunks


def top_k(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best of a scored set, ties by the given columns then chunk id."""
    return scored.orderBy("bm25", *ties, "chunk_id").limit(k)


def fetched(chunks: DataFrame, best: Sequence) -> DataFrame:
    """The rows of a few best chunks (at most a search's depth) with their ``bm25``, in one partition of a session made for
    so few: what ranks them afterwards needs no exchange and no compiled code."""
    score = {r["chunk_id"]: r["bm25"] for r in best}
    found = chunks.where(F.col("chunk_id").isin(list(score)) if score else F.lit(False)).toArrow()
    found = found.append_column("bm25", pa.array([score[c] for c in found.column("chunk_id").to_pylist()], pa.float64()))
    schema = StructType([*chunks.schema.fields, StructField("bm25", DoubleType())])
    return small_session(chunks.sparkSession).createDataFrame(found, schema).coalesce(1)


SNIPPET_TERMS = 20


def snippet(body: Column, phrases: Sequence[Sequence[str]]) -> Column:
    """About 20 words of the body around its first hit, hits in brackets. By contract approximate."""
    words = F.split(F.coalesce(body, F.lit("")), r"\s+")
    wanted = [t for p in phrases for t in p]
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]+", ""))
    hit = F.array_position(F.transform(plain, lambda w: w.isin(*wanted) if wanted else F.lit(False)), True)
    start = F.greatest(hit - SNIPPET_TERMS // 2, F.lit(1)).cast("int")
    window = F.slice(words, start, SNIPPET_TERMS)
    marked = F.transform(
        window, lambda w: F.when(F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]+", "").isin(*wanted), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w) if wanted else w
    )
    head = F.when(start > 1, " ... ").otherwise("")
    tail = F.when(start + SNIPPET_TERMS - 1 < F.size(words), " ... ").otherwise("")
    return F.concat(head, F.array_join(marked, " "), tail)
