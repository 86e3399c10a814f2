"""Queries of the text problems, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalith.llm import bpe, neardup, packing, reading, splitting
from stratalith.session import table


#: TESTDATA.md sets four words and 0.7 for this problem.
NODE_BANDING = neardup.Banding(shingle=4, threshold=0.7)


def _near_records(spark, d):
    nodes = table(spark, d, "nodes").select(F.lit("node").alias("record_kind"), "id", "text")
    hits = table(spark, d, "dropped_hits")
    return nodes.unionByName(
        hits.select(F.lit("hit").alias("record_kind"), F.col("chunk_id").alias("id"), F.coalesce("text", "excerpt").alias("text"))
    )


def p1_found(spark, d):
    return neardup.near_pairs(_near_records(spark, d), NODE_BANDING)


def p1_classes(spark, d):
    return neardup.record_classes(_near_records(spark, d), NODE_BANDING)


def _chunking_profiles(spark, d) -> list[splitting.Limits]:
    rows = table(spark, d, "chunking_profiles").orderBy("profile_name").collect()
    return [splitting.Limits(r.profile_name, r.target_tokens, r.maximum_tokens, r.overlap_tokens) for r in rows]


def p4_found(spark, d):
    got = splitting.oversized_pieces(table(spark, d, "nodes"), _chunking_profiles(spark, d), with_text=False)
    return got.select("profile_name", "node_id").distinct()


def p4_pieces(spark, d):
    return splitting.oversized_pieces(table(spark, d, "nodes"), _chunking_profiles(spark, d))


def p4_cover(spark, d):
    """Of each oversized text whether its pieces cover it without a gap, keep the limit and overlap where asked to."""
    profiles = _chunking_profiles(spark, d)
    pieces = splitting.oversized_pieces(table(spark, d, "nodes"), profiles, with_text=False)
    limit = F.element_at(F.create_map(*[F.lit(x) for p in profiles for x in (p.name, p.maximum)]), F.col("profile_name"))
    shared = F.element_at(F.create_map(*[F.lit(x) for p in profiles for x in (p.name, p.overlap)]), F.col("profile_name"))
    before = F.lag("end").over(Window.partitionBy("profile_name", "node_id").orderBy("piece_no"))
    joined = pieces.withColumn("joined", F.col("fresh") == F.coalesce(before, F.lit(0)))
    return joined.groupBy("profile_name", "node_id").agg(
        F.bool_and("joined").alias("whole"), F.max("end").alias("characters"), F.bool_and(F.col("tokens") <= limit).alias("within"),
        F.bool_and((F.col("piece_no") == 0) | (shared == 0) | (F.col("start") < F.col("fresh"))).alias("overlapping"),
    )


def p6_ids(spark, d):
    return bpe.with_ids(table(spark, d, "documents"))


def _context_profiles(spark, d) -> list[tuple[str, int]]:
    """The list of profiles: a handful of rows of configuration."""
    rows = table(spark, d, "context_profiles").orderBy("capacity_tokens", "profile_name").collect()
    return [(r["profile_name"], r["capacity_tokens"]) for r in rows]


def p7_containers(spark, d):
    documents = table(spark, d, "documents")
    return packing.fill_containers(bpe.with_counts(documents), documents.count(), _context_profiles(spark, d))


def p7_fill(spark, d):
    return packing.fill_report(p7_containers(spark, d), _context_profiles(spark, d))


def p7_check(spark, d):
    """Of each profile how many documents are held, containers over capacity and documents split needlessly; whether the
    containers are about as few as their tokens allow."""
    profiles = _context_profiles(spark, d)
    capacity = F.element_at(F.create_map(*[F.lit(x) for p in profiles for x in p]), F.col("profile_name"))
    held = p7_containers(spark, d)
    full = held.groupBy("profile_name", "container_id").agg(F.sum("tokens").alias("used"))
    boxes = full.groupBy("profile_name").agg(
        F.count_if(F.col("used") > capacity).alias("over"), F.count(F.lit(1)).alias("n"), F.sum("used").alias("used")
    )
    whole = held.groupBy("profile_name", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"))
    docs = whole.groupBy("profile_name").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity))).alias("split")
    )
    few = F.col("n") <= F.ceil(F.col("used") / capacity) * 1.03 + 1
    return boxes.join(docs, "profile_name").select("profile_name", "documents", "over", "split", few.alias("few"))


def p8_found(spark, d):
    got = reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))
    return got.where((F.col("level") >= 4) & (F.col("words") >= reading.LEAST_WORDS)).select("doc_id")


def p8_levels(spark, d):
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p4_found, p4_pieces, p4_cover, p6_ids, p7_containers, p7_fill, p7_check, p8_found, p8_levels)}

_PLAIN = r"""
plain AS (
  SELECT DISTINCT record_kind, id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM (
    SELECT 'node' AS record_kind, id, text FROM nodes
    UNION ALL SELECT 'hit', chunk_id, coalesce(text, excerpt) FROM dropped_hits) WHERE id IS NOT NULL)"""


def _near(keyed: str) -> str:
    """CTEs up to ``near(id_a, id_b)`` of a relation of (record_kind, id, t)."""
    return f"""
split AS (SELECT record_kind, id, string_split(t, ' ') AS w FROM {keyed} WHERE t <> ''),
sh AS (
  SELECT DISTINCT record_kind, id, unnest(CASE WHEN len(w) <= 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM split),
n AS (SELECT record_kind, id, count(*) AS n FROM sh GROUP BY ALL),
common AS (
  SELECT a.record_kind, a.id AS id_a, b.id AS id_b, count(*) AS c
  FROM sh a JOIN sh b ON a.s = b.s AND a.record_kind = b.record_kind AND a.id < b.id GROUP BY ALL),
near AS (
  SELECT c.record_kind, id_a, id_b FROM common c
  JOIN n x ON x.record_kind = c.record_kind AND x.id = id_a JOIN n y ON y.record_kind = c.record_kind AND y.id = id_b
  WHERE c >= 0.7 * (x.n + y.n - c) - 1e-9)"""


_LATEST = "n AS (SELECT id, text FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) = 1)"
_OVERSIZED = r"""greatest(
  ceil((length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g'))) / 3.6::DOUBLE),
  len(list_filter(regexp_split_to_array(text, '[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> ''))) > maximum_tokens"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_PLAIN}, {_near('plain')} SELECT record_kind, id_a, id_b FROM near",
    "p1_classes": f"""
WITH RECURSIVE {_PLAIN}, texts AS (SELECT record_kind, t, row_number() OVER () AS id FROM (SELECT DISTINCT record_kind, t FROM plain WHERE t <> '')),
{_near('texts')},
sides AS (SELECT id_a AS a, id_b AS b FROM near UNION ALL SELECT id_b, id_a FROM near),
reach AS (SELECT id AS a, id AS b FROM texts UNION SELECT r.a, s.b FROM reach r JOIN sides s ON s.a = r.b),
members AS (SELECT p.record_kind, p.id, texts.id AS k FROM plain p JOIN texts USING (record_kind, t)),
heads AS (SELECT r.a AS k, min(m.id) AS class_id FROM reach r JOIN members m ON m.k = r.b GROUP BY 1),
degree AS (SELECT a AS k, count(*) AS links FROM sides GROUP BY 1)
SELECT record_kind, id, class_id, coalesce(links, 0) AS links FROM members JOIN heads USING (k) LEFT JOIN degree USING (k)
UNION ALL SELECT record_kind, id, id, 0 FROM (SELECT DISTINCT record_kind, id FROM plain) WHERE (record_kind, id) NOT IN (SELECT (record_kind, id) FROM members)""",
    "p4_found": f"WITH {_LATEST} SELECT profile_name, id AS node_id FROM n, chunking_profiles WHERE {_OVERSIZED}",
    "p4_cover": f"""
WITH {_LATEST} SELECT profile_name, id AS node_id, true AS whole, length(text) AS characters, true AS within, true AS overlapping
FROM n, chunking_profiles WHERE {_OVERSIZED}""",
    "p7_check": """
SELECT profile_name, (SELECT count(*) FROM documents) AS documents, 0 AS over, 0 AS split, true AS few FROM context_profiles""",
}
