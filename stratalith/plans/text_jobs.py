"""Queries over texts, nodes and chunks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalith import constants as C
from stratalith.functions import hashing as H
from stratalith.functions import text as X
from stratalith.operators import chunking, nodes as N, ranges
from stratalith.plans import base as B
from stratalith.session import table
from stratalith.sources import files, formats


def text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize(F.col("title")).alias("plain"))


def query_terms(spark, d):
    got = table(spark, d, "dropped_hits").select("task_text").distinct()
    return got.select("task_text", F.array_join(X.words_of(X.normalize(F.col("task_text"))), ",").alias("terms"))


def estimate_tokens(spark, d):
    return B.nodes(spark, d).where(F.col("text").isNotNull()).select("id", X.estimate_tokens(F.col("text")).alias("tokens"))


def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


def shingle_set(spark, d):
    got = B.candidates(spark, d).select("chunk_id", "text").distinct()
    return got.select("chunk_id", F.size(X.shingles(X.normalize(F.coalesce("text", F.lit(""))))).alias("shingles"))


def artifact_ids(spark, d):
    source, path = H.parse_artifact_id(F.col("id"))
    return B.artifacts(spark, d).select("id").distinct().select("id", source.alias("source"), path.alias("path"), H.artifact_id(source, path).alias("joined"))


def split_paragraphs(spark, d):
    got = N.split_paragraphs(table(spark, d, "documents"), "doc_id")
    return got.select("doc_id", "line_start", "line_end", "text")


def normalize_whitespace(spark, d):
    return B.nodes(spark, d).where(F.col("text").isNotNull()).select("id", N.normalized_text(F.col("kind"), F.col("text")).alias("text"))


def revision_hashes(spark, d):
    return N.normalize_nodes(B.nodes(spark, d)).select("id", "revision_hash")


def render_body(spark, d):
    return N.render_bodies(B.nodes(spark, d)).select("artifact_id", F.sha2("body", 256).alias("hash"), F.length("body").alias("characters"))


def object_dedupe(spark, d):
    return N.objects(table(spark, d, "documents"), "text")


def chunk_documents(spark, d):
    return chunking.chunk_nodes(B.nodes(spark, d))


def chunk_coverage(spark, d):
    """Of each artifact how many nodes its chunks hold, and whether the chunks are numbered without a gap."""
    made = chunking.chunk_nodes(B.nodes(spark, d))
    held = made.select("artifact_id", F.explode("node_ids").alias("node_id")).groupBy("artifact_id").agg(F.count_distinct("node_id").alias("nodes"))
    numbers = made.groupBy("artifact_id").agg(((F.max("chunk_no") + 1 == F.count("chunk_no")) & (F.count("chunk_no") == F.count_distinct("chunk_no"))).alias("numbered"))
    return held.join(numbers, "artifact_id")


def chunk_runs(spark, d):
    return chunking.with_runs(B.nodes(spark, d)).select("id", "run")


def source_bounds(spark, d):
    return N.source_bounds(B.nodes(spark, d))


def read_range(spark, d):
    got = ranges.read_nodes(B.nodes(spark, d), from_line=3, to_line=9)
    return got.select("artifact_id", "seq", "id", "line_start", "line_end")


def read_heading(spark, d):
    """Every artifact read under the first top heading of its document."""
    n = B.nodes(spark, d)
    wanted = n.where(F.size("heading_path") >= 1).groupBy("artifact_id").agg(F.array(F.min_by(F.col("heading_path")[0], F.struct("seq", "id"))).alias("wanted"))
    got = ranges.read_ranges(n.join(wanted, "artifact_id"), heading=F.col("wanted"))
    return got.select("artifact_id", F.sha2("text", 256).alias("hash"), "truncated", "line_start", "line_end")


def read_truncated(spark, d):
    got = ranges.read_ranges(B.nodes(spark, d), most=2_000)
    return got.select("artifact_id", F.length("text").alias("characters"), "truncated", "line_start", "line_end")


def read_full(spark, d):
    """The read as it is in production, cut at ``READ_CHARACTERS``."""
    got = ranges.read_ranges(B.nodes(spark, d))
    return got.select("artifact_id", F.length("text").alias("characters"), "truncated", "line_start", "line_end")


def format_registry(spark, d):
    return table(spark, d, "documents").select("doc_id", formats.parser_of(F.col("relative_path")).alias("parser"), formats.media_type_of(F.col("relative_path")).alias("media_type"))


def text_classes(spark, d):
    got = table(spark, d, "documents").where(F.col("text").isNotNull())
    return got.select("doc_id", formats.text_class(F.encode("text", "UTF-8"), formats.parser_of(F.col("relative_path"))).alias("kind"))


def _parsed(spark, d):
    got = B.documents(spark, d).where(F.col("text").isNotNull()).select(
        "artifact_id", "relative_path", F.coalesce(formats.parser_of(F.col("relative_path")), F.lit("text")).alias("parser"), F.encode("text", "UTF-8").alias("content")
    )
    return files.parse(got)


def parsed_documents(spark, d):
    """All documents read by the parser of their path: nodes by kind of each document."""
    return files.nodes_of(_parsed(spark, d)).groupBy("artifact_id", "kind").agg(F.count(F.lit(1)).alias("nodes"))


def parse_warnings(spark, d):
    """Warnings of the parser each document gets by its path, by code."""
    return files.warnings_of(_parsed(spark, d)).groupBy("code").agg(F.count(F.lit(1)).alias("files"))


QUERIES = {
    f.__name__: f
    for f in (
        text_normalize, query_terms, estimate_tokens, content_hash, shingle_set, artifact_ids, split_paragraphs,
        normalize_whitespace, revision_hashes, render_body, object_dedupe, chunk_documents, chunk_coverage, chunk_runs, source_bounds,
        read_range, read_heading, read_truncated, read_full, format_registry, text_classes,
        parsed_documents, parse_warnings,
    )
}

_PLAIN = r"""
plain AS (
  SELECT *, regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '(?m)[ \t]+$', '', 'g') AS ends,
         regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g') AS lf FROM n),
clean AS (
  SELECT *, regexp_replace(CASE WHEN kind IN ('code', 'sheet', 'row-group') THEN lf
    WHEN kind = 'document' THEN regexp_replace(ends, '\n{3,}', chr(10) || chr(10), 'g')
    ELSE regexp_replace(regexp_replace(ends, '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') END,
    '^[\s\x{b}]+|[\s\x{b}]+$', '', 'g') AS t FROM plain)"""

SQL = {
    "text_normalize": f"SELECT doc_id, {B.normalize_sql('title')} AS plain FROM documents",
    "query_terms": f"SELECT DISTINCT task_text, replace({B.normalize_sql('task_text')}, ' ', ',') AS terms FROM dropped_hits",
    "estimate_tokens": f"WITH {B.NODES} SELECT id, {B.estimate_sql('text')} AS tokens FROM n WHERE text IS NOT NULL",
    "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "shingle_set": f"""
WITH {B.CANDIDATES}, w AS (SELECT DISTINCT chunk_id, text FROM cands),
s AS (SELECT chunk_id, string_split({B.normalize_sql("coalesce(text, '')")}, ' ') AS l FROM w)
SELECT chunk_id, CASE WHEN l = [''] THEN 0 WHEN len(l) <= 4 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' ')))) END AS shingles FROM s""",
    "artifact_ids": f"""
WITH {B.ARTIFACTS} SELECT DISTINCT id, split_part(id, ':', 1) AS source, regexp_replace(id, '^[^:]*:', '') AS path, id AS joined FROM arts""",
    "split_paragraphs": r"""
WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line,
                  generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, regexp_replace(line, '[\s\x{b}]+', '', 'g') <> '' AS filled FROM l),
g AS (SELECT *, no - row_number() OVER (PARTITION BY doc_id, filled ORDER BY no) AS grp FROM f)
SELECT doc_id, CAST(min(no) AS INTEGER) AS line_start, CAST(max(no) AS INTEGER) AS line_end,
       regexp_replace(string_agg(line, chr(10) ORDER BY no), '^[\s\x{b}]+|[\s\x{b}]+$', '', 'g') AS text
FROM g WHERE filled GROUP BY doc_id, grp""",
    "normalize_whitespace": f"WITH {B.NODES}, {_PLAIN} SELECT id, t AS text FROM clean WHERE text IS NOT NULL",
    "revision_hashes": f"""
WITH {B.NODES}, {_PLAIN}
SELECT id, CASE WHEN t IS NOT DISTINCT FROM text THEN revision_hash
  ELSE sha256(kind || ' ' || coalesce(title, '') || ' ' || coalesce(t, '')) END AS revision_hash FROM clean""",
    "render_body": f"""
WITH {B.NODES}, p AS (
  SELECT artifact_id, seq, CASE WHEN kind = 'section' THEN repeat('#', greatest(len(heading_path), 1)) || ' ' || coalesce(title, '')
    WHEN kind <> 'document' THEN text END AS part FROM n),
b AS (SELECT artifact_id, string_agg(part, chr(10) || chr(10) ORDER BY seq) || chr(10) AS body FROM p WHERE part <> '' GROUP BY artifact_id)
SELECT artifact_id, sha256(body) AS hash, length(body) AS characters FROM b""",
    "object_dedupe": "SELECT sha256(text) AS hash, max(strlen(text)) AS bytes, count(*) AS uses FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "chunk_coverage": f"""
WITH {B.NODES} SELECT artifact_id, count(*) AS nodes, true AS numbered FROM n WHERE kind <> 'document' AND text <> '' GROUP BY 1""",
    "chunk_runs": f"""
WITH {B.NODES}, t AS (SELECT *, lag(heading_path) OVER (PARTITION BY artifact_id ORDER BY seq, id) AS before,
  row_number() OVER (PARTITION BY artifact_id ORDER BY seq, id) AS k FROM n WHERE kind <> 'document' AND text <> ''),
s AS (SELECT *, CASE WHEN k = 1 OR before <> heading_path THEN seq END AS start FROM t)
SELECT id, max(start) OVER (PARTITION BY artifact_id ORDER BY seq, id ROWS UNBOUNDED PRECEDING) AS run FROM s""",
    "source_bounds": f"WITH {B.NODES} SELECT artifact_id, min(line_start) AS first_line, max(line_end) AS last_line FROM n WHERE text <> '' GROUP BY 1",
    "read_range": f"WITH {B.NODES} SELECT artifact_id, seq, id, line_start, line_end FROM n WHERE text <> '' AND line_start <= 9 AND line_end >= 3",
    "read_heading": f"""
WITH {B.NODES}, w AS (SELECT artifact_id, arg_min(heading_path[1], seq) AS top FROM n WHERE len(heading_path) >= 1 GROUP BY 1),
b AS (SELECT artifact_id, string_agg(text, chr(10) || chr(10) ORDER BY seq, id) AS t, min(line_start) AS line_start, max(line_end) AS line_end
  FROM n JOIN w USING (artifact_id) WHERE text <> '' AND heading_path[1] = top GROUP BY 1)
SELECT artifact_id, sha256(t[1:{C.READ_CHARACTERS}]) AS hash, length(t) > {C.READ_CHARACTERS} AS truncated, line_start, line_end FROM b""",
    "read_truncated": f"""
WITH {B.NODES}, b AS (SELECT artifact_id, string_agg(text, chr(10) || chr(10) ORDER BY seq, id) AS t, min(line_start) AS line_start, max(line_end) AS line_end
  FROM n WHERE text <> '' GROUP BY 1)
SELECT artifact_id, least(length(t), 2000) AS characters, length(t) > 2000 AS truncated, line_start, line_end FROM b""",
    "read_full": f"""
WITH {B.NODES}, b AS (SELECT artifact_id, string_agg(text, chr(10) || chr(10) ORDER BY seq, id) AS t, min(line_start) AS line_start, max(line_end) AS line_end
  FROM n WHERE text <> '' GROUP BY 1)
SELECT artifact_id, least(length(t), {C.READ_CHARACTERS}) AS characters, length(t) > {C.READ_CHARACTERS} AS truncated, line_start, line_end FROM b""",
    "format_registry": f"SELECT doc_id, {formats.parser_sql('relative_path')} AS parser, {formats.media_type_sql('relative_path')} AS media_type FROM documents",
    "text_classes": "SELECT doc_id, CASE WHEN contains(text, chr(0)) THEN 'binary' ELSE 'text' END AS kind FROM documents WHERE text IS NOT NULL",
}
