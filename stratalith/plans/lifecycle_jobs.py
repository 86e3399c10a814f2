"""Queries of rules, lifecycle and typed tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratalith.functions import hashing as H
from stratalith.functions.globs import IgnoreRule, ignore_regex, path_glob
from stratalith.operators import lifecycle as L
from stratalith.operators import rules as R
from stratalith.operators import tables as T
from stratalith.plans import base as B
from stratalith.session import shared_folder, table
from stratalith.sources import delimited
from stratalith.streaming.windows import windowed_counts

#: Example configuration: the rules a project of this corpus would declare.
RULES = (
    R.Rule("archive/**", status="archived", authority=20),
    R.Rule("**/*.csv", authority=35),
    R.Rule("notes/drafts/**", status="draft"),
    R.Rule("guides/**", authority=80, supersedes=("archive/*lern*", "notes/current/*")),
    R.Rule("guides/**/*.md", supersedes=("archive/*.md",), replace=True),
    R.Rule("missing/**", authority=90),
)
IGNORES = (
    IgnoreRule("archive/"), IgnoreRule("*.pdf"), IgnoreRule("manifest*.pdf", negated=True), IgnoreRule("notes/**"),
    IgnoreRule("/data/*.csv", source="project"),
)


def _now(spark, d):
    return L.of_build(B.artifacts(spark, d), B.sealed_builds(spark, d)[-1]).withColumn("artifact_id", F.col("id"))


def _pair(spark, d):
    a = B.artifacts(spark, d)
    before, after = B.last_two(spark, d)
    return L.of_build(a, before), L.of_build(a, after)


def resolve_rules(spark, d):
    got = R.resolve_scalars(_now(spark, d).drop("status", "authority"), RULES)
    return got.select("artifact_id", "status", "authority", F.array_join(F.transform("matched_rules", lambda x: x.cast("string")), ",").alias("matched"))


def rule_supersessions(spark, d):
    return R.supersessions(_now(spark, d), RULES)


def unmatched_rules(spark, d):
    return R.unmatched_rules(_now(spark, d), RULES)


def supersession_flags(spark, d):
    """How many artifacts of the last build supersede each one."""
    now = _now(spark, d)
    edges = now.select(F.col("artifact_id").alias("by"), F.explode("supersedes").alias("artifact_id")).distinct()
    counts = edges.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("superseded_by"))
    return now.select("artifact_id").join(counts, "artifact_id", "left").select("artifact_id", F.coalesce("superseded_by", F.lit(0)).alias("superseded_by"))


def supersession_cycles(spark, d):
    edges = _now(spark, d).select("artifact_id", F.explode("supersedes").alias("superseded_id"))
    return R.cyclic(edges)


def supersession_conflicts(spark, d):
    """Artifacts on or between cycles if those that are superseded though their authority is higher struck back."""
    now = _now(spark, d)
    edges = now.select("artifact_id", "authority", F.explode("supersedes").alias("superseded_id"))
    other = now.select(F.col("artifact_id").alias("superseded_id"), F.col("authority").alias("theirs"))
    back = edges.join(other, "superseded_id").where("theirs >= authority").select(F.col("superseded_id").alias("artifact_id"), F.col("artifact_id").alias("superseded_id"))
    return R.cyclic(edges.select("artifact_id", "superseded_id").unionByName(back))


def superseded_lists(spark, d):
    """What each artifact of the last build supersedes, in one text."""
    now = _now(spark, d)
    edges = now.select("artifact_id", F.explode("supersedes").alias("superseded_id")).distinct()
    return edges.groupBy("artifact_id").agg(F.array_join(F.array_sort(F.collect_list("superseded_id")), ",").alias("supersedes"))


def declared_only(spark, d):
    """Artifacts of the last build whose declared fields aren't the defaults."""
    return _now(spark, d).where("status <> 'active' OR authority <> 50 OR size(supersedes) > 0").select("artifact_id", "status", "authority")


def freed_bytes(spark, d):
    """Nodes' bytes of artifacts that only builds about to go hold."""
    gone = unreferenced_objects(spark, d)
    held = B.artifacts(spark, d).select("id", F.col("content_hash").alias("hash")).join(gone, "hash", "left_semi").select(F.col("id").alias("artifact_id")).distinct()
    sizes = B.nodes(spark, d).groupBy("artifact_id").agg(F.sum(F.octet_length("text")).alias("bytes"))
    return held.join(sizes, "artifact_id").agg(F.count(F.lit(1)).alias("artifacts"), F.sum("bytes").alias("bytes"))


def preflight_sizes(spark, d):
    """What projecting the texts would write, held against the limits."""
    texts = B.nodes(spark, d).select(F.lit("nodes").alias("entity"), F.octet_length("text").alias("bytes"))
    return L.preflight(texts.unionByName(table(spark, d, "documents").select(F.lit("documents").alias("entity"), F.octet_length("text").alias("bytes"))))


def supersession_missing(spark, d):
    now = _now(spark, d)
    edges = now.select("artifact_id", F.explode("supersedes").alias("superseded_id")).distinct()
    return L.supersession_targets(edges, now).select("artifact_id", "superseded_id")


def fingerprint_compare(spark, d):
    return L.full_compare(*_pair(spark, d), "relative_path", "content_hash").select("relative_path", "change")


def plan_summary(spark, d):
    return L.plan(*_pair(spark, d))


def hash_roots(spark, d):
    a = B.artifacts(spark, d).select("build_id", F.sha2(F.concat_ws(" ", "relative_path", "content_hash"), 256).alias("member_hash"))
    return H.hash_roots(a, by=["build_id"])


def tree_roots(spark, d):
    """Roots of all nodes of each artifact."""
    return H.hash_roots(B.nodes(spark, d).select("artifact_id", F.col("revision_hash").alias("member_hash")), by=["artifact_id"])


def diff_artifacts(spark, d):
    return L.diff_artifacts(*_pair(spark, d))


def diff_chunks(spark, d):
    rows = L.latest_rows(table(spark, d, "snapshot_chunks"), ["build_id", "id"])
    before, after = B.last_two(spark, d)
    plain = rows.withColumn("revision_hash", L.plain_hash(F.col("revision_hash")))
    return L.full_compare(L.of_build(plain, before), L.of_build(plain, after), "id", "revision_hash").groupBy("change").agg(F.count(F.lit(1)).alias("chunks"))


def diff_rules(spark, d):
    return L.diff_rules(*_pair(spark, d))


def diff_tables(spark, d):
    rows = L.latest_rows(table(spark, d, "snapshot_tables"), ["build_id", "table_id"])
    before, after = B.last_two(spark, d)
    return L.diff_tables(L.of_build(rows, before), L.of_build(rows, after))


def validate_nodes(spark, d):
    return L.integrity(B.nodes(spark, d))


def validate_without_sections(spark, d):
    """The same checks where sections have been lost: what lay under them has no parent any more."""
    return L.integrity(B.nodes(spark, d).where("kind <> 'section'"))


def validate_chunks(spark, d):
    chunks = L.latest_rows(table(spark, d, "snapshot_chunks"), ["build_id", "id"])
    return L.chunk_integrity(chunks, B.artifacts(spark, d))


def retention_plan(spark, d):
    return L.retention(table(spark, d, "builds"), keep=3)


def unreferenced_objects(spark, d):
    refs = B.artifacts(spark, d).select("build_id", F.col("content_hash").alias("hash")).distinct()
    return L.unreferenced(refs, L.retention(table(spark, d, "builds"), keep=3))


def build_history(spark, d):
    return L.build_history(table(spark, d, "builds"))


def case_collisions(spark, d):
    return L.case_collisions(B.artifacts(spark, d))


def exclusion_report(spark, d):
    return L.exclusions(B.artifacts(spark, d).select("relative_path").distinct(), IGNORES)


def artifact_counts(spark, d):
    """Every artifact of the last build with its numbers of nodes and chunks of text."""
    n = B.nodes(spark, d).groupBy("artifact_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("text") != "").alias("texts"))
    return _now(spark, d).select("artifact_id").join(n, "artifact_id", "left").select("artifact_id", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("texts", F.lit(0)).alias("texts"))


def build_counts(spark, d):
    """Rows of each build in the snapshot tables."""
    def count(name, key, label):
        return table(spark, d, name).groupBy("build_id").agg(F.count_distinct(key).alias("n")).select("build_id", F.lit(label).alias("entity"), "n")

    return count("snapshot_artifacts", "id", "artifacts").unionByName(count("snapshot_chunks", "id", "chunks")).unionByName(count("snapshot_tables", "table_id", "tables"))


_PRICE = ["sku", "list_price", "currency", "discontinued", "valid_from", "owner_team"]


def _price_cells(spark, d):
    rows = table(spark, d, "price_rows")
    latest = F.max_by(F.struct(*_PRICE), F.struct("loaded_at", F.xxhash64(*_PRICE))).alias("r")
    once = rows.groupBy("build_id", "table_id", "row_no").agg(latest).select("build_id", "table_id", "row_no", "r.*")
    return T.long_cells(once, ["build_id", "table_id", "row_no"], _PRICE)


def infer_types(spark, d):
    return _price_cells(spark, d).groupBy("build_id", "table_id", "ordinal", "column_name").agg(T.infer_type().alias("type"))


def types_widened(spark, d):
    return T.type_widened(_price_cells(spark, d), ["build_id", "table_id"], "row_no")


def types_widened_early(spark, d):
    """The same with a head of 20 rows instead of a thousand."""
    return T.type_widened(_price_cells(spark, d), ["build_id", "table_id"], "row_no", sample=20)


def column_stats(spark, d):
    return T.column_statistics(_price_cells(spark, d).drop("row_no"), ["build_id", "table_id"])


def relation_stats(spark, d):
    """The same statistics over a relational table whose cells are cast to text first."""
    cells = T.long_cells(table(spark, d, "lineitem"), [], ["l_returnflag", "l_linenumber", "l_quantity", "l_linestatus"])
    return T.column_statistics(cells, [])


def list_tables(spark, d):
    rows = L.latest_rows(table(spark, d, "snapshot_tables"), ["build_id", "table_id"])
    last = L.of_build(rows, B.sealed_builds(spark, d)[-1])
    return T.sql_names(last).select("table_id", "table_name", "sql_name", "row_count", F.size("column_names").alias("columns"))


def describe_tables(spark, d):
    stats = column_stats(spark, d)
    rows = table(spark, d, "price_rows").select("build_id", "table_id", "row_no").distinct().groupBy("build_id", "table_id").agg(F.count(F.lit(1)).alias("rows"))
    return T.describe(stats.join(rows, ["build_id", "table_id"]), ["build_id", "table_id"], F.col("rows"))


def column_names(spark, d):
    rows = table(spark, d, "snapshot_tables").select("column_names").distinct().select(F.posexplode("column_names").alias("ordinal", "column_name"))
    return T.column_sql_names(rows.distinct())


def detect_delimiters(spark, d):
    return delimited.detect_delimiters(table(spark, d, "segment_lines"))


def stream_windows(spark, d):
    """Counts of the events by type and ten-minute window, taken as a stream that ends with what is there."""
    batch = table(spark, d, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # The whole result of each micro-batch replaces the one before.
    counted = windowed_counts(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{root}/offsets")
    counted.foreachBatch(lambda got, _: got.write.mode("overwrite").parquet(f"{root}/counts")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{root}/counts")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "events", F.round("total", 6).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        stream_windows, resolve_rules, rule_supersessions, unmatched_rules, supersession_flags, supersession_cycles, supersession_conflicts, superseded_lists, declared_only, freed_bytes, preflight_sizes, supersession_missing,
        fingerprint_compare, plan_summary, hash_roots, tree_roots, diff_artifacts, diff_chunks, diff_rules, diff_tables,
        validate_nodes, validate_without_sections, validate_chunks, retention_plan, unreferenced_objects, build_history, case_collisions,
        exclusion_report, artifact_counts, build_counts, infer_types, types_widened, types_widened_early, column_stats, relation_stats,
        list_tables, describe_tables, column_names, detect_delimiters,
    )
}


def _hit(r: R.Rule) -> str:
    return f"regexp_matches(relative_path, '{path_glob(r.match)}')"


def _last(field: str, default: str, quote: str = "") -> str:
    whens = "".join(f" WHEN {_hit(r)} THEN {quote}{getattr(r, field)}{quote}" for r in reversed(RULES) if getattr(r, field) is not None)
    return f"CASE{whens} ELSE {default} END"


_CELLS = """
once AS (SELECT DISTINCT build_id, table_id, row_no, sku, list_price, currency, discontinued, valid_from, owner_team FROM price_rows),
cells AS (
  SELECT build_id, table_id, row_no, unnest([1, 2, 3, 4, 5, 6]) AS ordinal,
         unnest(['sku', 'list_price', 'currency', 'discontinued', 'valid_from', 'owner_team']) AS column_name,
         unnest([sku, list_price, currency, discontinued, valid_from, owner_team]) AS cell FROM once)"""


def _typed(cells: str = "cells") -> str:
    return rf"""
judged AS (
  SELECT *, CASE WHEN lower(plain) IN ('', 'null', 'n/a', 'na') THEN NULL ELSE plain END AS v
  FROM (SELECT *, regexp_replace(cell, '^{B.SPACE}|{B.SPACE}$', '', 'g') AS plain FROM {cells})),
tests AS (
  SELECT *, lower(v) IN ('true', 'false') AS b,
    regexp_full_match(v, '\d{{4}}-\d{{2}}-\d{{2}}([T ]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?(Z|[+-]\d{{2}}:?\d{{2}})?)?') AND TRY_CAST(v[1:10] AS DATE) IS NOT NULL AS dt,
    regexp_full_match(v, '-?(0|[1-9]\d{{0,15}})') AND abs(TRY_CAST(v AS HUGEINT)) <= 9007199254740991 AS i,
    regexp_full_match(v, '-?(0|[1-9]\d*)?(\.\d+)?([eE][+-]?\d+)?') AND regexp_matches(v, '\d') AND NOT regexp_matches(v, '^-?[eE]')
      AND TRY_CAST(v AS DOUBLE) IS NOT NULL AND (NOT regexp_full_match(v, '-?\d+')
      OR (regexp_full_match(v, '-?(0|[1-9]\d{{0,15}})') AND abs(TRY_CAST(v AS HUGEINT)) <= 9007199254740991)) AS r FROM judged)"""


_TYPE = "CASE WHEN count(v) = 0 THEN 'unknown' WHEN bool_and(b) FILTER (v IS NOT NULL) THEN 'boolean' WHEN bool_and(dt) FILTER (v IS NOT NULL) THEN 'date' WHEN bool_and(i) FILTER (v IS NOT NULL) THEN 'integer' WHEN bool_and(r) FILTER (v IS NOT NULL) THEN 'real' ELSE 'text' END"


def _stats_sql(keys: str) -> str:
    k = keys
    return f"""
SELECT {k}ordinal, column_name, type, nulls > 0 AS nullable, nulls AS null_count, least(d, 10000) AS distinct_estimate, d <= 10000 AS distinct_is_exact,
  CASE WHEN type IN ('integer', 'real') THEN mn.b ELSE mt END AS min_value, CASE WHEN type IN ('integer', 'real') THEN mx.b ELSE xt END AS max_value
FROM (SELECT {k}ordinal, column_name, {_TYPE} AS type, count(*) - count(v) AS nulls, count(DISTINCT v) AS d,
        min(struct_pack(a := TRY_CAST(v AS DOUBLE), b := v)) FILTER (r) AS mn, max(struct_pack(a := TRY_CAST(v AS DOUBLE), b := v)) FILTER (r) AS mx,
        min(v) AS mt, max(v) AS xt FROM tests GROUP BY {k}ordinal, column_name)"""


def _widened_sql(sample: int) -> str:
    return f"""
WITH {_CELLS}, {_typed()}, w AS (SELECT build_id, table_id, ordinal, column_name, {_TYPE} AS type FROM tests GROUP BY ALL),
h AS (SELECT build_id, table_id, ordinal, column_name, {_TYPE} AS sample_type FROM tests WHERE row_no <= {sample} GROUP BY ALL)
SELECT build_id, table_id, ordinal, column_name, sample_type, type FROM h JOIN w USING (build_id, table_id, ordinal, column_name) WHERE sample_type <> type"""


_TABLES = """
tabs AS (SELECT * EXCLUDE (delivered_at) FROM snapshot_tables QUALIFY row_number() OVER (PARTITION BY build_id, table_id ORDER BY delivered_at DESC) = 1),
ordered AS (SELECT build_id, row_number() OVER (ORDER BY created_at DESC, build_id DESC) AS back FROM builds WHERE state = 'sealed'),
t1 AS (SELECT tabs.* FROM tabs JOIN ordered USING (build_id) WHERE back = 2),
t2 AS (SELECT tabs.* FROM tabs JOIN ordered USING (build_id) WHERE back = 1)"""

_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"

_COMPARED = f"""
WITH {B.ARTIFACTS}, cmp AS (
  SELECT coalesce(b1.relative_path, b2.relative_path) AS relative_path, b1.content_hash AS h1, b2.content_hash AS h2,
    CASE WHEN b1.build_id IS NULL THEN 'added' WHEN b2.build_id IS NULL THEN 'removed'
         WHEN b1.content_hash IS DISTINCT FROM b2.content_hash THEN 'changed' ELSE 'unchanged' END AS change
  FROM b1 FULL JOIN b2 ON b1.relative_path = b2.relative_path)"""

_RETAINED = "ret AS (SELECT build_id, state <> 'failed' AND row_number() OVER (PARTITION BY state <> 'failed' ORDER BY created_at DESC, build_id DESC) <= 3 AS kept FROM builds)"

_EDGES = f"{B.ARTIFACTS}, edges AS (SELECT DISTINCT id AS artifact_id, unnest(supersedes) AS superseded_id FROM b2)"

_CYCLES = """
reach AS (SELECT artifact_id AS a, superseded_id AS b FROM edges UNION SELECT r.a, e.superseded_id FROM reach r JOIN edges e ON e.artifact_id = r.b),
on_cycle AS (SELECT DISTINCT a FROM reach WHERE a = b)
SELECT DISTINCT x.id AS artifact_id FROM (SELECT artifact_id AS id FROM edges UNION SELECT superseded_id FROM edges) x
WHERE EXISTS (SELECT 1 FROM on_cycle c WHERE c.a = x.id OR (EXISTS (SELECT 1 FROM reach r WHERE r.a = c.a AND r.b = x.id)
  AND EXISTS (SELECT 1 FROM reach r JOIN on_cycle c2 ON c2.a = r.b WHERE r.a = x.id)))"""


def _tree(key: str) -> str:
    """The tree of hashes over m(key, h, n)."""
    return f"""
l1 AS (SELECT {key}, h[1:4] AS c, sum(n) AS n, sha256(string_agg(h || ':' || n, ',' ORDER BY h, n)) AS d FROM m GROUP BY {key}, h[1:4]),
l2 AS (SELECT {key}, c[1:2] AS c, sum(n) AS n, sha256(string_agg(c || ':' || d, ',' ORDER BY c)) AS d FROM l1 GROUP BY {key}, l1.c[1:2])
SELECT {key}, sum(n) AS n, sha256(string_agg(c || ':' || d, ',' ORDER BY c)) AS root FROM l2 GROUP BY {key}"""


def _decide(text: str, directory: bool) -> str:
    forms = [(i, r, ignore_regex(r.pattern, directory=directory)) for i, r in enumerate(IGNORES)]
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{x}') THEN {-1 if r.negated else i}" for i, r, x in reversed(forms) if x) + " ELSE -1 END"


_EXCLUDED = f"""
p AS (SELECT DISTINCT relative_path AS p FROM arts),
walked AS (SELECT p, list_transform(range(1, len(string_split(p, '/'))), lambda i: array_to_string(string_split(p, '/')[1:i], '/')) AS dirs FROM p),
decided AS (SELECT p, list_filter(list_transform(dirs, lambda d: {_decide('d', True)}), lambda i: i >= 0) AS skipped, {_decide('p', False)} AS own FROM walked),
ruled AS (SELECT p, coalesce(skipped[1], CASE WHEN own >= 0 THEN own END) AS rule FROM decided)"""

SQL = {
    "stream_windows": """
SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE AS "end", event_type,
  count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL""",
    "resolve_rules": f"""
WITH {B.ARTIFACTS} SELECT id AS artifact_id, {_last('status', "'active'", "'")} AS status, {_last('authority', '50')} AS authority,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {_hit(r)} THEN '{i}' END" for i, r in enumerate(RULES))}], lambda x: x IS NOT NULL), ',') AS matched FROM b2""",
    "rule_supersessions": f"""
WITH {B.ARTIFACTS}, t AS (SELECT *, CASE WHEN {_hit(RULES[4])} THEN 4 WHEN {_hit(RULES[3])} THEN 3 END AS rule FROM b2),
g(rule, pattern) AS (VALUES {', '.join(f"({i}, '{path_glob(g)}')" for i, r in enumerate(RULES) for g in r.supersedes)})
SELECT DISTINCT t.id AS artifact_id, x.id AS superseded_id FROM t JOIN g ON g.rule = t.rule JOIN b2 x ON x.id <> t.id AND regexp_matches(x.relative_path, g.pattern)""",
    "unmatched_rules": f"""
WITH {B.ARTIFACTS}, r(rule_index, match, pattern) AS (VALUES {', '.join(f"({i}, '{r.match}', '{path_glob(r.match)}')" for i, r in enumerate(RULES))})
SELECT rule_index, match FROM r WHERE NOT EXISTS (SELECT 1 FROM b2 WHERE regexp_matches(relative_path, pattern))""",
    "supersession_flags": f"""
WITH {_EDGES} SELECT b2.id AS artifact_id, count(edges.artifact_id) AS superseded_by FROM b2 LEFT JOIN edges ON edges.superseded_id = b2.id GROUP BY 1""",
    "supersession_cycles": f"WITH RECURSIVE {_EDGES}, {_CYCLES}",
    "supersession_conflicts": f"""
WITH RECURSIVE {B.ARTIFACTS}, own AS (SELECT DISTINCT id AS artifact_id, authority, unnest(supersedes) AS superseded_id FROM b2),
edges AS (SELECT artifact_id, superseded_id FROM own UNION SELECT superseded_id, artifact_id FROM own JOIN b2 ON b2.id = superseded_id WHERE b2.authority >= own.authority), {_CYCLES}""",
    "superseded_lists": f"WITH {_EDGES} SELECT artifact_id, string_agg(superseded_id, ',' ORDER BY superseded_id) AS supersedes FROM edges GROUP BY 1",
    "declared_only": f"WITH {B.ARTIFACTS} SELECT id AS artifact_id, status, authority FROM b2 WHERE status <> 'active' OR authority <> 50 OR len(supersedes) > 0",
    "preflight_sizes": f"""
WITH {B.NODES}, s AS (SELECT 'nodes' AS entity, count(*) AS rows, sum(strlen(text)) AS bytes FROM n UNION ALL SELECT 'documents', count(*), sum(strlen(text)) FROM documents)
SELECT *, CASE WHEN bytes > 524288000 THEN 'refuse' WHEN bytes > 419430400 THEN 'warn' ELSE 'ok' END AS verdict
FROM (SELECT * FROM s UNION ALL SELECT 'all', sum(rows), sum(bytes) FROM s)""",
    "freed_bytes": f"""
WITH {B.NODES}, {B.ARTIFACTS}, {_RETAINED}, gone AS (SELECT content_hash AS hash FROM arts JOIN ret USING (build_id) GROUP BY 1 HAVING NOT bool_or(kept)),
held AS (SELECT DISTINCT id FROM arts WHERE content_hash IN (SELECT hash FROM gone)),
sizes AS (SELECT artifact_id, sum(strlen(text)) AS bytes FROM n GROUP BY 1)
SELECT count(*) AS artifacts, sum(bytes) AS bytes FROM held JOIN sizes ON artifact_id = id""",
    "supersession_missing": f"WITH {_EDGES} SELECT artifact_id, superseded_id FROM edges WHERE superseded_id NOT IN (SELECT id FROM b2)",
    "fingerprint_compare": f"{_COMPARED} SELECT relative_path, change FROM cmp",
    "plan_summary": f"{_COMPARED} SELECT change, count(*) AS files FROM cmp GROUP BY 1",
    "hash_roots": f"WITH {B.ARTIFACTS}, m AS (SELECT build_id, sha256(concat_ws(' ', relative_path, content_hash)) AS h, count(*) AS n FROM arts GROUP BY ALL), {_tree('build_id')}",
    "tree_roots": f"WITH {B.NODES}, m AS (SELECT artifact_id, revision_hash AS h, count(*) AS n FROM n WHERE revision_hash IS NOT NULL GROUP BY ALL), {_tree('artifact_id')}",
    "diff_artifacts": f"""
{_COMPARED}, gone AS (SELECT h1 AS h, max(relative_path) AS twin FROM cmp WHERE change = 'removed' GROUP BY 1),
came AS (SELECT h2 AS h, max(relative_path) AS twin FROM cmp WHERE change = 'added' GROUP BY 1)
SELECT relative_path, change, CASE change WHEN 'added' THEN gone.twin WHEN 'removed' THEN came.twin END AS twin
FROM cmp LEFT JOIN gone ON gone.h = cmp.h2 LEFT JOIN came ON came.h = cmp.h1 WHERE change <> 'unchanged'""",
    "diff_chunks": r"""
WITH c AS (SELECT build_id, id, regexp_replace(lower(revision_hash), '^sha256:', '') AS h FROM snapshot_chunks
  QUALIFY row_number() OVER (PARTITION BY build_id, id ORDER BY delivered_at DESC) = 1),
ordered AS (SELECT build_id, row_number() OVER (ORDER BY created_at DESC, build_id DESC) AS back FROM builds WHERE state = 'sealed'),
a AS (SELECT c.* FROM c JOIN ordered USING (build_id) WHERE back = 2), b AS (SELECT c.* FROM c JOIN ordered USING (build_id) WHERE back = 1)
SELECT CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.h IS DISTINCT FROM b.h THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS chunks
FROM a FULL JOIN b ON a.id = b.id GROUP BY 1""",
    "diff_rules": f"""
WITH {B.ARTIFACTS}, j AS (SELECT b1.relative_path, b1.status AS s1, b2.status AS s2, CAST(b1.authority AS VARCHAR) AS a1, CAST(b2.authority AS VARCHAR) AS a2,
  array_to_string(list_sort(list_distinct(b1.supersedes)), ',') AS p1, array_to_string(list_sort(list_distinct(b2.supersedes)), ',') AS p2 FROM b1 JOIN b2 USING (relative_path)),
l AS (SELECT relative_path, 'status' AS field, s1 AS before, s2 AS after FROM j UNION ALL SELECT relative_path, 'authority', a1, a2 FROM j UNION ALL SELECT relative_path, 'supersedes', p1, p2 FROM j)
SELECT * FROM l WHERE before IS DISTINCT FROM after""",
    "diff_tables": f"""
WITH {_TABLES} SELECT coalesce(t1.table_id, t2.table_id) AS table_id,
  CASE WHEN t1.table_id IS NULL THEN 'added' WHEN t2.table_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
  t1.row_count AS rows_before, t2.row_count AS rows_after,
  array_to_string(list_filter(coalesce(t2.column_names, []), lambda x: NOT list_contains(coalesce(t1.column_names, []), x)), ',') AS columns_added,
  array_to_string(list_filter(coalesce(t1.column_names, []), lambda x: NOT list_contains(coalesce(t2.column_names, []), x)), ',') AS columns_removed
FROM t1 FULL JOIN t2 ON t1.table_id = t2.table_id
WHERE t1.table_id IS NULL OR t2.table_id IS NULL OR t1.row_count IS DISTINCT FROM t2.row_count OR t1.column_names IS DISTINCT FROM t2.column_names OR t1.table_name IS DISTINCT FROM t2.table_name""",
    "validate_without_sections": f"""
WITH {B.NODES}, m AS (SELECT * FROM n WHERE kind <> 'section')
SELECT 'parent-missing' AS "check", id FROM m WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m x WHERE x.id = m.parent_id AND x.artifact_id = m.artifact_id)
UNION ALL SELECT 'parent-self', id FROM m WHERE parent_id = id UNION ALL SELECT 'lines-reversed', id FROM m WHERE line_start > line_end""",
    "validate_nodes": f"""
WITH {B.NODES} SELECT 'parent-missing' AS "check", id FROM n WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n m WHERE m.id = n.parent_id AND m.artifact_id = n.artifact_id)
UNION ALL SELECT 'parent-self', id FROM n WHERE parent_id = id UNION ALL SELECT 'lines-reversed', id FROM n WHERE line_start > line_end""",
    "validate_chunks": f"""
WITH {B.ARTIFACTS}, c AS (SELECT DISTINCT build_id, id, arg_max(artifact_id, delivered_at) AS artifact_id FROM snapshot_chunks GROUP BY build_id, id)
SELECT build_id, id FROM c WHERE NOT EXISTS (SELECT 1 FROM arts WHERE arts.build_id = c.build_id AND arts.id = c.artifact_id)""",
    "retention_plan": f"WITH {_RETAINED} SELECT build_id, kept FROM ret",
    "unreferenced_objects": f"""
WITH {B.ARTIFACTS}, {_RETAINED} SELECT content_hash AS hash FROM arts JOIN ret USING (build_id) GROUP BY 1 HAVING NOT bool_or(kept)""",
    "build_history": """
SELECT build_id, CAST(row_number() OVER (ORDER BY created_at DESC, build_id DESC) AS INTEGER) AS position,
  lead(build_id) OVER (ORDER BY created_at DESC, build_id DESC) AS previous_build FROM builds WHERE state = 'sealed'""",
    "case_collisions": f"WITH {B.ARTIFACTS} SELECT lower(relative_path) AS folded, count(DISTINCT relative_path) AS spellings FROM arts GROUP BY 1 HAVING spellings > 1",
    "exclusion_report": f"""
WITH {B.ARTIFACTS}, {_EXCLUDED}, r(rule, pattern, source) AS (VALUES {', '.join(f"({i}, '{r.pattern}', '{r.source}')" for i, r in enumerate(IGNORES))})
SELECT pattern, source, count(*) AS files, array_to_string(list_sort(list(p))[1:5], ', ') AS sample FROM ruled JOIN r USING (rule) GROUP BY rule, pattern, source""",
    "detect_delimiters": r"""
WITH h AS (SELECT DISTINCT file_path, record_no, regexp_replace(raw_record, '"([^"]|"")*"', 'q', 'g') AS plain FROM segment_lines
  WHERE record_no <= 20 AND trim(regexp_replace(raw_record, '[\s\x{b}]+', ' ', 'g')) <> ''),
d(prefer, delimiter) AS (VALUES (0, ','), (1, ';'), (2, chr(9)), (3, '|')),
c AS (SELECT file_path, prefer, delimiter, length(plain) - length(replace(plain, delimiter, '')) AS n FROM h, d),
ok AS (SELECT file_path, prefer, delimiter, min(n) AS n FROM c GROUP BY ALL HAVING min(n) = max(n) AND min(n) > 0),
best AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY n DESC, prefer) = 1)
SELECT f.file_path, coalesce(delimiter, ',') AS delimiter, CAST(coalesce(n, 0) + 1 AS INTEGER) AS fields
FROM (SELECT DISTINCT file_path FROM segment_lines) f LEFT JOIN best USING (file_path)""",
    "artifact_counts": f"""
WITH {B.NODES}, {B.ARTIFACTS}, c AS (SELECT artifact_id, count(*) AS nodes, count(*) FILTER (text <> '') AS texts FROM n GROUP BY 1)
SELECT b2.id AS artifact_id, coalesce(nodes, 0) AS nodes, coalesce(texts, 0) AS texts FROM b2 LEFT JOIN c ON c.artifact_id = b2.id""",
    "build_counts": """
SELECT build_id, 'artifacts' AS entity, count(DISTINCT id) AS n FROM snapshot_artifacts GROUP BY 1
UNION ALL SELECT build_id, 'chunks', count(DISTINCT id) FROM snapshot_chunks GROUP BY 1
UNION ALL SELECT build_id, 'tables', count(DISTINCT table_id) FROM snapshot_tables GROUP BY 1""",
    "infer_types": f"WITH {_CELLS}, {_typed()} SELECT build_id, table_id, ordinal, column_name, {_TYPE} AS type FROM tests GROUP BY build_id, table_id, ordinal, column_name",
    "types_widened": _widened_sql(1_000),
    "types_widened_early": _widened_sql(20),
    "column_stats": f"WITH {_CELLS}, {_typed()} {_stats_sql('build_id, table_id, ')}",
    "relation_stats": f"""
WITH cells AS (SELECT unnest([1, 2, 3, 4]) AS ordinal, unnest(['l_returnflag', 'l_linenumber', 'l_quantity', 'l_linestatus']) AS column_name,
  unnest([l_returnflag, CAST(l_linenumber AS VARCHAR), CAST(l_quantity AS VARCHAR), l_linestatus]) AS cell FROM lineitem), {_typed()} {_stats_sql('')}""",
    "list_tables": f"""
WITH {_TABLES} SELECT table_id, table_name, CASE WHEN left({_SLUG.format('table_name')}, 40) = '' THEN 't_' || left(sha256(table_id), 12)
  ELSE 't_' || left({_SLUG.format('table_name')}, 40) || '_' || left(sha256(table_id), 12) END AS sql_name, row_count, len(column_names) AS columns FROM t2""",
    "describe_tables": f"""
WITH {_CELLS}, {_typed()}, ty AS (SELECT build_id, table_id, ordinal, column_name, {_TYPE} AS type FROM tests GROUP BY ALL),
rc AS (SELECT build_id, table_id, count(*) AS rows FROM once GROUP BY ALL)
SELECT build_id, table_id, 'Table with ' || any_value(rows) || ' rows. Columns: ' || string_agg(column_name || ' (' || type || ')', ', ' ORDER BY ordinal) AS description
FROM ty JOIN rc USING (build_id, table_id) GROUP BY build_id, table_id""",
    "column_names": f"""
WITH u AS (SELECT DISTINCT column_names FROM snapshot_tables), e AS (SELECT DISTINCT unnest(column_names) AS column_name, generate_subscripts(column_names, 1) - 1 AS ordinal FROM u)
SELECT ordinal, column_name, CASE WHEN left({_SLUG.format('column_name')}, 40) = '' THEN 'c_' || ordinal ELSE 'c_' || ordinal || '_' || left({_SLUG.format('column_name')}, 40) END AS sql_name FROM e""",
}
