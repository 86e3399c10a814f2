"""Queries of the general data-preparation problems, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratalith.operators import profile as P
from stratalith.operators import records as R
from stratalith.operators import snapshots as S
from stratalith.session import cut, shared_folder, table


def p2_found(spark, d):
    return S.snapshot_changes(*(table(spark, d, t) for t in ("snapshot_artifacts", "snapshot_chunks", "snapshot_tables", "builds")))


def p2_intervals(spark, d):
    got = S.snapshot_intervals(*(table(spark, d, t) for t in ("snapshot_artifacts", "snapshot_chunks", "snapshot_tables", "builds")))
    return got.select("record_kind", "record_key", "first_ord", "last_ord")


def p3_found(spark, d):
    return P.findings(table(spark, d, "price_rows"), table(spark, d, "table_columns"), table(spark, d, "builds"))


def _metrics(profiled):
    return profiled.selectExpr(
        "build_id", "table_id", "ordinal", "row_count", "null_count", "distinct_count", "violations", "min_text",
        "max_text", "min_number.value as min_number", "max_number.value as max_number",
        "floor(median * 10000 + 0.5) / 10000 as median",
    )


def p3_profile(spark, d):
    return _metrics(P.profile(table(spark, d, "price_rows"), table(spark, d, "builds")))


def p3_incremental(spark, d):
    """The profile once the latest build arrives: its states are merged into those kept of the builds before."""
    rows, builds = table(spark, d, "price_rows"), table(spark, d, "builds")
    latest = builds.orderBy(F.desc("created_at"), F.desc("build_id")).first()
    new = F.col("build_id").eqNullSafe(latest["build_id"] if latest else None)
    kept = cut(P.column_states(rows.where(~new)))
    return _metrics(P.profile(rows.where(new), builds, kept=kept))


def p3_stored(spark, d):
    """The same with states that lie in a folder: the second run scans the latest build alone."""
    rows, builds = table(spark, d, "price_rows"), table(spark, d, "builds")
    latest = builds.orderBy(F.desc("created_at"), F.desc("build_id")).first()
    root = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    P.keep_states(rows.where(~F.col("build_id").eqNullSafe(latest["build_id"] if latest else None)), root)
    return _metrics(P.changes(P.keep_states(rows, root), builds))


def _rounded(limits):
    return limits.withColumns({c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6 for c in ("value", "mean", "spread")})


def p3_control_limits(spark, d):
    return _rounded(P.control_limits(P.profile(table(spark, d, "price_rows"), table(spark, d, "builds"))))


def p3_anomalies(spark, d):
    """Metrics of loads outside the control limits of the loads before them."""
    return _rounded(P.anomalies(P.profile(table(spark, d, "price_rows"), table(spark, d, "builds"))))


def p5_found(spark, d):
    return R.rejected(table(spark, d, "segment_lines"))


def p5_valid(spark, d):
    return R.valid(table(spark, d, "segment_lines"))


def p5_faults(spark, d):
    """Broken quotes as the parser of whole files meets and leaves them."""
    return R.located_faults(table(spark, d, "segment_lines"))


QUERIES = {f.__name__: f for f in (p2_found, p2_intervals, p3_found, p3_profile, p3_incremental, p3_stored, p3_control_limits, p3_anomalies, p5_found, p5_valid, p5_faults)}

_STATES = r"""
sealed AS (SELECT build_id, row_number() OVER (ORDER BY created_at, build_id) AS ord FROM builds WHERE state = 'sealed'),
raw AS (
  SELECT 'artifact' AS record_kind, build_id, delivered_at,
         nfc_normalize(regexp_replace(replace(relative_path, '\', '/'), '^(\./+)+', '')) AS record_key,
         coalesce('v' || regexp_replace(lower(content_hash), '^sha256:', ''), 'null') AS state
  FROM snapshot_artifacts
  UNION ALL
  SELECT 'rule', build_id, delivered_at,
         nfc_normalize(regexp_replace(replace(relative_path, '\', '/'), '^(\./+)+', '')),
         concat_ws('|', coalesce('v' || status, 'null'), coalesce('v' || authority, 'null'),
                   CAST(list_sort(list_distinct(coalesce(supersedes, []))) AS VARCHAR))
  FROM snapshot_artifacts
  UNION ALL
  SELECT 'chunk', build_id, delivered_at, id, coalesce('v' || regexp_replace(lower(revision_hash), '^sha256:', ''), 'null')
  FROM snapshot_chunks
  UNION ALL
  SELECT 'table', build_id, delivered_at, table_id,
         concat_ws('|', coalesce('v' || table_name, 'null'), coalesce('v' || row_count, 'null'),
                   coalesce(CAST(column_names AS VARCHAR), 'null'))
  FROM snapshot_tables),
states AS (
  SELECT record_kind, record_key, ord, arg_max(state, delivered_at) AS state
  FROM raw JOIN sealed USING (build_id) WHERE record_key IS NOT NULL GROUP BY ALL)
"""

_PROFILE = r"""
once AS (SELECT DISTINCT build_id, table_id, row_no, sku, list_price, currency, discontinued, valid_from, owner_team FROM price_rows),
cells AS (
  SELECT build_id, table_id, unnest([1, 2, 3, 4, 5, 6]) AS ordinal,
         unnest([sku, list_price, currency, discontinued, valid_from, owner_team]) AS cell FROM once),
plain AS (SELECT build_id, table_id, ordinal, regexp_replace(cell, '^[\s\x{85}\x{a0}\x{3000}\x{feff}\x{2000}-\x{200a}]+|[\s\x{85}\x{a0}\x{3000}\x{feff}\x{2000}-\x{200a}]+$', '', 'g') AS cell FROM cells),
valued AS (SELECT build_id, table_id, ordinal, CASE WHEN lower(cell) IN ('', 'null', 'n/a', 'na') THEN NULL ELSE cell END AS v FROM plain),
judged AS (
  SELECT *, coalesce(CASE ordinal
    WHEN 1 THEN regexp_full_match(v, '[A-Z]{2,4}-[0-9]{3,6}')
    WHEN 2 THEN regexp_full_match(v, '-?(0|[1-9][0-9]*)(\.[0-9]+)?')
    WHEN 3 THEN regexp_full_match(v, '[A-Z]{3}')
    WHEN 4 THEN lower(v) IN ('true', 'false')
    WHEN 5 THEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(v AS DATE) IS NOT NULL
    ELSE regexp_full_match(v, '[a-z0-9]+(-[a-z0-9]+)*') END, false) AS fit
  FROM valued),
metrics AS (
  SELECT build_id, table_id, ordinal, count(*) AS row_count, count(*) - count(v) AS null_count,
         count(DISTINCT v) AS distinct_count, count(*) FILTER (v IS NOT NULL AND NOT fit) AS violations,
         min(v) FILTER (fit AND ordinal <> 2) AS min_text, max(v) FILTER (fit AND ordinal <> 2) AS max_text,
         min(TRY_CAST(v AS DECIMAL(38, 12))) FILTER (fit AND ordinal = 2) AS min_number,
         max(TRY_CAST(v AS DECIMAL(38, 12))) FILTER (fit AND ordinal = 2) AS max_number,
         quantile_cont(TRY_CAST(v AS DOUBLE), 0.5) FILTER (fit AND ordinal = 2) AS median
  FROM judged GROUP BY ALL),
loads AS (
  SELECT build_id, table_id, row_number() OVER (PARTITION BY table_id ORDER BY created_at, build_id) AS load_no
  FROM (SELECT DISTINCT build_id, table_id FROM price_rows) JOIN builds USING (build_id))
"""

_PAD = "chr(9) || chr(10) || chr(13) || ' ' || chr(160) || chr(12288)"

_RECORDS = rf"""
heads AS (SELECT file_path, lower(trim(replace(replace(any_value(raw_record), chr(65279), ''), '"', ''), {_PAD})) AS h
          FROM segment_lines WHERE record_no = 1 GROUP BY file_path),
named AS (SELECT file_path, d, string_split(h, d) AS cols
          FROM (SELECT *, CASE WHEN contains(h, ',') THEN ',' WHEN contains(h, ';') THEN ';' WHEN contains(h, chr(9)) THEN chr(9) ELSE '|' END AS d FROM heads)),
lines AS (
  SELECT DISTINCT record_id, d, list_position(cols, 'segment') AS seg, list_position(cols, 'need') AS nd,
         list_position(cols, 'priority') AS pr, regexp_replace(raw_record, '\r$', '') AS r
  FROM segment_lines JOIN named USING (file_path) WHERE record_no <> 1 AND trim(raw_record, {_PAD}) <> ''),
shaped AS (
  SELECT *, '(?s)("(?:[^"]|"")*"|[^"' || CASE WHEN d = chr(9) THEN chr(9) ELSE d END || ']*)' AS one,
         CASE WHEN d = '|' THEN '\|' ELSE d END AS sep FROM lines),
cut AS (
  SELECT *, regexp_full_match(r, one || '(?:' || sep || one || ')*') AS sound,
         regexp_full_match(r, one || sep || one || sep || one) AS three,
         [regexp_extract(r, '^' || one || sep || one || sep || one || '$', 1),
          regexp_extract(r, '^' || one || sep || one || sep || one || '$', 2),
          regexp_extract(r, '^' || one || sep || one || sep || one || '$', 3)] AS raw_fields FROM shaped),
opened AS (
  SELECT *, list_transform(raw_fields, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM cut),
verdicts AS (
  SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN NOT three THEN 'column_count'
    WHEN NOT regexp_full_match(trim(f[seg], {_PAD}), '[a-z0-9]+(-[a-z0-9]+)*')
      OR lower(trim(f[nd], {_PAD})) IN ('', 'null', 'n/a', 'na')
      OR lower(trim(f[pr], {_PAD})) NOT IN ('high', 'medium', 'low') THEN 'value' END AS reason FROM opened)
"""

SQL = {
    "p2_found": f"""
WITH {_STATES},
steps AS (SELECT a.ord AS a, b.ord AS b, a.build_id AS from_build, b.build_id AS to_build FROM sealed a JOIN sealed b ON b.ord = a.ord + 1),
o AS (SELECT s.*, a AS step FROM states s JOIN steps ON ord = a), n AS (SELECT s.*, a AS step FROM states s JOIN steps ON ord = b),
both_sides AS (
  SELECT coalesce(o.record_kind, n.record_kind) AS record_kind, coalesce(o.record_key, n.record_key) AS record_key,
         coalesce(o.step, n.step) AS a,
         CASE WHEN o.record_key IS NULL THEN 'added' WHEN n.record_key IS NULL THEN 'removed'
              WHEN o.state <> n.state THEN 'changed' END AS change_type
  FROM o FULL JOIN n ON o.record_kind = n.record_kind AND o.record_key = n.record_key AND o.step = n.step)
SELECT record_kind, from_build, to_build, record_key, change_type FROM both_sides JOIN steps USING (a)
WHERE change_type IS NOT NULL AND (record_kind <> 'rule' OR change_type = 'changed')""",
    "p2_intervals": f"""
WITH {_STATES},
marked AS (
  SELECT *, CASE WHEN lag(ord) OVER w = ord - 1 AND lag(state) OVER w = state THEN 0 ELSE 1 END AS fresh
  FROM states WINDOW w AS (PARTITION BY record_kind, record_key ORDER BY ord)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY record_kind, record_key ORDER BY ord) AS island FROM marked)
SELECT record_kind, record_key, min(ord) AS first_ord, max(ord) AS last_ord FROM runs GROUP BY record_kind, record_key, island""",
    "p3_found": f"""
WITH {_PROFILE},
shares AS (
  SELECT table_id, load_no, ordinal, v, n / sum(n) OVER (PARTITION BY table_id, load_no, ordinal) AS share
  FROM (SELECT table_id, load_no, ordinal, v, count(*) AS n FROM judged JOIN loads USING (build_id, table_id)
        WHERE v IS NOT NULL AND ordinal IN (3, 4, 6) GROUP BY ALL)),
signed AS (SELECT * FROM shares UNION ALL SELECT table_id, load_no + 1, ordinal, v, -share FROM shares),
distances AS (
  SELECT table_id, load_no, ordinal, sum(abs(d)) / 2 AS distance
  FROM (SELECT table_id, load_no, ordinal, v, sum(share) AS d FROM signed GROUP BY ALL) GROUP BY ALL),
history AS (
  SELECT m.*, load_no, distance, null_count / row_count AS null_share,
         lag(null_count / row_count) OVER w AS null_before, lag(median) OVER w AS median_before
  FROM metrics m JOIN loads USING (build_id, table_id) LEFT JOIN distances USING (table_id, load_no, ordinal)
  WINDOW w AS (PARTITION BY table_id, ordinal ORDER BY load_no)),
joined AS (SELECT h.*, c.build_id IS NOT NULL AS noted, c.null_count AS r_nulls, distinct_estimate, distinct_is_exact, min_value, max_value
  FROM history h LEFT JOIN table_columns c USING (build_id, table_id, ordinal))
SELECT build_id, table_id, ordinal, finding FROM (
  SELECT build_id, table_id, ordinal, 'null_count' AS finding FROM joined WHERE noted AND r_nulls IS DISTINCT FROM null_count
  UNION ALL SELECT build_id, table_id, ordinal, 'distinct_estimate' FROM joined
    WHERE noted AND ((coalesce(distinct_is_exact, true) AND distinct_estimate IS DISTINCT FROM distinct_count)
      OR (NOT distinct_is_exact AND distinct_estimate > distinct_count))
  UNION ALL SELECT build_id, table_id, ordinal, 'min_value' FROM joined
    WHERE noted AND CASE WHEN ordinal = 2 THEN TRY_CAST(min_value AS DECIMAL(38, 12)) IS DISTINCT FROM min_number ELSE min_value IS DISTINCT FROM min_text END
  UNION ALL SELECT build_id, table_id, ordinal, 'max_value' FROM joined
    WHERE noted AND CASE WHEN ordinal = 2 THEN TRY_CAST(max_value AS DECIMAL(38, 12)) IS DISTINCT FROM max_number ELSE max_value IS DISTINCT FROM max_text END
  UNION ALL SELECT build_id, table_id, ordinal, 'pattern' FROM joined WHERE violations > 0
  UNION ALL SELECT build_id, table_id, ordinal, 'drift' FROM joined WHERE load_no > 1 AND (
    abs(null_share - null_before) >= 0.15 - 1e-9 OR (ordinal IN (3, 4, 6) AND distance >= 0.25 - 1e-9)
    OR (ordinal = 2 AND greatest(median, median_before) >= 1.5 * least(median, median_before) - 1e-9
        AND median IS NOT NULL AND median_before IS NOT NULL)))""",
    "p3_profile": f"""
WITH {_PROFILE}
SELECT build_id, table_id, ordinal, row_count, null_count, distinct_count, violations, min_text, max_text,
       CAST(min_number AS DOUBLE) AS min_number, CAST(max_number AS DOUBLE) AS max_number,
       floor(median * 10000 + 0.5) / 10000 AS median FROM metrics""",
    "p5_found": f"""
WITH {_RECORDS}
SELECT record_id, reason FROM verdicts WHERE reason IS NOT NULL""",
    "p5_valid": f"""
WITH {_RECORDS}
SELECT record_id, trim(f[seg], {_PAD}) AS segment, trim(f[nd], {_PAD}) AS need, lower(trim(f[pr], {_PAD})) AS priority
FROM verdicts WHERE reason IS NULL""",
}
SQL["p3_incremental"] = SQL["p3_stored"] = SQL["p3_profile"]
_LIMITS = f"""
WITH {_PROFILE}, seen AS (
  SELECT build_id, table_id, ordinal, load_no, unnest(['null_share', 'distinct_count', 'violations']) AS metric,
         unnest([null_count / row_count, CAST(distinct_count AS DOUBLE), CAST(violations AS DOUBLE)]) AS value
  FROM metrics JOIN loads USING (build_id, table_id)),
judged_loads AS (
  SELECT *, count(value) OVER w AS history, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS spread FROM seen
  WINDOW w AS (PARTITION BY table_id, ordinal, metric ORDER BY load_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
limits AS (
  SELECT build_id, table_id, ordinal, metric, floor(value * 1e6 + 0.5) / 1e6 AS value, floor(mean * 1e6 + 0.5) / 1e6 AS mean,
         floor(spread * 1e6 + 0.5) / 1e6 AS spread, CASE WHEN history >= 3 THEN abs(value - mean) > 3 * spread + 1e-12 END AS anomaly FROM judged_loads)"""
SQL["p3_control_limits"] = f"{_LIMITS} SELECT * FROM limits"
SQL["p3_anomalies"] = f"{_LIMITS} SELECT * EXCLUDE (anomaly) FROM limits WHERE anomaly"
