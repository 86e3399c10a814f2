"""Builds over time: fingerprints, plans, differences, integrity checks, retention and exclusions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.constants import EXCLUSION_SAMPLE, KEEP_BUILDS, PROJECTION_MAX_BYTES, PROJECTION_WARN_BYTES
from stratalith.functions.globs import IgnoreRule, deciding_rule
from stratalith.operators.snapshots import plain_hash, plain_path


def latest_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, the one delivered last; null keys are left out."""
    others = [c for c in rows.columns if c not in (*keys, "delivered_at")]
    kept = rows
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    return (
        kept.groupBy(*keys)
        .agg(F.max_by(F.struct(*others), F.struct("delivered_at", F.xxhash64(*others))).alias("r"))
        .select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])
    )


def of_build(rows: DataFrame, build: str) -> DataFrame:
    return rows.where(F.col("build_id") == build).drop("build_id")


def full_compare(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change, before, after): added, removed, changed or unchanged by one full outer join."""
    joined = before.select(key, F.col(value).alias("before"), F.lit(True).alias("_b")).join(
        after.select(key, F.col(value).alias("after"), F.lit(True).alias("_a")), key, "full_outer"
    )
    change = (
        F.when(F.col("_b").isNull(), "added")
        .when(F.col("_a").isNull(), "removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), "changed")
        .otherwise("unchanged")
    )
    return joined.select(key, change.alias("change"), "before", "after")


def artifacts_of(snapshot: DataFrame) -> DataFrame:
    """A build's artifacts with plain path and hash, one row per path."""
    plain = snapshot.withColumn("relative_path", plain_path(F.col("relative_path"))).withColumn("content_hash", plain_hash(F.col("content_hash")))
    return latest_rows(plain, ["build_id", "relative_path"])


def diff_artifacts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(relative_path, change, twin): what changed by path; for a removed or added file the path of equal content on
    the other side, the last one on ties, marks a rename."""
    compared = full_compare(before, after, "relative_path", "content_hash").where("change <> 'unchanged'")
    removed = compared.where("change = 'removed'").groupBy(F.col("before").alias("h")).agg(F.max("relative_path").alias("twin"))
    added = compared.where("change = 'added'").groupBy(F.col("after").alias("h")).agg(F.max("relative_path").alias("twin"))
    pairs = removed.withColumn("change", F.lit("added")).unionByName(added.withColumn("change", F.lit("removed")))
    return (
        compared.withColumn("h", F.when(F.col("change") == "removed", F.col("before")).when(F.col("change") == "added", F.col("after")))
        .join(pairs, ["h", "change"], "left")
        .select("relative_path", "change", "twin")
    )


def diff_rules(before: DataFrame, after: DataFrame) -> DataFrame:
    """(relative_path, field, before, after) of the declared fields of files in both builds."""
    def fields(suffix: str) -> list[Column]:
        return [
            F.col("status").alias(f"status_{suffix}"),
            F.col("authority").cast("string").alias(f"authority_{suffix}"),
            F.array_join(F.array_sort(F.array_distinct(F.coalesce("supersedes", F.array().cast("array<string>")))), ",").alias(f"supersedes_{suffix}"),
        ]

    joined = before.select("relative_path", *fields("b")).join(after.select("relative_path", *fields("a")), "relative_path")
    long = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_b").alias("before"), F.col(f"{f}_a").alias("after")) for f in ("status", "authority", "supersedes")])
    return joined.select("relative_path", F.inline(long)).where(~F.col("before").eqNullSafe(F.col("after")))


def diff_tables(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table_id, change, rows_before, rows_after, columns_added, columns_removed) of tables that differ."""
    joined = before.select("table_id", F.col("row_count").alias("rows_before"), F.col("column_names").alias("cb"), F.col("table_name").alias("nb"), F.lit(True).alias("_b")).join(
        after.select("table_id", F.col("row_count").alias("rows_after"), F.col("column_names").alias("ca"), F.col("table_name").alias("na"), F.lit(True).alias("_a")), "table_id", "full_outer"
    )
    same = F.col("rows_before").eqNullSafe(F.col("rows_after")) & F.col("cb").eqNullSafe(F.col("ca")) & F.col("nb").eqNullSafe(F.col("na"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~same, "changed")
    none = F.array().cast("array<string>")
    return joined.select(
        "table_id", change.alias("change"), "rows_before", "rows_after",
        F.array_join(F.array_except(F.coalesce("ca", none), F.coalesce("cb", none)), ",").alias("columns_added"),
        F.array_join(F.array_except(F.coalesce("cb", none), F.coalesce("ca", none)), ",").alias("columns_removed"),
    ).where("change IS NOT NULL")


def plan(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(change, files): how many artifacts a build would add, parse again, drop and reuse."""
    return full_compare(previous, current, "relative_path", "content_hash").groupBy("change").agg(F.count(F.lit(1)).alias("files"))


def integrity(nodes: DataFrame) -> DataFrame:
    """(check, id): nodes whose parent is missing from their artifact, that are their own parent, or that hold text
    without lines in order."""
    ids = nodes.select(F.col("artifact_id"), F.col("id").alias("parent_id"))
    orphan = nodes.where("parent_id IS NOT NULL").join(ids, ["artifact_id", "parent_id"], "left_anti")
    own = nodes.where("parent_id = id")
    lines = nodes.where("line_start > line_end")
    return (
        orphan.select(F.lit("parent-missing").alias("check"), "id")
        .unionByName(own.select(F.lit("parent-self").alias("check"), "id"))
        .unionByName(lines.select(F.lit("lines-reversed").alias("check"), "id"))
    )


def chunk_integrity(chunks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(id) of chunks whose artifact the same build doesn't hold."""
    known = artifacts.select("build_id", F.col("id").alias("artifact_id")).distinct()
    return chunks.join(known, ["build_id", "artifact_id"], "left_anti").select("build_id", "id").distinct()


def node_references(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, node_id) of chunks that name nodes which don't exist."""
    named = chunks.select("id", F.explode("node_ids").alias("node_id"))
    return named.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("id", "node_id")


def supersession_targets(edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    return edges.join(artifacts.select(F.col("artifact_id").alias("superseded_id")), "superseded_id", "left_anti")


def case_collisions(paths: DataFrame, path: str = "relative_path") -> DataFrame:
    """(folded, spellings): paths that differ only by letter case."""
    return (
        paths.select(F.lower(path).alias("folded"), F.col(path).alias("p"))
        .distinct()
        .groupBy("folded")
        .agg(F.count(F.lit(1)).alias("spellings"))
        .where("spellings > 1")
    )


def retention(builds: DataFrame, active: str | None = None, keep: int = KEEP_BUILDS) -> DataFrame:
    """(build_id, kept): the active build and the newest ``keep`` that didn't fail stay."""
    ok = F.col("state") != "failed"
    order = Window.partitionBy(ok).orderBy(F.desc("created_at"), F.desc("build_id"))
    kept = (ok & (F.row_number().over(order) <= keep)) | (F.col("build_id") == F.lit(active) if active else F.lit(False))
    return builds.select("build_id", kept.alias("kept"))


def unreferenced(references: DataFrame, kept: DataFrame, key: str = "hash") -> DataFrame:
    """(key) that only builds about to go refer to. references(build_id, key); kept(build_id, kept)."""
    flagged = references.join(kept, "build_id")
    return flagged.groupBy(key).agg(F.max("kept").alias("any_kept")).where(~F.col("any_kept")).select(key)


def exclusions(paths: DataFrame, rules: Sequence[IgnoreRule], path: str = "relative_path", sample: int = EXCLUSION_SAMPLE) -> DataFrame:
    """(pattern, source, files, sample): what each ignore rule keeps out, with the first few paths.

    The sample is a bounded minimum: paths are numbered within a rule and only the first few are listed.
    """
    decided = paths.select(F.col(path).alias("p"), deciding_rule(F.col(path), rules).alias("rule")).where("rule IS NOT NULL")
    counts = decided.groupBy("rule").agg(F.count(F.lit(1)).alias("files"))
    # Partial first-n per task before the global one, so that a rule that matches most paths isn't one task's work.
    salted = Window.partitionBy("rule", "salt").orderBy("p")
    few = decided.withColumn("salt", F.pmod(F.xxhash64("p"), F.lit(256))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= sample)
    first = few.withColumn("n", F.row_number().over(Window.partitionBy("rule").orderBy("p"))).where(F.col("n") <= sample)
    listed = first.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("p")), ", ").alias("sample"))
    names = F.array(*[F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.source).alias("source")) for r in rules])
    return counts.join(listed, "rule").withColumn("r", F.element_at(names, F.col("rule") + 1)).select("r.pattern", "r.source", "files", "sample")


def preflight(rows: DataFrame, warn: int = PROJECTION_WARN_BYTES, refuse: int = PROJECTION_MAX_BYTES) -> DataFrame:
    """(entity, rows, bytes, verdict) of rows(entity, bytes), and of ``all`` together: ok, warn or refuse by size."""
    sums = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    whole = sums.agg(F.lit("all").alias("entity"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    verdict = F.when(F.col("bytes") > refuse, "refuse").when(F.col("bytes") > warn, "warn").otherwise("ok")
    return sums.unionByName(whole).withColumn("verdict", verdict)


def lock_diff(before: dict[str, str], after: dict[str, str]) -> list[tuple[str, str | None, str | None]]:
    """Keys of a lockfile that differ."""
    return [(k, before.get(k), after.get(k)) for k in sorted({*before, *after}) if before.get(k) != after.get(k)]


def build_history(builds: DataFrame) -> DataFrame:
    """(build_id, position, previous_build): verified builds, newest first, with the one before each."""
    sealed = builds.where("state = 'sealed'")
    w = Window.orderBy(F.desc("created_at"), F.desc("build_id"))
    return sealed.select("build_id", F.row_number().over(w).alias("position"), F.lead("build_id").over(w).alias("previous_build"))
