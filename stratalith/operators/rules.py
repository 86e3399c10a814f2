"""Declared rules: status, authority and supersession of artifacts by path globs, later rules over earlier ones.

Rules are configuration, so they become column expressions of one pass over the artifacts: no join, whatever their
number of artifacts. Targets of supersession are globs too; only the few rules that supersede meet the artifacts in a
join, with the rules (not the artifacts) as the small side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.constants import DEFAULT_AUTHORITY, DEFAULT_STATUS, STATUS_FACTORS
from stratalith.functions.globs import path_glob
from stratalith.session import cut


@dataclass(frozen=True)
class Rule:
    match: str
    status: str | None = None
    authority: int | None = None
    supersedes: tuple[str, ...] = ()
    replace: bool = False


def check_rules(rules: Sequence[Rule]) -> None:
    for i, r in enumerate(rules, 1):
        if r.status is not None and r.status not in STATUS_FACTORS:
            raise ValueError(f"rule {i} ({r.match}): {r.status!r} is no status")
        if r.authority is not None and not 0 <= r.authority <= 100:
            raise ValueError(f"rule {i} ({r.match}): authority {r.authority} is outside 0 to 100")


def resolve_scalars(artifacts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """artifacts(artifact_id, relative_path, ...) with status, authority and matched_rules (indices from 0)."""
    check_rules(rules)
    status, authority, matched = F.lit(DEFAULT_STATUS), F.lit(DEFAULT_AUTHORITY), []
    for i, r in enumerate(rules):
        hit = F.col("relative_path").rlike(path_glob(r.match))
        matched.append(F.when(hit, F.lit(i)))
        if r.status is not None:
            status = F.when(hit, r.status).otherwise(status)
        if r.authority is not None:
            authority = F.when(hit, r.authority).otherwise(authority)
    found = F.array_compact(F.array(*matched)) if matched else F.array().cast("array<int>")
    return artifacts.withColumn("status", status).withColumn("authority", authority).withColumn("matched_rules", found)


def supersessions(artifacts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(artifact_id, superseded_id): what the rules say each artifact supersedes, never itself.

    For an artifact the lists of its rules add up; from the last of its rules with ``replace`` on they start anew.
    """
    spark = artifacts.sparkSession
    strong = [(i, r) for i, r in enumerate(rules) if r.supersedes]
    pairs = [(i, glob) for i, r in strong for glob in r.supersedes]
    if not pairs:
        return artifacts.select("artifact_id", F.col("artifact_id").alias("superseded_id")).where("false")
    resets = [i for i, r in strong if r.replace]
    holders = resolve_scalars(artifacts, rules).select("artifact_id", F.explode("matched_rules").alias("rule"))
    since = holders.groupBy("artifact_id").agg(
        F.coalesce(F.max(F.when(F.col("rule").isin(*resets), F.col("rule"))) if resets else F.lit(0), F.lit(0)).alias("since")
    )
    active = holders.join(since, "artifact_id").where(F.col("rule") >= F.col("since")).select("artifact_id", "rule")
    by_rule = F.array_compact(
        F.array(*[F.when(F.col("relative_path").rlike(path_glob(g)), F.lit(i)) for i, g in pairs])
    )
    targets = artifacts.select(F.col("artifact_id").alias("superseded_id"), F.explode(F.array_distinct(by_rule)).alias("rule"))
    del spark
    return (
        active.join(targets, "rule")
        .where("artifact_id <> superseded_id")
        .select("artifact_id", "superseded_id")
        .distinct()
    )


def unmatched_rules(artifacts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule_index, match) of rules that apply to no artifact: one aggregate over the artifacts."""
    counts = artifacts.agg(*[F.count_if(F.col("relative_path").rlike(path_glob(r.match))).alias(f"r{i}") for i, r in enumerate(rules)])
    lists = F.array(*[F.struct(F.lit(i).alias("rule_index"), F.lit(r.match).alias("match"), F.col(f"r{i}").alias("n")) for i, r in enumerate(rules)])
    return counts.select(F.inline(lists)).where("n = 0").select("rule_index", "match")


def unmatched_targets(artifacts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule_index, glob) of supersession globs that match no artifact, which is an error of the configuration."""
    pairs = [(i, g) for i, r in enumerate(rules) for g in r.supersedes]
    counts = artifacts.agg(*[F.count_if(F.col("relative_path").rlike(path_glob(g))).alias(f"t{k}") for k, (_, g) in enumerate(pairs)])
    lists = F.array(*[F.struct(F.lit(i).alias("rule_index"), F.lit(g).alias("glob"), F.col(f"t{k}").alias("n")) for k, (i, g) in enumerate(pairs)])
    return counts.select(F.inline(lists)).where("n = 0").select("rule_index", "glob")


def cyclic(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(artifact_id) on or between cycles of edges(artifact_id, superseded_id).

    Nodes without an edge in or without an edge out can be on no cycle; they are peeled off until nothing changes.
    Each round is two semi-joins and cuts the lineage by a checkpoint; a chain of n edges takes about n/2 rounds. Where
    ``rounds`` is given and doesn't suffice, an error is raised.
    """
    left = cut(edges.select("artifact_id", "superseded_id").distinct())
    n = left.count()
    done = 0
    while n:
        if done == rounds:
            raise RuntimeError(f"cycles aren't settled after {rounds} rounds")
        done += 1
        outs = left.select(F.col("artifact_id").alias("superseded_id")).distinct()
        ins = left.select(F.col("superseded_id").alias("artifact_id")).distinct()
        left = cut(left.join(outs, "superseded_id", "left_semi").join(ins, "artifact_id", "left_semi"))
        now = left.count()
        if now == n:
            break
        n = now
    return left.select(F.explode(F.array("artifact_id", "superseded_id")).alias("artifact_id")).distinct()


def cycle(edges: DataFrame) -> list[str]:
    """The artifacts of one cycle in its order, from the smallest id on; empty if there is none.

    Only what is left after peeling comes to the driver, and there only one edge of each artifact: in what is left each
    has a successor within it, so following one from anywhere ends in a loop.
    """
    left = cyclic(edges)
    inside = edges.join(left, "artifact_id", "left_semi").join(left.withColumnRenamed("artifact_id", "superseded_id"), "superseded_id", "left_semi")
    after = {r["artifact_id"]: r["next"] for r in inside.groupBy("artifact_id").agg(F.min("superseded_id").alias("next")).collect()}
    if not after:
        return []
    seen: dict[str, int] = {}
    # A node between two cycles has a successor too, so every walk ends in a loop.
    at = min(after)
    while at not in seen:
        seen[at] = len(seen)
        at = after[at]
    loop = [n for n, i in seen.items() if i >= seen[at]]
    first = loop.index(min(loop))
    return loop[first:] + loop[:first]
