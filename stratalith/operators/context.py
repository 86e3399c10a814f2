"""Context bundles: an overview, what fits the budget in rank order, alternatives, and an account of everything left out.

Works on ranked candidates of many tasks at once. The overview is a greedy fold over at most 500 ranked candidates of
a task (those of its artifacts' best chunks); packing is a running sum with one cutoff per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith import constants as C
from stratalith.functions.text import stem


def resolve_budget(profile: str = C.DEFAULT_PROFILE, requested: int | None = None, allow_unsupported: bool = False) -> int:
    if requested is None:
        return C.PROFILE_BUDGETS[profile]
    low, high = C.BUDGET_RANGE
    if low <= requested <= high or allow_unsupported:
        return requested
    raise ValueError(f"a budget of {requested} tokens is outside {low} to {high}")


def names_artifact() -> Column:
    """Whether the task names the row's artifact, by a file stem or title of over two letters."""
    task = F.lower("query")
    by_stem = (F.length(stem(F.col("relative_path"))) > 2) & F.contains(task, F.lower(stem(F.col("relative_path"))))
    title = F.lower(F.coalesce("title", F.lit("")))
    return by_stem | ((F.length(title) > 2) & F.contains(task, title))


def overview_ids(kept: DataFrame, reserve: Column) -> DataFrame:
    """(query_id, chunk_id) of the overview: in rank order the first chunk of each artifact that fits what is left of
    the reserve; one that doesn't fit is skipped, and a later one of its artifact may still come in."""
    listed = kept.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "artifact_id", "chunk_id", "estimated_tokens"))).alias("l"),
        F.first(reserve).alias("reserve"),
    )
    start = F.struct(
        F.lit(0).cast("bigint").alias("used"),
        F.array().cast("array<string>").alias("seen"),
        F.array().cast("array<string>").alias("chosen"),
    )

    def step(acc: Column, x: Column) -> Column:
        fits = ~F.array_contains(acc["seen"], x["artifact_id"]) & (acc["used"] + x["estimated_tokens"] <= F.col("reserve"))
        return F.when(
            fits,
            F.struct(
                (acc["used"] + x["estimated_tokens"]).cast("bigint").alias("used"),
                F.array_append(acc["seen"], x["artifact_id"]).alias("seen"),
                F.array_append(acc["chosen"], x["chunk_id"]).alias("chosen"),
            ),
        ).otherwise(acc)

    return listed.select("query_id", F.explode(F.aggregate("l", start, step)["chosen"]).alias("chunk_id"))


def bundle(ranked: DataFrame, budget: int) -> DataFrame:
    """(query_id, chunk_id, bucket, position, reason, estimated_tokens, artifact_id, relative_path, heading_path,
    labels): every candidate of ``ranking.ranked`` in exactly one bucket of overview, selected, alternative, omitted.

    Positions count from 1 within a bucket; ``reason`` is set for omitted ones. Once a candidate breaks the budget
    everything after it is omitted for ``budget``, unless its artifact had used up its share before.
    """
    reserve = int(budget * C.ORIENTATION_SHARE)
    task = Window.partitionBy("query_id")
    kept = ranked.where(F.col("position").isNotNull())
    chosen = overview_ids(kept, F.lit(reserve)).withColumn("in_overview", F.lit(True))
    rows = (
        ranked.join(chosen, ["query_id", "chunk_id"], "left")
        .withColumn("targeted", F.size(F.collect_set(F.when(F.col("position").isNotNull() & names_artifact(), F.col("artifact_id"))).over(task)) == 1)
        .withColumn("in_overview", F.coalesce("in_overview", F.lit(False)))
        .withColumn("body", F.col("position").isNotNull() & ~F.col("in_overview"))
    )
    reserved = F.sum(F.when(F.col("in_overview"), F.col("estimated_tokens"))).over(task)
    rows = rows.withColumn("reserved", F.coalesce(reserved, F.lit(0)))
    in_artifact = Window.partitionBy("query_id", "artifact_id", "body").orderBy("position")
    rows = rows.withColumn("nth", F.row_number().over(in_artifact))
    may = F.col("body") & (F.col("targeted") | (F.col("nth") <= C.MAX_ITEMS_PER_ARTIFACT))
    rows = rows.withColumn("may", may)
    running = Window.partitionBy("query_id", "may").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("used", F.col("reserved") + F.sum(F.when(F.col("may"), F.col("estimated_tokens"))).over(running))
    rows = rows.withColumn("cutoff", F.min(F.when(F.col("may") & (F.col("used") > budget), F.col("position"))).over(task))
    before = F.col("cutoff").isNull() | (F.col("position") < F.col("cutoff"))
    rows = rows.withColumn("selected", F.col("may") & before)
    taken = F.sum(F.col("selected").cast("int")).over(Window.partitionBy("query_id", "artifact_id"))
    rows = rows.withColumn("full", ~F.col("targeted") & (taken >= C.MAX_ITEMS_PER_ARTIFACT))
    hidden = F.col("reason").isin("archived", "superseded")
    suppressed = Window.partitionBy("query_id", hidden).orderBy(F.desc("score"), "relative_path", "chunk_id")
    rows = rows.withColumn("hidden_no", F.when(hidden, F.row_number().over(suppressed)))
    bucket = (
        F.when(F.col("in_overview"), "overview")
        .when(F.col("selected"), "selected")
        .when(F.col("hidden_no") <= C.MAX_ALTERNATIVES, "alternative")
        .otherwise("omitted")
    )
    why = F.when(F.col("body"), F.when(F.col("full"), "diversity").otherwise("budget")).otherwise(F.col("reason"))
    rows = rows.withColumn("bucket", bucket).withColumn("why", F.when(F.col("bucket") == "omitted", why))
    order = F.coalesce("position", F.col("hidden_no"))
    within = Window.partitionBy("query_id", "bucket").orderBy(order.asc_nulls_last(), F.desc("score"), "relative_path", "chunk_id")
    return rows.select(
        "query_id", "chunk_id", "bucket", F.row_number().over(within).alias("position"), F.col("why").alias("reason"),
        "estimated_tokens", "artifact_id", "relative_path", "heading_path", "labels",
    )


def bundle_totals(bundled: DataFrame, budget: int) -> DataFrame:
    """(query_id, budget, estimated_tokens, reserved_tokens, overview, selected, alternatives, omitted)."""
    def n(name: str) -> Column:
        return F.count_if(F.col("bucket") == name)

    def tokens(*names: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("bucket").isin(*names), F.col("estimated_tokens"))), F.lit(0))

    return bundled.groupBy("query_id").agg(
        F.lit(budget).alias("budget"), tokens("overview", "selected").alias("estimated_tokens"),
        tokens("overview").alias("reserved_tokens"), n("overview").alias("overview"), n("selected").alias("selected"),
        n("alternative").alias("alternatives"), n("omitted").alias("omitted"),
    )
