"""Column-level data quality profile.

Declarative constraints (null tokens, a pattern and an order per column) compile into one shared scan that leaves a
mergeable state per (load, column, cell value): its count and whether it fits. States of partitions, files or loads
merge by adding counts; every metric (null rate, distinct count, range, violations, distribution distance, median) is
then a second, much smaller aggregate over states. Recorded profiles enter that same aggregate as rows of their own, so
they need no join. Metrics of successive loads are held against control limits.

Defined cases: a repeated row (same build, table and row_no) counts once, by its latest ``loaded_at``; null, empty and
null-token cells are nulls; a column without a fitting cell has null bounds and no median; an empty table gives no
rows; a load without a recorded profile has no recorded findings, a recorded profile without a load none at all; numbers
are compared as doubles and, up to 26 digits before the point and 12 after it, as decimals; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions.text import trimmed
from stratalith.session import exists

NULL_TOKENS = ("", "null", "n/a", "na")
LOAD = ["build_id", "table_id"]
NUMBER = "decimal(38,12)"
#: Files that the kept states of a build are dealt over.
STATE_FILES = 64
#: From this distance of value shares on a load has drifted; what exact ties may miss it by.
DISTANCE, TOLERANCE = 0.25, 1e-9


@dataclass(frozen=True)
class Constraint:
    """What a cell of one column must look like. kind: text, number or date; drift: which distribution test applies."""

    ordinal: int
    column: str
    pattern: str
    kind: str = "text"
    drift: str = "none"


PRICE_LIST = (
    Constraint(1, "sku", "^[A-Z]{2,4}-[0-9]{3,6}$"),
    Constraint(2, "list_price", r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$", "number", "median"),
    Constraint(3, "currency", "^[A-Z]{3}$", "text", "shares"),
    Constraint(4, "discontinued", "^(?i:true|false)$", "text", "shares"),
    Constraint(5, "valid_from", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "date"),
    Constraint(6, "owner_team", "^[a-z0-9]+(-[a-z0-9]+)*$", "text", "shares"),
)


def keep_states(rows: DataFrame, root: str, rules: tuple[Constraint, ...] = PRICE_LIST) -> DataFrame:
    """The states of all loads, kept in a folder between runs: only builds whose number of rows isn't the one noted are
    scanned, and their states replace those kept of them.

    The list of builds is configuration, a handful of rows. States are written before their counts are, so a run that
    breaks off is made good by the next one.
    """
    spark = rows.sparkSession

    def noted(name: str) -> DataFrame | None:
        return spark.read.parquet(f"{root}/{name}") if exists(spark, f"{root}/{name}/_SUCCESS") else None

    now = {r["build_id"]: r["count"] for r in rows.groupBy("build_id").count().collect()}
    counts = noted("counts")
    known = {r["build_id"]: r["count"] for r in counts.collect()} if counts is not None else {}
    fresh = [b for b, n in now.items() if known.get(b) != n]
    if fresh:
        some = F.col("build_id").isin([b for b in fresh if b is not None]) | (F.col("build_id").isNull() & F.lit(None in fresh))
        made = column_states(rows.where(some), rules).repartition("build_id", F.pmod(F.xxhash64("table_id"), F.lit(STATE_FILES)))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("build_id").parquet(f"{root}/states")
        spark.createDataFrame([*(known | now).items()], "build_id string, count bigint").coalesce(1).write.mode("overwrite").parquet(f"{root}/counts")
    return spark.read.schema("table_id string, ordinal int, value string, n bigint, fit boolean, build_id string").parquet(f"{root}/states")


def number_of(text: Column) -> Column:
    """(double, decimal) of a number's text, compared in this order; the decimal is null where it has too many digits."""
    value = text.try_cast("double")
    return F.when(value.isNotNull(), F.struct(value.alias("value"), text.try_cast(NUMBER).alias("exact")))


def fits(value: Column, rule: Constraint) -> Column:
    ok = value.rlike(rule.pattern)
    if rule.kind == "date":
        ok = ok & value.try_cast("date").isNotNull() & ~value.startswith("0000")
    return ok


def column_states(rows: DataFrame, rules: tuple[Constraint, ...] = PRICE_LIST, key: str = "row_no") -> DataFrame:
    """(build_id, table_id, ordinal, value, fit, n): the mergeable state; value is null for null cells."""
    # Cells travel as one array, which no branch of a plan can prune: all share the exchange that drops repeated rows.
    cells = F.array(*[F.col(r.column) for r in rules]).alias("cells")
    once = rows.groupBy(*LOAD, key).agg(F.max(F.struct("loaded_at", cells))["cells"].alias("cells"))
    long = once.select(*LOAD, F.posexplode("cells").alias("at", "cell")).select(
        *LOAD, F.get(F.array(*[F.lit(r.ordinal) for r in rules]), F.col("at")).alias("ordinal"), trimmed(F.col("cell")).alias("value")
    )
    long = long.withColumn("value", F.when(~F.lower("value").isin(*NULL_TOKENS), F.col("value")))
    counts = long.groupBy(*LOAD, "ordinal", "value").agg(F.count(F.lit(1)).alias("n"))
    fit = F.lit(False)
    for r in rules:
        fit = F.when(F.col("ordinal") == r.ordinal, fits(F.col("value"), r)).otherwise(fit)
    return counts.withColumn("fit", F.coalesce(fit, F.lit(False)))


def merge_states(*states: DataFrame) -> DataFrame:
    """Add the states of disjoint sets of rows, e.g. of a load's partitions."""
    whole = states[0]
    for s in states[1:]:
        whole = whole.unionByName(s)
    return whole.groupBy(*LOAD, "ordinal", "value", "fit").agg(F.sum("n").alias("n"))


def column_metrics(states: DataFrame, rules: tuple[Constraint, ...] = PRICE_LIST, recorded: DataFrame | None = None) -> DataFrame:
    """One row per load and column with all metrics; bounds as text and, for number columns, as numbers.

    With ``recorded`` each row also has ``rec``, what was recorded of the column, or null.
    """
    numeric = F.col("ordinal").isin(*[r.ordinal for r in rules if r.kind == "number"])
    fitting = F.when(F.col("fit"), F.col("value"))
    number = F.when(F.col("fit") & numeric, number_of(F.col("value")))
    more = []
    if recorded is not None:
        rec = F.struct("null_count", "distinct_estimate", "distinct_is_exact", "min_value", "max_value").alias("rec")
        states = states.unionByName(recorded.select(*LOAD, "ordinal", rec), allowMissingColumns=True)
        more = [F.max("rec").alias("rec")]
    got = states.groupBy(*LOAD, "ordinal").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull() & ~F.col("fit"), F.col("n"))), F.lit(0)).alias("violations"),
        F.min(F.when(~numeric, fitting)).alias("min_text"),
        F.max(F.when(~numeric, fitting)).alias("max_text"),
        F.min(number).alias("min_number"),
        F.max(number).alias("max_number"),
        F.percentile(number["value"], F.lit(0.5), F.coalesce("n", F.lit(0))).alias("median"),
        *more,
    )
    return got.where(F.col("row_count").isNotNull())


def in_order(metrics: DataFrame, builds: DataFrame) -> DataFrame:
    """Metrics with ``load_no`` (the loads of a table by creation of their builds, from 1), the builds before and after,
    null share and median of the load before."""
    created = builds.groupBy("build_id").agg(F.min("created_at").alias("created_at"))
    w = Window.partitionBy("table_id", "ordinal").orderBy("created_at", "build_id")
    share = metrics.join(created, "build_id", "left").withColumn("null_share", F.col("null_count") / F.col("row_count"))
    return (
        share.withColumn("load_no", F.row_number().over(w))
        .withColumn("next_build", F.lead("build_id").over(w))
        .withColumn("null_shift", F.abs(F.col("null_share") - F.lag("null_share").over(w)))
        .withColumn("median_before", F.lag("median").over(w))
        .withColumn("first_load", F.col("load_no") == 1)
        .drop("created_at")
    )


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """left and right by load and ordinal, nulls being equal. Said so, the join lets no condition that keys aren't null
    sink into one side's states, which all branches of a plan share."""
    keys = [*LOAD, "ordinal"]
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, on, how).drop(*[f"_{k}" for k in keys])


def share_distance(states: DataFrame, builds: DataFrame, rules=PRICE_LIST) -> DataFrame:
    """(build_id, table_id, ordinal, distance): half the sum of absolute share differences to the previous load.

    Each share is emitted with a plus for its own load and a minus for the next one, so one grouped sum gives the
    differences without joining loads to each other. A column without any value has no shares; a first load no distance.
    """
    watched = F.col("ordinal").isin(*[r.ordinal for r in rules if r.drift == "shares"])
    # Said of the count, the conditions stay above the exchange of the states.
    held = states.where(F.when(watched & F.col("value").isNotNull(), F.col("n")) > 0)
    totals = states.where(F.when(watched, F.col("n")) > 0).groupBy(*LOAD, "ordinal").agg(
        F.sum("n").alias("row_count"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"), F.lit(None).cast("double").alias("median")
    )
    loads = in_order(totals, builds).select(*LOAD, "ordinal", "first_load", "next_build", (F.col("row_count") - F.col("null_count")).alias("total"))
    share = F.col("n") / F.col("total")
    signed = F.array_compact(
        F.array(
            F.when(~F.col("first_load"), F.struct(F.col("build_id").alias("load"), share.alias("share"))),
            F.when(F.col("next_build").isNotNull(), F.struct(F.col("next_build").alias("load"), (-share).alias("share"))),
        )
    )
    return (
        _joined(held, loads, "inner")
        .select("table_id", "ordinal", "value", F.inline(signed))
        .groupBy("load", "table_id", "ordinal", "value")
        .agg(F.abs(F.sum("share")).alias("d"))
        .groupBy(F.col("load").alias("build_id"), "table_id", "ordinal")
        .agg((F.sum("d") / 2).alias("distance"))
    )


def changes(states: DataFrame, builds: DataFrame, rules=PRICE_LIST, recorded: DataFrame | None = None) -> DataFrame:
    """Metrics of every column of every load with the change since the table's previous load."""
    ordered = in_order(column_metrics(states, rules, recorded), builds)
    return _joined(ordered, share_distance(states, builds, rules), "left").drop("next_build")


def profile(rows: DataFrame, builds: DataFrame, rules: tuple[Constraint, ...] = PRICE_LIST, kept: DataFrame | None = None) -> DataFrame:
    """Metrics of every column of every load, with the change since the table's previous load.

    ``null_shift`` and ``distance`` are absolute differences, ``median_before`` is the median of the load before; all are
    null for a table's first load. ``kept`` holds the states of loads delivered before, whose rows aren't in
    ``rows`` and aren't read again.
    """
    states = column_states(rows, rules)
    if kept is not None:
        states = merge_states(kept, states)
    return changes(states, builds, rules)


def drifted(rules: tuple[Constraint, ...] = PRICE_LIST, null_shift=0.15, distance=DISTANCE, ratio=1.5) -> Column:
    """Whether a row of ``profile`` drifted; a tiny tolerance keeps exact ties on the reported side."""
    eps = TOLERANCE
    by_shares = F.col("ordinal").isin(*[r.ordinal for r in rules if r.drift == "shares"])
    by_median = F.col("ordinal").isin(*[r.ordinal for r in rules if r.drift == "median"])
    larger, smaller = F.greatest("median", "median_before"), F.least("median", "median_before")
    both = F.col("median").isNotNull() & F.col("median_before").isNotNull()
    drift = (
        (F.col("null_shift") >= null_shift - eps)
        | (by_shares & (F.col("distance") >= distance - eps))
        | (by_median & both & (larger >= ratio * smaller - eps))
    )
    return ~F.col("first_load") & F.coalesce(drift, F.lit(False))


def findings(rows: DataFrame, recorded: DataFrame, builds: DataFrame, rules=PRICE_LIST) -> DataFrame:
    """(build_id, table_id, ordinal, finding): where the recorded profile is wrong, cells don't fit or loads drift."""
    numeric = F.col("ordinal").isin(*[r.ordinal for r in rules if r.kind == "number"])

    def bound_differs(name: str) -> Column:
        noted = F.col(f"rec.{name}_value")
        as_number = number_of(noted)
        wrong_number = ~as_number.eqNullSafe(F.col(f"{name}_number")) | (noted.isNotNull() & as_number.isNull())
        return F.when(numeric, wrong_number).otherwise(~noted.eqNullSafe(F.col(f"{name}_text")))

    exact = F.coalesce(F.col("rec.distinct_is_exact"), F.lit(True))
    has = F.col("rec").isNotNull()
    tests = {
        "null_count": has & ~F.col("rec.null_count").eqNullSafe(F.col("null_count")),
        "distinct_estimate": has
        & F.when(exact, ~F.col("rec.distinct_estimate").eqNullSafe(F.col("distinct_count"))).otherwise(
            F.coalesce(F.col("rec.distinct_estimate") > F.col("distinct_count"), F.lit(False))
        ),
        "min_value": has & bound_differs("min"),
        "max_value": has & bound_differs("max"),
        "pattern": F.col("violations") > 0,
        "drift": drifted(rules),
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))
    return changes(column_states(rows, rules), builds, rules, recorded).select(*LOAD, "ordinal", F.explode(found).alias("finding"))


def control_limits(metrics: DataFrame, columns=("null_share", "distinct_count", "violations"), sigmas=3.0, least=3) -> DataFrame:
    """(build_id, table_id, ordinal, metric, value, mean, spread, anomaly): each metric against its own history.

    The limits come from the loads before the tested one, at least ``least`` of them; with fewer there is no verdict.
    A constant history has no spread, so any other value is an anomaly.
    """
    w = Window.partitionBy("table_id", "ordinal", "metric").orderBy("load_no").rowsBetween(Window.unboundedPreceding, -1)
    long = metrics.select(
        *LOAD,
        "ordinal",
        "load_no",
        F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])),
    )
    seen = (
        long.withColumn("history", F.count("value").over(w))
        .withColumn("mean", F.avg("value").over(w))
        .withColumn("spread", F.stddev_samp("value").over(w))
    )
    off = F.abs(F.col("value") - F.col("mean")) > sigmas * F.col("spread") + 1e-12
    return seen.select(
        *LOAD, "ordinal", "metric", "value", "mean", "spread",
        F.when(F.col("history") >= least, off).alias("anomaly"),
    )


def anomalies(metrics: DataFrame, **limits) -> DataFrame:
    """(build_id, table_id, ordinal, metric, value, mean, spread): the metrics outside their control limits."""
    return control_limits(metrics, **limits).where("anomaly").drop("anomaly")
