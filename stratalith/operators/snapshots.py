"""What changed between full snapshots: validity intervals by gaps-and-islands, change events from their ends.

Every delivered snapshot is a full listing of (record_kind, record_key, row_hash). Equal consecutive states of a key
form an island: an interval [first_ord, last_ord] in which the record was valid and unchanged. Change events read off
the interval ends: a start without an adjacent earlier interval is ``added``, an end without an adjacent later one is
``removed``, and two adjacent intervals are ``changed``.

Defined cases: rows with a null key or of an unknown build are ignored; of several rows of one record in one snapshot
the one with the latest ``delivered_at`` counts (null times are oldest, ties go to the larger row hash, so repeated
rows count once); an empty table gives no rows; extra columns are ignored. The first snapshot is compared with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions.text import nfc

KEY = ["record_kind", "record_key"]


def plain_path(path: Column) -> Column:
    """``/`` as separator, no leading ``./``, NFC."""
    return nfc(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./+)+", ""))


def plain_hash(h: Column) -> Column:
    """Letter case and a leading ``sha256:`` don't count."""
    return F.regexp_replace(F.lower(h), "^sha256:", "")


def row_hash(*columns: Column) -> Column:
    """64-bit hash of the columns; a null differs from every value, the empty one too."""
    marked = []
    for c in columns:
        marked += [c.isNull(), c]
    return F.xxhash64(*marked)


def build_order(builds: DataFrame) -> DataFrame:
    """(build_id, ord) of the sealed builds by creation; one row per build."""
    sealed = builds.where(F.col("state") == "sealed").groupBy("build_id").agg(F.min("created_at").alias("created_at"))
    return sealed.select("build_id", F.row_number().over(Window.orderBy("created_at", "build_id")).alias("ord"))


def latest_states(states: DataFrame, order: DataFrame) -> DataFrame:
    """states(record_kind, build_id, record_key, row_hash, delivered_at) to one row per kind, key and snapshot."""
    kept = states.where(F.col("record_key").isNotNull()).join(order, "build_id")
    latest = F.max(F.struct("delivered_at", "row_hash"))["row_hash"].alias("row_hash")
    return kept.groupBy(*KEY, "ord").agg(latest)


def validity_intervals(states: DataFrame) -> DataFrame:
    """(record_kind, record_key, row_hash, first_ord, last_ord): maximal runs of equal consecutive states."""
    w = Window.partitionBy(*KEY).orderBy("ord")
    fresh = ~(
        (F.lag("ord").over(w) == F.col("ord") - 1) & (F.lag("row_hash").over(w) == F.col("row_hash"))
    )
    starts = states.withColumn("starts", F.coalesce(fresh, F.lit(True)).cast("int"))
    islands = starts.withColumn("island", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*KEY, "island").agg(
        F.first("row_hash").alias("row_hash"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")
    )


def change_events(intervals: DataFrame) -> DataFrame:
    """(record_kind, record_key, to_ord, change_type) from interval starts, ends and adjacencies.

    An interval that reaches the last snapshot yields a ``removed`` one past it; joining with the steps between
    snapshots drops that, so the number of snapshots needn't be known here.
    """
    w = Window.partitionBy(*KEY).orderBy("first_ord")
    seen = intervals.withColumn("before", F.lag("last_ord").over(w)).withColumn("after", F.lead("first_ord").over(w))
    start = F.when(
        F.col("first_ord") > 1,
        F.struct(
            F.col("first_ord").alias("to_ord"),
            F.when(F.col("before") == F.col("first_ord") - 1, "changed").otherwise("added").alias("change_type"),
        ),
    )
    end = F.when(
        ~(F.coalesce(F.col("after"), F.lit(-1)) == F.col("last_ord") + 1),
        F.struct((F.col("last_ord") + 1).alias("to_ord"), F.lit("removed").alias("change_type")),
    )
    return seen.select(*KEY, F.explode(F.array_compact(F.array(start, end))).alias("e")).select(
        *KEY, "e.to_ord", "e.change_type"
    )


def artifact_states(artifacts: DataFrame) -> DataFrame:
    """Two states per row: the content under kind ``artifact``, the declared fields under kind ``rule``."""
    rows = artifacts.select(
        "build_id",
        "delivered_at",
        plain_path(F.col("relative_path")).alias("record_key"),
        row_hash(plain_hash(F.col("content_hash"))).alias("content"),
        row_hash(
            F.col("status"), F.col("authority"), F.array_sort(F.array_distinct(F.coalesce("supersedes", F.array().cast("array<string>"))))
        ).alias("declared"),
    )
    both = F.array(
        F.struct(F.lit("artifact").alias("record_kind"), F.col("content").alias("row_hash")),
        F.struct(F.lit("rule").alias("record_kind"), F.col("declared").alias("row_hash")),
    )
    return rows.select("build_id", "delivered_at", "record_key", F.inline(both))


def chunk_states(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        F.lit("chunk").alias("record_kind"),
        "build_id",
        F.col("id").alias("record_key"),
        row_hash(plain_hash(F.col("revision_hash"))).alias("row_hash"),
        "delivered_at",
    )


def table_states(tables: DataFrame) -> DataFrame:
    return tables.select(
        F.lit("table").alias("record_kind"),
        "build_id",
        F.col("table_id").alias("record_key"),
        row_hash(F.col("table_name"), F.col("row_count"), F.col("column_names")).alias("row_hash"),
        "delivered_at",
    )


def snapshot_intervals(artifacts: DataFrame, chunks: DataFrame, tables: DataFrame, builds: DataFrame) -> DataFrame:
    states = artifact_states(artifacts).unionByName(chunk_states(chunks)).unionByName(table_states(tables))
    return validity_intervals(latest_states(states, build_order(builds)))


def snapshot_changes(artifacts: DataFrame, chunks: DataFrame, tables: DataFrame, builds: DataFrame) -> DataFrame:
    """(record_kind, from_build, to_build, record_key, change_type) for every two consecutive sealed builds.

    ``rule`` rows exist only as ``changed``: both builds hold the path and its declared fields differ.
    """
    order = build_order(builds)
    w = Window.orderBy("ord")  # over the list of builds, a handful of rows
    steps = order.select(
        F.col("ord").alias("to_ord"), F.col("build_id").alias("to_build"), F.lag("build_id").over(w).alias("from_build")
    ).where(F.col("from_build").isNotNull())
    events = change_events(snapshot_intervals(artifacts, chunks, tables, builds))
    kept = events.where((F.col("record_kind") != "rule") | (F.col("change_type") == "changed"))
    return kept.join(steps, "to_ord").select("record_kind", "from_build", "to_build", "record_key", "change_type")
