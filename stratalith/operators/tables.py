"""Typed tables: conservative type inference, column statistics, names and descriptions.

Cells come as text. A type is given only if every cell that isn't null agrees; whatever is ambiguous stays text.
All columns of all tables are judged in one shared aggregate over (table, column).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith import constants as C
from stratalith.functions.hashing import slug_column, table_sql_name_column
from stratalith.functions.text import trimmed


def is_null_token(c: Column) -> Column:
    return c.isNull() | F.lower(trimmed(c)).isin(*C.NULL_TOKENS)


def is_boolean(c: Column) -> Column:
    return F.lower(c).isin("true", "false")


def is_date(c: Column) -> Column:
    """An ISO date, or date and time, of a real calendar day."""
    shape = c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return shape & F.substring(c, 1, 10).try_cast("date").isNotNull()


def is_integer(c: Column) -> Column:
    """No sign but minus, no leading zero, within the integers a double holds exactly."""
    shape = c.rlike(r"^-?(0|[1-9]\d{0,15})$")
    value = c.try_cast("bigint")
    return shape & (F.abs(value) <= C.SAFE_INTEGER)


def is_real(c: Column) -> Column:
    shape = c.rlike(r"^-?(0|[1-9]\d*)?(\.\d+)?([eE][+-]?\d+)?$") & c.rlike(r"\d") & ~c.rlike("^-?[eE]")
    value = c.try_cast("double")
    finite = value.isNotNull() & (F.abs(value) < float("inf"))
    return shape & finite & (~c.rlike(r"^-?\d+$") | is_integer(c))


def infer_type(cell: str = "cell") -> Column:
    """Aggregate: the first of boolean, date, integer, real that all cells satisfy; unknown without any cell."""
    c = trimmed(F.col(cell))
    held = ~is_null_token(F.col(cell))

    def all_(test: Column) -> Column:
        return F.coalesce(F.bool_and(F.when(held, test)), F.lit(False))

    return (
        F.when(F.count_if(held) == 0, "unknown")
        .when(all_(is_boolean(c)), "boolean")
        .when(all_(is_date(c)), "date")
        .when(all_(is_integer(c)), "integer")
        .when(all_(is_real(c)), "real")
        .otherwise("text")
    )


def long_cells(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys..., ordinal, column_name, cell): one row per cell, ordinals from 1."""
    cells = [
        F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("cell"))
        for i, c in enumerate(columns)
    ]
    return rows.select(*keys, F.inline(F.array(*cells)))


def column_statistics(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., ordinal, column_name, type, nullable, null_count, distinct_estimate, distinct_is_exact, min_value,
    max_value) of long cells.

    Up to 10,000 different values are counted exactly, beyond that 10,000 is reported as inexact. Bounds follow the
    type: numbers as numbers, others by code point; they are given as text in the cell's own spelling of the number.
    """
    group = [*keys, "ordinal", "column_name"]
    plain = cells.withColumn("cell", F.when(~is_null_token(F.col("cell")), trimmed(F.col("cell"))))
    counts = plain.groupBy(*group, "cell").agg(F.count(F.lit(1)).alias("n"))
    number = F.when(is_real(F.col("cell")), F.col("cell").try_cast("double"))
    stats = counts.groupBy(*group).agg(
        infer_type("cell").alias("type"),
        F.coalesce(F.sum(F.when(F.col("cell").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("cell").alias("distinct_all"),
        F.min("cell").alias("min_text"),
        F.max("cell").alias("max_text"),
        F.min(F.when(number.isNotNull(), F.struct(number.alias("v"), "cell"))).alias("min_number"),
        F.max(F.when(number.isNotNull(), F.struct(number.alias("v"), "cell"))).alias("max_number"),
    )
    numeric = F.col("type").isin("integer", "real")
    return stats.select(
        *group,
        "type",
        (F.col("null_count") > 0).alias("nullable"),
        "null_count",
        F.least("distinct_all", F.lit(C.DISTINCT_LIMIT)).alias("distinct_estimate"),
        (F.col("distinct_all") <= C.DISTINCT_LIMIT).alias("distinct_is_exact"),
        F.when(numeric, F.col("min_number.cell")).otherwise(F.col("min_text")).alias("min_value"),
        F.when(numeric, F.col("max_number.cell")).otherwise(F.col("max_text")).alias("max_value"),
    )


def type_widened(cells: DataFrame, keys: Sequence[str], row: str, sample: int = C.INFERENCE_SAMPLE) -> DataFrame:
    """(keys..., ordinal, column_name, sample_type, type): columns whose sampled type later cells contradict."""
    group = [*keys, "ordinal", "column_name"]
    head = cells.where(F.col(row) <= sample).groupBy(*group).agg(infer_type().alias("sample_type"))
    whole = cells.groupBy(*group).agg(infer_type().alias("type"))
    return head.join(whole, group).where("sample_type <> type")


def typed(column: Column, kind: str) -> Column:
    """A cell as a value of its inferred type; null tokens are null; dates stay text."""
    c = F.when(~is_null_token(column), trimmed(column))
    if kind == "boolean":
        return F.lower(c) == "true"
    if kind == "integer":
        return c.try_cast("bigint")
    if kind == "real":
        return c.try_cast("double")
    return c


def sql_names(tables: DataFrame, table_id: str = "table_id", name: str = "table_name") -> DataFrame:
    return tables.withColumn("sql_name", table_sql_name_column(F.col(table_id), F.col(name)))


def column_sql_names(columns: DataFrame) -> DataFrame:
    s = F.substring(slug_column(F.col("column_name")), 1, 40)
    number = F.concat(F.lit("c_"), F.col("ordinal").cast("string"))
    return columns.withColumn("sql_name", F.when(s == "", number).otherwise(F.concat_ws("_", number, s)))


def describe(columns: DataFrame, keys: Sequence[str], row_count: Column) -> DataFrame:
    """(keys..., description): the text by which a table is found: name, rows, columns with their types."""
    listed = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "type"))),
            lambda x: F.concat(x["column_name"], F.lit(" ("), x["type"], F.lit(")")),
        ),
        ", ",
    )
    return columns.groupBy(*keys).agg(
        F.concat(F.lit("Table with "), F.max(row_count).cast("string"), F.lit(" rows. Columns: "), listed).alias("description")
    )


def unify_kinds(kinds: Sequence[str]) -> str:
    """Type of a spreadsheet column from the kinds of its cells: integer and real give real, any other mix text."""
    held = {k for k in kinds if k != "null"}
    if not held:
        return "unknown"
    if "error" in held:
        return "text"
    if len(held) == 1:
        return held.pop()
    return "real" if held == {"integer", "real"} else "text"
