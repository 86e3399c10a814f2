"""Reading a source back: the whole body, a line range, or everything under a heading, with an exact locator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.constants import READ_CHARACTERS

BLOCK = 1_000


def locator(artifact: Column, path: Column, heading_path: Column, line_start: Column, line_end: Column, page: Column | None = None) -> Column:
    """Provenance of a result; coordinates that aren't positive are left out (null)."""
    return F.struct(
        artifact.alias("artifact_id"),
        path.alias("relative_path"),
        F.when(F.size(heading_path) > 0, heading_path).alias("heading_path"),
        F.when(line_start > 0, line_start).alias("line_start"),
        F.when(line_end > 0, line_end).alias("line_end"),
        (F.when(page > 0, page) if page is not None else F.lit(None).cast("int")).alias("page"),
    )


def in_range(from_line: int | None = None, to_line: int | None = None, heading: Sequence[str] | Column | None = None) -> Column:
    """Nodes with text under a heading-path prefix whose lines intersect the range. The prefix may be a column, so that
    each artifact is read under a heading of its own."""
    keep = F.col("text").isNotNull() & (F.col("text") != "")
    if isinstance(heading, Column):
        keep = keep & (F.slice("heading_path", F.lit(1), F.size(heading)) == heading)
    elif heading:
        keep = keep & (F.slice("heading_path", 1, len(heading)) == F.array(*[F.lit(h) for h in heading]))
    if from_line is not None:
        keep = keep & (F.col("line_end") >= from_line)
    if to_line is not None:
        keep = keep & (F.col("line_start") <= to_line)
    return keep


def read_nodes(nodes: DataFrame, **where) -> DataFrame:
    """(artifact_id, seq, id, text, line_start, line_end) in the range, of every artifact given; order by seq."""
    return nodes.where(in_range(**where)).select("artifact_id", "seq", "id", "heading_path", "text", "line_start", "line_end")


def read_ranges(nodes: DataFrame, most: int = READ_CHARACTERS, block: int = BLOCK, **where) -> DataFrame:
    """(artifact_id, text, truncated, line_start, line_end): the read of each artifact, cut at ``most`` characters.

    Whatever lies past the cut isn't gathered: nodes count only while the characters before them leave room. Those are
    summed in two levels, within blocks of ``block`` positions and over the blocks, and blocks that begin past the cut go
    no further, so an artifact of any size is spread over tasks and what meets in one is bounded by the cut and a block.
    """
    got = read_nodes(nodes, **where).withColumn("block", F.floor(F.col("seq") / block))
    per_artifact = Window.partitionBy("artifact_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = got.groupBy("artifact_id", "block").agg(
        F.sum(F.length("text") + 2).alias("n"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end")
    ).withColumn("offset", F.coalesce(F.sum("n").over(per_artifact), F.lit(0)))
    ends = blocks.groupBy("artifact_id").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), (F.sum("n") - 2).alias("whole"))
    first = got.join(blocks.where(F.col("offset") < most).select("artifact_id", "block", "offset"), ["artifact_id", "block"])
    inside = Window.partitionBy("artifact_id", "block").orderBy("seq", "id").rowsBetween(Window.unboundedPreceding, -1)
    sized = first.withColumn("before", F.col("offset") + F.coalesce(F.sum(F.length("text") + 2).over(inside), F.lit(0)))
    near = sized.where(F.col("before") < most).groupBy("artifact_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "id", "text"))).alias("l")
    )
    return near.join(ends, "artifact_id").select(
        "artifact_id",
        F.substring(F.array_join(F.col("l.text"), "\n\n"), 1, most).alias("text"),
        (F.col("whole") > most).alias("truncated"),
        "line_start",
        "line_end",
    )
