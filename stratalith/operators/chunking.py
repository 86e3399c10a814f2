"""Chunks: consecutive nodes of one heading path, packed up to a target size; oversized nodes are cut.

The fold is sequential only within a run of nodes with the same heading path. Runs are found without putting an
artifact into one task: nodes are compared with their predecessors within blocks of ``BLOCK`` positions, and the
blocks' ends with each other. Runs then stream through their tasks in document order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalith.constants import MAXIMUM_TOKENS, OVERLAP_TOKENS, TARGET_TOKENS, UNITS_PER_TOKEN
from stratalith.functions.text import estimate_tokens_py
from stratalith.session import ship

BLOCK = 10_000


def with_runs(nodes: DataFrame) -> DataFrame:
    """Nodes with ``run``: the seq of the first node of their run of equal heading paths.

    Only nodes with text take part, as only they enter chunks. Two levels: within blocks, then over the blocks' ends.
    """
    has = nodes.where((F.col("kind") != "document") & (F.col("text") != ""))
    has = has.withColumn("block", F.floor(F.col("seq") / BLOCK)).withColumn("path", F.xxhash64("heading_path"))
    inside = Window.partitionBy("artifact_id", "block").orderBy("seq", "id")
    marked = has.withColumn("before", F.lag("path").over(inside))
    start = F.when(F.col("before").isNotNull() & (F.col("before") != F.col("path")), F.col("seq"))
    marked = marked.withColumn("own", F.max(start).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy("artifact_id", "block").agg(
        F.min_by("path", F.struct("seq", "id")).alias("head"),
        F.max_by("path", F.struct("seq", "id")).alias("tail"),
        F.min("seq").alias("first_seq"),
        F.max("own").alias("last_start"),
    )
    across = Window.partitionBy("artifact_id").orderBy("block")
    ends = ends.withColumn("joins", F.coalesce(F.lag("tail").over(across) == F.col("head"), F.lit(False)))
    # Where the run in force at the block's begin started: the block itself, or an earlier start it carries on.
    opening = F.when(~F.col("joins"), F.col("first_seq"))
    latest = F.max(F.greatest(opening, F.col("last_start"))).over(across.rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("artifact_id", "block", F.coalesce(opening, latest, F.col("first_seq")).alias("carried"))
    return marked.join(carried, ["artifact_id", "block"]).withColumn("run", F.coalesce("own", "carried")).drop(
        "block", "path", "before", "own", "carried"
    )


def cut_places(text: str, budget: int, overlap: int, real_overlap: bool = False) -> Iterator[tuple[int, int]]:
    """Begin and end of the pieces of an oversized text: back to the last blank line, line end or space past the
    middle of a full piece. Sizes count UTF-16 units, places are characters, so no character is cut in two. Pieces don't
    overlap unless ``real_overlap`` is asked for."""
    most = math.floor(budget * UNITS_PER_TOKEN)
    shared = math.floor(min(overlap, budget / 2) * UNITS_PER_TOKEN) if real_overlap else 0
    units = None
    if not text.isascii():
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        units = np.r_[0, np.cumsum(1 + (codes > 0xFFFF))] if (codes > 0xFFFF).any() else None

    def unit(i: int) -> int:
        return i if units is None else int(units[i])

    def place(u: int) -> int:
        """The last character that begins at or before unit u."""
        return u if units is None else int(np.searchsorted(units, u, side="right")) - 1

    start = 0
    while start < len(text):
        end = min(len(text), max(start + 1, place(min(unit(len(text)), unit(start) + most))))
        if end < len(text):
            middle = unit(start) + (unit(end) - unit(start)) // 2
            for mark in ("\n\n", "\n", " "):
                at = text.rfind(mark, start, end)
                if at >= 0 and unit(at) > middle:
                    end = at + len(mark)
                    break
        yield start, end
        if end >= len(text):
            return
        start = max(place(unit(end) - shared), start + 1)


class _Pending:
    def __init__(self, node, tokens: int):
        self.path = list(node.heading_path)
        self.nodes: list[str] = []
        self.texts: list[str] = []
        self.tokens = tokens
        self.line_start = node.line_start
        self.line_end = node.line_end if node.line_end is not None else node.line_start

    def row(self, artifact: str, run: int, piece: int) -> tuple:
        prefix = " > ".join(self.path) + "\n\n" if self.path else ""
        text = prefix + "\n\n".join(self.texts)
        return (
            artifact, run, piece, self.nodes, self.path, text, estimate_tokens_py(text), self.line_start, self.line_end,
            hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
        )


class _Fold:
    """The state of one run; nodes come in document order."""

    def __init__(self, target: int, maximum: int, overlap: int, real_overlap: bool):
        self.target, self.maximum, self.overlap, self.real_overlap = target, maximum, overlap, real_overlap
        self.at: tuple | None = None
        self.pending: _Pending | None = None
        self.piece = 0

    def flush(self) -> Iterator[tuple]:
        if self.pending is not None and self.pending.texts:
            yield self.pending.row(*self.at, self.piece)
            self.piece += 1
        self.pending = None

    def add(self, node) -> Iterator[tuple]:
        at = (node.artifact_id, node.run)
        if at != self.at:
            yield from self.flush()
            self.at, self.piece = at, 0
        prefix = estimate_tokens_py(" > ".join(node.heading_path) + "\n\n") if len(node.heading_path) else 0
        tokens = estimate_tokens_py(node.text)
        if tokens + prefix > self.maximum:
            yield from self.flush()
            for begin, end in cut_places(node.text, max(1, self.maximum - prefix), self.overlap, self.real_overlap):
                piece = _Pending(node, 0)
                piece.nodes, piece.texts = [node.id], [node.text[begin:end]]
                yield piece.row(*self.at, self.piece)
                self.piece += 1
            return
        if self.pending is not None and self.pending.tokens + tokens > self.target:
            yield from self.flush()
        if self.pending is None:
            self.pending = _Pending(node, prefix)
        self.pending.nodes.append(node.id)
        self.pending.texts.append(node.text)
        self.pending.tokens += tokens
        if node.line_end is not None:
            self.pending.line_end = node.line_end


CHUNK_COLUMNS = (
    "artifact_id string, run bigint, piece int, node_ids array<string>, heading_path array<string>, text string, "
    "estimated_tokens int, line_start int, line_end int, revision_hash string"
)


def chunk_nodes(
    nodes: DataFrame, target: int = TARGET_TOKENS, maximum: int = MAXIMUM_TOKENS, overlap: int = OVERLAP_TOKENS, real_overlap: bool = False
) -> DataFrame:
    """Chunks (id, artifact_id, chunk_no, node_ids, heading_path, text, estimated_tokens, line_start, line_end,
    revision_hash) of nodes with one row per id.

    Nodes without text give none. ``chunk_no`` counts within the artifact in document order.
    """
    ship(nodes.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = _Fold(target, maximum, overlap, real_overlap)
        names = [c.split(" ")[0] for c in CHUNK_COLUMNS.split(", ")]
        for pdf in batches:
            rows = []
            for name in ("line_start", "line_end"):
                pdf[name] = pdf[name].astype(object).where(pdf[name].notna(), None)
            for node in pdf.itertuples(index=False):
                rows.extend(fold.add(node))
            yield _typed(rows, names)
        yield _typed(list(fold.flush()), names)

    def _typed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        for name in ("line_start", "line_end"):
            out[name] = out[name].astype("Int32")
        return out

    kept = with_runs(nodes).select("artifact_id", "run", "seq", "id", "heading_path", "text", "line_start", "line_end")
    pieces = kept.repartition("artifact_id", "run").sortWithinPartitions("artifact_id", "run", "seq", "id").mapInPandas(run, CHUNK_COLUMNS)
    # The number of a chunk needs only the counts of the runs before its own.
    counts = pieces.groupBy("artifact_id", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("artifact_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("artifact_id", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = pieces.join(offsets, ["artifact_id", "run"]).withColumn("chunk_no", (F.col("offset") + F.col("piece")).cast("int"))
    return numbered.select(
        F.concat_ws("@", "artifact_id", F.col("chunk_no").cast("string")).alias("id"), "artifact_id", "chunk_no", "node_ids",
        "heading_path", "text", "estimated_tokens", "line_start", "line_end", "revision_hash",
    )
