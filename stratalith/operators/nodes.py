"""Nodes of a document tree: the plain-text reader, whitespace policy, bodies and content-addressed objects.

Nodes have (id, artifact_id, parent_id, kind, ordinal, title, text, heading_path, line_start, line_end, metadata,
revision_hash, seq); ``ordinal`` is the position among siblings, ``seq`` the position in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith.functions.text import nfc

LONG_LINE = 20_000
EXACT_KINDS = ("code", "sheet", "row-group")


def _others(nodes: DataFrame) -> list[str]:
    return [c for c in nodes.columns if c not in ("id", "indexed_at")]


def revision_order(nodes: DataFrame) -> Column:
    """What tells the latest of several rows of one id: the largest."""
    return F.struct("indexed_at", F.xxhash64(*_others(nodes)))


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id, the one indexed last; null ids are left out."""
    others = _others(nodes)
    return (
        nodes.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max_by(F.struct(*others), revision_order(nodes)).alias("n"))
        .select("id", *[F.col(f"n.{c}").alias(c) for c in others])
    )


def line_feeds(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def split_paragraphs(documents: DataFrame, key: str = "artifact_id", text: str = "text") -> DataFrame:
    """(key, ordinal, text, line_start, line_end): paragraphs between blank lines, with 1-based lines.

    A paragraph is trimmed as a whole; a line of more than 20,000 characters is cut into paragraphs of that length.
    Null, empty and blank texts give no rows. Everything stays within the document's row until paragraphs are out:
    the numbers of the lines that open and close a paragraph come from comparing each line with its neighbours.
    """
    lines = F.split(line_feeds(F.col(text)), "\n", -1)
    split = documents.select(F.col(key), lines.alias("l")).withColumn(
        "full", F.transform("l", lambda line: F.length(F.regexp_replace(line, r"\s+", "")) > 0)
    )
    at = F.sequence(F.lit(1), F.size("l"))
    split = split.withColumn(
        "first", F.filter(at, lambda i: F.get("full", i - 1) & ~F.coalesce(F.get("full", i - 2), F.lit(False)))
    ).withColumn("last", F.filter(at, lambda i: F.get("full", i - 1) & ~F.coalesce(F.get("full", i), F.lit(False))))
    blocks = split.select(
        F.col(key), "l", F.inline(F.arrays_zip(F.col("first").alias("line_start"), F.col("last").alias("line_end")))
    ).select(
        F.col(key), "line_start", "line_end",
        F.slice("l", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1).alias("b"),
    )
    body = F.regexp_replace(F.array_join("b", "\n"), r"^\s+|\s+$", "")
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("body") - 1) / LONG_LINE).cast("int")),
        lambda i: F.substring(F.col("body"), i * LONG_LINE + 1, F.lit(LONG_LINE)),
    )
    cut = F.when(F.exists("b", lambda line: F.length(line) > LONG_LINE), pieces).otherwise(F.array("body"))
    return blocks.withColumn("body", body).select(
        F.col(key), "line_start", "line_end", F.posexplode(cut).alias("piece", "text")
    )


def normalized_text(kind: Column, text: Column) -> Column:
    """NFC, then by kind: exact kinds are trimmed only, documents keep runs of blanks, others collapse them."""
    t = line_feeds(nfc(text))
    ends = F.regexp_replace(t, r"[ \t]+(?=\n|$)", "")
    blanks = F.regexp_replace(ends, r"[ \t]{2,}", " ")
    chosen = F.when(kind.isin(*EXACT_KINDS), t).when(kind == "document", ends).otherwise(blanks)
    lines = F.when(kind.isin(*EXACT_KINDS), chosen).otherwise(F.regexp_replace(chosen, r"\n{3,}", "\n\n"))
    return F.regexp_replace(lines, r"^\s+|\s+$", "")


def revision(kind: Column, title: Column, text: Column) -> Column:
    """Hash of kind, title and text, joined by single spaces."""
    return F.sha2(F.concat(kind, F.lit(" "), F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))), 256)


def normalize_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with normalized texts; the revision hash is made anew where the text changed."""
    done = nodes.withColumn("plain", normalized_text(F.col("kind"), F.col("text")))
    return (
        done.withColumn(
            "revision_hash",
            F.when(F.col("plain").eqNullSafe(F.col("text")), F.col("revision_hash")).otherwise(
                revision(F.col("kind"), F.col("title"), F.col("plain"))
            ),
        )
        .withColumn("text", F.col("plain"))
        .drop("plain")
    )


def body_part(nodes: DataFrame) -> Column:
    """What a node adds to its artifact's body: a section its title with one ``#`` per level, others their text."""
    depth = F.greatest(F.size("heading_path"), F.lit(1))
    return F.when(F.col("kind") == "section", F.concat_ws(" ", F.repeat(F.lit("#"), depth), F.coalesce("title", F.lit("")))).otherwise(
        F.when(F.col("kind") != "document", F.col("text"))
    )


def render_bodies(nodes: DataFrame) -> DataFrame:
    """(artifact_id, body): parts in document order, blank lines between, a line feed at the end.

    A body is one value by definition, as large as its file.
    """
    part = body_part(nodes)
    return (
        nodes.select("artifact_id", "seq", part.alias("part"))
        .where(F.col("part").isNotNull() & (F.col("part") != ""))
        .groupBy("artifact_id")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "part"))).alias("p"))
        .select("artifact_id", F.concat(F.array_join(F.col("p.part"), "\n\n"), F.lit("\n")).alias("body"))
    )


def objects(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(hash, bytes, uses): one row per different body."""
    hashed = bodies.select(F.sha2(F.col(body), 256).alias("hash"), F.octet_length(body).alias("bytes"))
    return hashed.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("uses"))


def source_bounds(nodes: DataFrame) -> DataFrame:
    """(artifact_id, first_line, last_line) over nodes with text."""
    return nodes.where(F.col("text") != "").groupBy("artifact_id").agg(
        F.min("line_start").alias("first_line"), F.max("line_end").alias("last_line")
    )
