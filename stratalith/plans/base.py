"""What several groups of queries share: entities read from the tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith import constants as C
from stratalith.functions.hashing import artifact_id, sha256
from stratalith.operators import batch as M
from stratalith.operators import lifecycle as L
from stratalith.operators.index import SearchIndex
from stratalith.operators.nodes import latest_nodes, revision_order
from stratalith.session import exists, files_of, shared_folder, table

_INDEXES: dict[str, SearchIndex] = {}


def nodes(spark, d) -> DataFrame:
    return latest_nodes(table(spark, d, "nodes"))


def documents(spark, d) -> DataFrame:
    """Documents as artifacts: ``artifact_id`` is source and path."""
    return table(spark, d, "documents").withColumn("artifact_id", artifact_id(F.col("source"), F.col("relative_path")))


def sealed_builds(spark, d) -> list[str]:
    """Sealed builds by creation: a handful of rows of the registry."""
    rows = table(spark, d, "builds").where("state = 'sealed'").orderBy("created_at", "build_id").select("build_id").collect()
    return [r["build_id"] for r in rows]


def artifacts(spark, d) -> DataFrame:
    return L.artifacts_of(table(spark, d, "snapshot_artifacts"))


def last_two(spark, d) -> tuple[str, str]:
    builds = sealed_builds(spark, d)
    return builds[-2], builds[-1]


def indexed() -> list[Column]:
    """The indexed columns of a chunk, of its node."""
    path = F.regexp_replace("artifact_id", "^[^:]*:", "").alias("path")
    return [path, F.col("title"), F.array_join("heading_path", " ").alias("heading"), F.col("text").alias("body")]


def chunks(spark, d) -> DataFrame:
    """Nodes with text as chunks of the index; status and authority as the last sealed build declares them."""
    declared = L.of_build(artifacts(spark, d), sealed_builds(spark, d)[-1]).select(
        F.col("id").alias("artifact_id"), "status", "authority"
    )
    return (
        nodes(spark, d)
        .where(F.col("text") != "")
        .select(
            F.col("id").alias("chunk_id"),
            "artifact_id",
            *indexed(),
            "heading_path",
            "line_start",
            "line_end",
        )
        .join(declared, "artifact_id", "left")
        .withColumn("status", F.coalesce("status", F.lit(C.DEFAULT_STATUS)))
        .withColumn("authority", F.coalesce("authority", F.lit(C.DEFAULT_AUTHORITY)))
    )


def search_index(spark, d) -> SearchIndex:
    """The index of the chunks, written when it is first asked for and read from then on; a change of the tables' files
    gives another one. Beside its own tables it holds the chunks, sorted by id."""
    seen = [files_of(spark, f"{d}/{name}.parquet") for name in ("nodes", "snapshot_artifacts", "builds")]
    root = f"{shared_folder(spark)}/index-{sha256(repr(seen))[:24]}"
    if root not in _INDEXES:
        if not exists(spark, f"{root}/totals.parquet/_SUCCESS"):
            gone = superseded(spark, d).withColumn("superseded", F.lit(True))
            held = chunks(spark, d).join(gone, "artifact_id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))
            held = held.repartition("chunk_id").sortWithinPartitions("chunk_id")
            held.write.mode("overwrite").option("parquet.block.size", 8 * 1024 * 1024).parquet(f"{root}/chunks.parquet")
            SearchIndex.write(spark.read.parquet(f"{root}/chunks.parquet"), root)
        _INDEXES[root] = SearchIndex(spark, root)
    return _INDEXES[root]


def phrase_rows(spark, d, phrases) -> tuple[DataFrame, int]:
    """The chunks as rows of the phrases they hold, in so many samples; kept as the index is, for the same phrases.

    Every delivered row of a node is read to its phrases first, so that which one is the latest is told among small rows.
    """
    rows = table(spark, d, "nodes")
    samples = M.samples_of(rows.count())
    seen = (files_of(spark, f"{d}/nodes.parquet"), phrases)
    root = f"{shared_folder(spark)}/phrases-{sha256(repr(seen))[:24]}"
    if not exists(spark, f"{root}/_SUCCESS"):
        texts = rows.select(
            F.col("id").alias("chunk_id"), revision_order(rows).alias("revision"), (F.col("text") != "").alias("held"),
            *indexed(),
        )
        latest = (
            M.phrase_rows(texts.where(F.col("chunk_id").isNotNull()), phrases)
            .groupBy("chunk_id")
            .agg(F.max_by(F.struct("held", "dl", "keys", "tfs"), "revision").alias("n"))
            .where("n.held")
            .select("chunk_id", "n.dl", "n.keys", "n.tfs", M.sample_of(samples).alias("sample"))
        )
        latest.write.mode("overwrite").partitionBy("sample").parquet(root)
    # Without a single chunk there is no file to read the schema from.
    return spark.read.schema("chunk_id string, dl int, keys array<int>, tfs array<float>, sample int").parquet(root), samples


def superseded(spark, d) -> DataFrame:
    """Artifacts that an artifact of the last sealed build supersedes."""
    last = L.of_build(artifacts(spark, d), sealed_builds(spark, d)[-1])
    return last.select(F.explode("supersedes").alias("artifact_id")).distinct()


def candidates(spark, d) -> DataFrame:
    """The candidates of every report: one row per report and chunk, the best-ranked one."""
    hits = table(spark, d, "dropped_hits")
    fields = [
        "hit_rank", "task_text", "artifact_id", "relative_path", "title", "heading_path", "text", "excerpt", "status",
        "authority", "estimated_tokens", "bm25",
    ]
    return (
        hits.groupBy("report_id", "chunk_id")
        .agg(F.min(F.struct(*fields)).alias("r"))
        .select(
            F.col("report_id").alias("query_id"), F.col("r.task_text").alias("query"), "chunk_id",
            *[F.col(f"r.{f}").alias(f) for f in fields if f not in ("hit_rank", "task_text", "text", "excerpt")],
            F.coalesce("r.text", "r.excerpt").alias("text"),
        )
    )


SPACE = r"[\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def normalize_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    return rf"regexp_extract_all(lower(strip_accents({x})), '[\p{{L}}\p{{N}}]+')"


def units_sql(x: str) -> str:
    return rf"(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def estimate_sql(x: str) -> str:
    return f"CAST(greatest(ceil({units_sql(x)} / 3.6::DOUBLE), len(list_filter(regexp_split_to_array({x}, '{SPACE}'), lambda w: w <> ''))) AS INTEGER)"


NODES = "n AS (SELECT * EXCLUDE (indexed_at) FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) = 1)"

PATH = r"nfc_normalize(regexp_replace(replace(relative_path, '\', '/'), '^(\./+)+', ''))"

ARTIFACTS = rf"""
arts AS (
  SELECT * EXCLUDE (relative_path, content_hash, delivered_at), {PATH} AS relative_path,
         regexp_replace(lower(content_hash), '^sha256:', '') AS content_hash
  FROM snapshot_artifacts QUALIFY row_number() OVER (PARTITION BY build_id, {PATH} ORDER BY delivered_at DESC) = 1),
ordered AS (SELECT build_id, row_number() OVER (ORDER BY created_at DESC, build_id DESC) AS back FROM builds WHERE state = 'sealed'),
b1 AS (SELECT arts.* FROM arts JOIN ordered USING (build_id) WHERE back = 2),
b2 AS (SELECT arts.* FROM arts JOIN ordered USING (build_id) WHERE back = 1)"""

CHUNKS = rf"""
{NODES},
{ARTIFACTS},
chunks AS (
  SELECT n.id AS chunk_id, n.artifact_id, regexp_replace(n.artifact_id, '^[^:]*:', '') AS path, n.title,
         array_to_string(heading_path, ' ') AS heading, n.text AS body, coalesce(b2.status, 'active') AS status,
         coalesce(b2.authority, 50) AS authority, heading_path
  FROM n LEFT JOIN b2 ON b2.id = n.artifact_id WHERE n.text <> ''),
toks AS (
  SELECT chunk_id, artifact_id, path, status, {tokens_sql("coalesce(path, '')")} AS tp, {tokens_sql("coalesce(title, '')")} AS tt,
         {tokens_sql("coalesce(heading, '')")} AS th, {tokens_sql("coalesce(body, '')")} AS tb FROM chunks),
sized AS (SELECT *, len(tp) + len(tt) + len(th) + len(tb) AS dl FROM toks)"""

CANDIDATES = """
cands AS (
  SELECT report_id AS query_id, task_text AS query, chunk_id, artifact_id, relative_path, title, heading_path,
         coalesce(text, excerpt) AS text, status, authority, estimated_tokens, bm25
  FROM dropped_hits QUALIFY row_number() OVER (PARTITION BY report_id, chunk_id ORDER BY hit_rank) = 1)"""
