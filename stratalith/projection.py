"""A second home of builds: all projects and builds in one set of tables, partitioned by project and build.

A sealed build is projected as it is, each entity into one table under ``target`` with ``project_id`` and ``build_id`` as
partitions; projecting it again replaces just its own partitions. A receipt, written last, makes it visible; readers see
only builds with a receipt and read only their partitions. Builds that are no longer kept are taken out partition by
partition, the receipt first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.build import ENTITIES, BuildError, State, read
from stratalith.operators.index import SearchIndex
from stratalith.operators.lifecycle import preflight
from stratalith.session import at_once
from stratalith.sources.folders import folder_of

PROJECTED = (*ENTITIES, "totals")
RECEIPTS = "receipts"


def sizes(spark: SparkSession, state: State, build: str) -> DataFrame:
    """(entity, rows, bytes, verdict) of what projecting a build would write, as text."""
    every = None
    for entity in PROJECTED:
        df = read(spark, state, build, entity)
        one = df.select(F.lit(entity).alias("entity"), F.octet_length(F.to_json(F.struct("*"))).alias("bytes"))
        every = one if every is None else every.unionByName(one)
    return preflight(every)


def project(spark: SparkSession, state: State, build: str, target: str, project_id: str) -> dict:
    """Write a build's partitions and then its receipt; refused if it is too large."""
    found = {r["entity"]: r.asDict() for r in sizes(spark, state, build).collect()}
    if found["all"]["verdict"] == "refuse":
        raise BuildError(f"the build holds {found['all']['bytes']} bytes, too many to be projected")
    root = folder_of(target, spark).url()

    def put(df: DataFrame, entity: str) -> None:
        keyed = df.withColumn("project_id", F.lit(project_id)).withColumn("build_id", F.lit(build))
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "build_id").parquet(f"{root}/{entity}")

    at_once(*[lambda e=e: put(read(spark, state, build, e), e) for e in PROJECTED])
    rows = [(e, r["rows"], r["bytes"]) for e, r in found.items() if e != "all"]
    put(spark.createDataFrame(rows, "entity string, rows bigint, bytes bigint").coalesce(1), RECEIPTS)
    return {"project_id": project_id, "build_id": build, "bytes": found["all"]["bytes"], "rows": found["all"]["rows"], "verdict": found["all"]["verdict"]}


def projected(spark: SparkSession, target: str) -> DataFrame:
    """(project_id, build_id, entity, rows, bytes) of all visible builds."""
    return spark.read.parquet(f"{folder_of(target, spark).url()}/{RECEIPTS}")


def remote_read(spark: SparkSession, target: str, project_id: str, build: str, entity: str) -> DataFrame:
    """One entity of one projected build; the partitions of others aren't touched."""
    if projected(spark, target).where((F.col("project_id") == project_id) & (F.col("build_id") == build)).isEmpty():
        raise LookupError(f"{build!r} isn't projected for {project_id!r}")
    every = spark.read.parquet(f"{folder_of(target, spark).url()}/{entity}")
    return every.where((F.col("project_id") == project_id) & (F.col("build_id") == build)).drop("project_id", "build_id")


class RemoteIndex(SearchIndex):
    """Searches in a projected build."""

    def __init__(self, spark: SparkSession, target: str, project_id: str, build: str):
        self.target, self.project_id, self.build = target, project_id, build
        super().__init__(spark, folder_of(target, spark).url())

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = remote_read(self.spark, self.target, self.project_id, self.build, name)
        return self._tables[name]


def remote_prune(spark: SparkSession, target: str, project_id: str, kept: Sequence[str]) -> list[str]:
    """Take out the builds of a project that aren't kept; returns them."""
    folder = folder_of(target, spark)
    seen = projected(spark, target).where(F.col("project_id") == project_id).select("build_id").distinct().collect()
    gone = sorted(r["build_id"] for r in seen if r["build_id"] not in set(kept))
    for build in gone:
        for entity in (RECEIPTS, *PROJECTED):
            folder.delete(f"{entity}/project_id={project_id}/build_id={build}")
    return gone
