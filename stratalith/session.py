"""Session helpers: table access, lineage cuts in the shared folder, shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_SHIPPED: set[str] = set()


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stratalith")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STRATALITH_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SMALL: dict[str, SparkSession] = {}


def small_session(spark: SparkSession) -> SparkSession:
    """A session of the same application for a few hundred rows at a time: one partition, and no code generated for
    plans that are done before it would be compiled."""
    application = spark.sparkContext.applicationId
    if application not in _SMALL:
        small = spark.newSession()
        for key, value in (("shuffle.partitions", "1"), ("adaptive.enabled", "false"), ("codegen.wholeStage", "false"), ("codegen.factoryMode", "NO_CODEGEN"), ("session.timeZone", "UTC")):
            small.conf.set(f"spark.sql.{key}", value)
        _SMALL[application] = small
    return _SMALL[application]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that don't share the driver's file system.

    In local mode the Python workers already see it. Elsewhere the package goes out once per application
    through ``addPyFile``, which also serves executors that join later.
    """
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="stratalith-")) / "stratalith_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder (``spark.checkpoint.dir``); set an own one only where none is named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        sc.setCheckpointDir(named)
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="stratalith-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """Where tables of this application may be kept: the checkpoint folder, which all executors see."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, size, time) of the files of a table, as the file system lists them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, listed = [], fs.listFiles(hadoop, True)
    while listed.hasNext():
        f = listed.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint, which outlives any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def at_once(*jobs: Callable[[], T], most: int = 4) -> list[T]:
    """The results of independent jobs, a few of them running at a time: small ones leave no core idle."""
    session = SparkSession.getActiveSession()
    within = inheritable_thread_target(session) if session is not None else (lambda job: job)
    with ThreadPoolExecutor(most) as pool:
        return [f.result() for f in [pool.submit(within(job)) for job in jobs]]
