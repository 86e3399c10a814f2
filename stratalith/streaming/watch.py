"""Watching sources as a stream: every tick the sources are listed, and contents compared where the listing differs.

A stream of ticks drives the watch, not the arrival of files, so files that only disappear are noticed too. A tick costs a
listing; contents are hashed only if names, sizes or times differ from the last one, and what counts is the hash: a file
written again with the same bytes is no change. Changes are handed on once two ticks in a row see the same (a burst of
writes settles first). State is a table of fingerprints beside the checkpoints, a new one for each change, so a restart
goes on where it stopped.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stratalith import build as B
from stratalith.functions.globs import IgnoreRule
from stratalith.operators.lifecycle import full_compare
from stratalith.sources import files as S
from stratalith.sources.folders import folder_of

KNOWN = "relative_path string, content_hash string"


class Watch:
    """Calls ``on_change(changes, number)`` with (relative_path, change) rows whenever contents differ."""

    def __init__(
        self, spark: SparkSession, root: str, state: str, on_change: Callable[[DataFrame, int], None], interval: str = "2 seconds", rules: Sequence[IgnoreRule] = (),
        debounce: bool = False,
    ):
        self.spark, self.on_change, self.interval, self.rules, self.debounce = spark, on_change, interval, rules, debounce
        self.source, self.state = folder_of(root, spark), folder_of(state, spark)
        self.state.writable()
        self.pending: list | None = None

    def _known(self) -> DataFrame:
        last = json.loads(self.state.read("known.json") or "{}").get("table")
        return self.spark.read.parquet(self.state.url(last)) if last else self.spark.createDataFrame([], KNOWN)

    def settle(self, number: int) -> int:
        """Compare the sources with what is known of them; returns the number of changes handed on."""
        found = S.discover(self.spark, self.source, "watch", self.rules)
        listing = [[r[2], r[4], r[5]] for r in found if r[8] is None and r[9] is None]
        known = json.loads(self.state.read("known.json") or "{}")
        if listing == known.get("listing"):
            self.pending = None
            return 0
        if self.debounce and self.pending != listing:
            self.pending = listing
            return 0
        table = f"known-{known.get('number', 0) + 1}.parquet"
        now = S.facts(self.spark, found).select("relative_path", "content_hash")
        now.write.mode("overwrite").parquet(self.state.url(table))
        now = self.spark.read.parquet(self.state.url(table))
        changes = full_compare(self._known(), now, "relative_path", "content_hash").where("change <> 'unchanged'").select("relative_path", "change")
        n = changes.count()
        if n:
            self.on_change(changes, number)
        self.state.write("known.json", json.dumps({"table": table, "listing": listing, "number": known.get("number", 0) + 1}))
        if known.get("table"):
            self.state.delete(known["table"])
        return n

    def start(self, once: bool = False) -> StreamingQuery:
        """A stream whose every micro-batch settles; with ``once`` a single one."""
        ticks = self.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
        writer = ticks.writeStream.foreachBatch(lambda _, number: self.settle(number) and None).option("checkpointLocation", self.state.url("ticks"))
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=self.interval)
        return writer.start()


class Rebuilder:
    """Builds anew whenever a source changes; a build that newer changes have overtaken isn't activated."""

    def __init__(self, spark: SparkSession, state: B.State, config: B.Config, interval: str = "2 seconds"):
        self.spark, self.state, self.config = spark, state, config
        self.lock, self.latest = threading.Lock(), 0
        self.watches = [
            Watch(spark, root, state.folder.url(f"watch/{source}"), self._changed, interval, B.ignore_rules(folder_of(root, spark)), debounce=True)
            for source, root in config.sources.items()
        ]

    def _changed(self, changes: DataFrame, number: int) -> None:
        with self.lock:
            self.latest += 1
        self.rebuild(self.latest)

    def rebuild(self, turn: int) -> dict | None:
        """Build; activate only if no other change came in meanwhile."""
        manifest = B.build(self.spark, self.state, self.config, activate=False)
        with self.lock:
            if turn != self.latest:
                return None
            self.state.activate(manifest["build_id"])
        return manifest

    def run(self, once: bool = False) -> dict:
        """Watch until interrupted, or settle a single time; the pointer in the end."""
        if once:
            for w in self.watches:
                w.debounce = False
                w.settle(0)
        else:
            for q in [w.start() for w in self.watches]:
                q.awaitTermination()
        return {"build_id": self.state.active(), "generation": self.state.generation()}
