"""The seven read capabilities over a sealed build: describe, search, context, read, list, describe and query tables; and
views for inspecting one.

Every call resolves the active build once and reads only from it; each answer carries the build's id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith import constants as C
from stratalith.build import BuildError, State
from stratalith.operators import context as X
from stratalith.operators import index as I
from stratalith.operators import ranges, ranking
from stratalith.operators import tables as T
from stratalith.plans.sqlsurface import execute


#: Views for inspection: entity, columns shown, order.
VIEWS = {
    "artifacts": ("artifacts", "artifact_id relative_path parser status authority byte_size content_hash", "artifact_id"),
    "nodes": ("nodes", "artifact_id seq id kind title heading_path line_start line_end revision_hash", "artifact_id seq"),
    "chunks": ("chunks", "artifact_id chunk_no chunk_id heading_path estimated_tokens line_start line_end", "artifact_id chunk_no"),
    "tables": ("tables", "artifact_id table_id table_name sheet cell_range sql_name row_count", "table_id"),
    "columns": ("columns", "table_id ordinal column_name sql_name type nullable null_count distinct_estimate distinct_is_exact min_value max_value", "table_id ordinal"),
    "warnings": ("warnings", "code class path message", "code path"),
    "objects": ("objects", "hash body", "hash"),
}
#: Indexes kept open by a runtime; a build never changes, so what is known of it doesn't either.
OPEN_INDEXES = 8


class Runtime:
    def __init__(self, spark: SparkSession, state: State | str | Path):
        self.spark, self.state = spark, state if isinstance(state, State) else State(state, spark)
        self._indexes: dict[str, I.SearchIndex] = {}

    def _build(self) -> str:
        build = self.state.active()
        if build is None:
            raise BuildError("no build is active")
        return build

    def _read(self, build: str, entity: str) -> DataFrame:
        return self._index(build).table(entity)

    def _index(self, build: str) -> I.SearchIndex:
        if build not in self._indexes:
            while len(self._indexes) >= OPEN_INDEXES:
                self._indexes.pop(next(iter(self._indexes)))
            self._indexes[build] = I.SearchIndex(self.spark, self.state.url(build))
        return self._indexes[build]

    def describe_build(self) -> dict:
        build = self._build()
        manifest = self.state.manifest(build)
        warned = self._read(build, "warnings").groupBy("code").count().orderBy("code").collect()
        return {"build_id": build, "counts": manifest["counts"], "capabilities": manifest["capabilities"], "warnings": {r["code"]: r["count"] for r in warned}}

    def inspect(self, view: str, artifact: str | None = None, limit: int = 100) -> dict:
        """Rows of one of ``VIEWS`` of the active build or of the rules' results, of one artifact (id or path) if named."""
        build = self._build()
        if view == "supersessions":
            over = self._read(build, "supersessions")
            rows = over.groupBy("artifact_id").agg(F.array_join(F.array_sort(F.collect_set("superseded_id")), ",").alias("supersedes"))
            order = "artifact_id"
        elif view == "rules":
            declared = (F.col("status") != C.DEFAULT_STATUS) | (F.col("authority") != C.DEFAULT_AUTHORITY)
            rows, order = self._read(build, "artifacts").where(declared).select("artifact_id", "relative_path", "status", "authority"), "artifact_id"
        elif view in VIEWS:
            entity, columns, order = VIEWS[view]
            rows = self._read(build, entity).select(*columns.split())
            if entity == "objects":
                rows = rows.select("hash", F.octet_length("body").alias("bytes"))
        else:
            raise LookupError(f"{view!r} is no view; there are {', '.join(sorted([*VIEWS, 'rules', 'supersessions']))}")
        if artifact is not None and "artifact_id" in rows.columns:
            ids = self._read(build, "artifacts").where((F.col("artifact_id") == artifact) | (F.col("relative_path") == artifact)).select("artifact_id")
            rows = rows.join(ids, "artifact_id", "left_semi")
        got = rows.orderBy(*order.split()).limit(limit + 1).collect()
        return {"build_id": build, "view": view, "rows": [r.asDict() for r in got[:limit]], "truncated": len(got) > limit}

    def _candidates(self, build: str, query: str, depth: int, path, extension, artifact, statuses) -> DataFrame:
        """The best chunks by weighted BM25 as the index tells them; the texts of these few are fetched last."""
        index = self._index(build)
        chunks = self._read(build, "chunks")
        where = (path, extension, artifact, statuses)
        within = I.filtered(chunks, *where) if any(x is not None for x in where) else None
        best = I.top_k(index.bm25(query, "all", within), depth).collect()
        if not best and len(I.query_phrases(query)) > 1:
            best = I.top_k(index.bm25(query, "any", within), depth).collect()
        return I.fetched(chunks, best)

    def _ranked(self, build: str, query: str, limit: int, depth: int, **where) -> tuple[DataFrame, DataFrame]:
        """(candidates, the same ranked): at most ``depth`` rows, which lie in one partition."""
        rows = self._candidates(build, query, depth, where.get("path"), where.get("extension"), where.get("artifact"), where.get("statuses")).select(
            F.lit("q").alias("query_id"), F.lit(query).alias("query"), "chunk_id", "artifact_id", F.col("path").alias("relative_path"), "title",
            "heading_path", "text", "status", "authority", "estimated_tokens", "bm25", "line_start", "line_end",
        )
        ids = [r["artifact_id"] for r in rows.select("artifact_id").distinct().collect()]
        over = self._read(build, "supersessions").where(F.col("superseded_id").isin(ids)).select("superseded_id").distinct().collect()
        rows = rows.withColumn("superseded", F.col("artifact_id").isin([r["superseded_id"] for r in over]))
        return rows, ranking.ranked(rows, limit, bounded=True)

    def search(self, query: str, limit: int = 10, **where) -> dict:
        """Ranked hits with locators; filters: path (glob), extension, artifact (id or path), statuses."""
        if not 1 <= limit <= 100:
            raise ValueError("the limit must be between 1 and 100")
        build = self._build()
        page = self._ranked(build, query, limit, ranking.candidate_count(limit), **where)[1].where("position IS NOT NULL")
        where_ = ranges.locator(F.col("artifact_id"), F.col("relative_path"), F.col("heading_path"), F.col("line_start"), F.col("line_end"))
        shown = page.select("position", "chunk_id", "score", "labels", I.snippet(F.col("text"), I.query_phrases(query)).alias("excerpt"), where_.alias("locator"))
        return {"build_id": build, "hits": [r.asDict(True) for r in shown.orderBy("position").collect()]}

    def context_for_task(self, task: str, profile: str = C.DEFAULT_PROFILE, budget: int | None = None, **where) -> dict:
        build = self._build()
        tokens = X.resolve_budget(profile, budget)
        found, ranked = self._ranked(build, task, C.CANDIDATE_MAXIMUM, C.CANDIDATE_MAXIMUM, **where)
        bundled = X.bundle(ranked, tokens)
        rows = [r.asDict(True) for r in bundled.orderBy("bucket", "position").collect()]
        texts = {r["chunk_id"]: r["text"] for r in found.select("chunk_id", "text").collect()}
        out: dict = {"build_id": build, "task": task, "profile": profile, "budget": tokens}
        for bucket in ("overview", "selected", "alternative", "omitted"):
            out[bucket] = [{**r, "text": texts[r["chunk_id"]]} if bucket != "omitted" else r for r in rows if r["bucket"] == bucket]
        out["estimated_tokens"] = sum(r["estimated_tokens"] for r in out["overview"] + out["selected"])
        return out

    def read_source(self, artifact: str, from_line: int | None = None, to_line: int | None = None, heading: Sequence[str] | None = None) -> dict:
        """A whole source or a range of it, by artifact id or path."""
        build = self._build()
        arts = self._read(build, "artifacts").where((F.col("artifact_id") == artifact) | (F.col("relative_path") == artifact)).limit(1).collect()
        if not arts:
            raise LookupError(f"{artifact!r} isn't in the build")
        art = arts[0]
        if from_line is None and to_line is None and not heading:
            # Of a body only what is shown, and its length, come to the driver.
            shown = F.substring("body", 1, C.READ_CHARACTERS).alias("text")
            body = self._read(build, "objects").where(F.col("hash") == art["object_hash"]).select(shown, (F.length("body") > C.READ_CHARACTERS).alias("truncated")).first()
            return {"build_id": build, "artifact_id": art["artifact_id"], "text": body["text"] if body else "", "truncated": bool(body and body["truncated"])}
        nodes = self._read(build, "nodes").where(F.col("artifact_id") == art["artifact_id"])
        got = ranges.read_ranges(nodes, from_line=from_line, to_line=to_line, heading=heading).first()
        if got is None:
            return {"build_id": build, "artifact_id": art["artifact_id"], "text": "", "truncated": False}
        return {"build_id": build, **got.asDict()}

    def list_tables(self) -> dict:
        build = self._build()
        return {"build_id": build, "tables": [r.asDict() for r in self._read(build, "tables").orderBy("table_id").collect()]}

    def _table(self, build: str, table_id: str) -> tuple[dict, list[dict]]:
        found = self._read(build, "tables").where((F.col("table_id") == table_id) | (F.col("table_name") == table_id) | (F.col("sql_name") == table_id)).limit(1).collect()
        if not found:
            raise LookupError(f"{table_id!r} is no table of the build")
        columns = self._read(build, "columns").where(F.col("table_id") == found[0]["table_id"]).orderBy("ordinal").collect()
        return found[0].asDict(), [c.asDict() for c in columns]

    def table_frame(self, build: str, entry: dict, columns: list[dict]) -> DataFrame:
        """A table with typed columns under their own names, in row order by ``row_no``."""
        cells = self._read(build, "cells").where(F.col("table_id") == entry["table_id"])
        wide = cells.groupBy("row_no").agg(*[F.max(F.when(F.col("ordinal") == c["ordinal"], F.col("cell"))).alias(f"_{c['ordinal']}") for c in columns])
        return wide.select("row_no", *[T.typed(F.col(f"_{c['ordinal']}"), c["type"]).alias(c["column_name"]) for c in columns])

    def describe_table(self, table_id: str) -> dict:
        build = self._build()
        entry, columns = self._table(build, table_id)
        sample = self.table_frame(build, entry, columns).where("row_no < 5").orderBy("row_no").drop("row_no").collect()
        return {"build_id": build, **entry, "columns": columns, "sample": [list(r) for r in sample]}

    def query_table(self, table_id: str, sql: str, limit: int = C.SQL_DEFAULT_ROWS) -> dict:
        """One read-only statement over one table, which it names by the table's SQL name."""
        build = self._build()
        entry, columns = self._table(build, table_id)
        frame = self.table_frame(build, entry, columns).drop("row_no")
        labels = {c["sql_name"]: c["column_name"] for c in columns}
        return {"build_id": build, "table_id": entry["table_id"], **execute(frame, entry["sql_name"], sql, limit, labels=labels)}


def render_bundle(bundle: dict) -> str:
    """A context bundle as Markdown: overview, selection by source, what was left out and why."""
    out = [f"# {bundle['task']}", "", f"{bundle['estimated_tokens']} of {bundle['budget']} tokens, build {bundle['build_id']}"]
    for title, key in (("Overview", "overview"), ("Selected", "selected"), ("Alternatives", "alternative")):
        if bundle[key]:
            out += ["", f"## {title}"]
            for item in bundle[key]:
                labels = f" ({', '.join(item['labels'])})" if item["labels"] else ""
                out += ["", f"### {item['relative_path']}{labels}", "", item["text"]]
    sources = Counter(item["relative_path"] for key in ("overview", "selected") for item in bundle[key])
    if sources:
        out += ["", "## Sources", "", *[f"- {path}: {n}" for path, n in sorted(sources.items())]]
    reasons = Counter(item["reason"] for item in bundle["omitted"])
    if reasons:
        out += ["", "## Omitted", "", *[f"- {n} for {reason}" for reason, n in sorted(reasons.items())]]
    return "\n".join(out) + "\n"
