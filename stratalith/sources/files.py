"""From a directory (or rows of bytes) to nodes, tables and warnings.

Discovery walks a source without entering directories that a rule skips, and decides on every file by its path and size;
the limits of an envelope are checked then. Only contents of files that are left are read, where they lie: hashed and
classified by one job, whose result is kept, and parsed by another, each file by one task.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from stratalith import constants as C
from stratalith.functions.globs import Decider, IgnoreRule
from stratalith.functions.paths import is_canonical
from stratalith.session import ship
from stratalith.sources import formats
from stratalith.sources.delimited import parse_delimited
from stratalith.sources.folders import LocalFolder, SharedFolder
from stratalith.sources.html import decode_html, parse_html
from stratalith.sources.markdown import parse_markdown
from stratalith.sources.office import parse_docx, sheets_of
from stratalith.sources.pdf import parse_pdf
from stratalith.sources.tree import NODE_SCHEMA, Tree

BATCH_BYTES = 32 * 1024 * 1024
DEFAULT_RULES = tuple(IgnoreRule(p, source="built-in") for p in (*C.ALWAYS_EXCLUDE, *(p for p in C.SECRET_SHAPED if p not in C.ALWAYS_EXCLUDE)))


LISTED = (
    "artifact_id string, source string, relative_path string, url string, byte_size bigint, modified bigint, parser string, media_type string, "
    "rule int, problem string"
)


def discover(spark: SparkSession, folder: LocalFolder | SharedFolder, source: str = "src", rules: Sequence[IgnoreRule] = (), most: int = C.MAX_SOURCE_FILES) -> list[Row]:
    """Rows of ``LISTED`` for every file, in canonical order, without reading any.

    ``rule`` is the index of the rule that excludes a file or, with a path that ends in ``/``, skips a directory;
    ``problem`` the code of the warning of a file that can't be read. More than ``most`` files that would be read are
    refused, so the list is bounded.
    """
    decider = Decider([*DEFAULT_RULES, *rules])
    out, usable = [], 0
    for e in folder.walk(lambda d: decider.skips(d) is not None):
        plain = unicodedata.normalize("NFC", e.path)
        parser = formats.parser_for(plain)
        problem = None
        if e.reason == "skipped":
            rule = decider.skips(plain.rstrip("/"))
        else:
            rule = decider.excludes(plain)
            if e.reason is not None:
                problem = "symlink-not-followed" if e.reason == "symlink" else "special-file"
            elif not is_canonical(plain):
                problem = "unsafe-path"
            elif parser is None:
                problem = "unsupported-format"
            elif e.size > C.MAX_ARTIFACT_BYTES:
                problem = "file-too-large"
            usable += rule is None and problem is None
            if usable > most:
                raise ValueError(f"the source {source!r} holds more than {most} files")
        out.append(Row(f"{source}:{plain}", source, plain, e.url, e.size, e.modified, parser, formats.media_type_for(plain), rule, None if rule is not None else problem))
    return out


FILES_PER_TASK = 500


def _contents(spark: SparkSession, listed: DataFrame, urls: Sequence[str]) -> DataFrame:
    """Rows of ``listed`` with the contents of the named files, which are few enough to be named.

    Files of a mounted file system are opened where a task runs; of others the paths are handed to Spark's binary reader.
    """
    if not urls:
        return listed.where("false").withColumn("content", F.lit(None).cast("binary"))
    if all(u.startswith("file:") for u in urls):
        ship(spark)
        names = [f.name for f in listed.schema.fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = batch.column("url").to_pylist()
                begin, held, size = 0, [], 0
                for i, url in enumerate(places):
                    with open(url.removeprefix("file:"), "rb") as f:
                        held.append(f.read())
                    size += len(held[-1])
                    if size > BATCH_BYTES or i + 1 == len(places):
                        part = batch.slice(begin, len(held))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*names, "content"])
                        begin, held, size = i + 1, [], 0

        schema = StructType([*listed.schema.fields, StructField("content", BinaryType())])
        return listed.repartition(max(spark.sparkContext.defaultParallelism, len(urls) // FILES_PER_TASK)).mapInArrow(run, schema)
    named = [re.sub(r"([\[\]{}*?\\])", r"\\\1", u) for u in urls]
    raw = spark.read.format("binaryFile").load(named).select(F.col("path").alias("url"), "content")
    return listed.join(raw, "url")


def facts(spark: SparkSession, found: Sequence[Row]) -> DataFrame:
    """Files that can be read, with ``content_hash`` and ``text_class``; contents go no further than this job."""
    use = [r for r in found if r[8] is None and r[9] is None]
    listed = spark.createDataFrame(use, LISTED)
    whole = _contents(spark, listed, [r[3] for r in use])
    return whole.withColumn("content_hash", F.sha2("content", 256)).withColumn("text_class", formats.text_class(F.col("content"), F.col("parser"))).drop("content")


def readable(files: DataFrame) -> DataFrame:
    """Of ``facts`` the files that are parsed: text where they should be."""
    return files.where(F.col("text_class").isin("text", "bytes") | (F.col("parser") == "html"))


def with_content(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Files of ``facts`` with their contents, for parsing; the list of their places is bounded by the envelope."""
    return _contents(spark, files, [r["url"] for r in files.select("url").collect()])


def discovery_warnings(spark: SparkSession, found: Sequence[Row], files: DataFrame, most_bytes: int = C.MAX_TOTAL_BYTES) -> DataFrame:
    """(code, class, path, message) of files that can't be read, and of a source that is very large."""
    schema = "code string, class string, path string, message string"
    rows = [(r[9], "unsupported-file" if r[9] == "unsupported-format" else "parser", r[2], f"the file was left out: {r[9]}") for r in found if r[9] is not None]
    total = sum(r[4] for r in found if r[8] is None and r[9] is None)
    if total > most_bytes:
        rows.append(("source-very-large", "parser", "", f"the sources hold {total} bytes, over {most_bytes}"))
    undecodable = files.where(~F.col("text_class").isin("text", "bytes") & (F.col("parser") != "html")).select(
        F.lit("undecodable-content").alias("code"), F.lit("unsupported-file").alias("class"), F.col("relative_path").alias("path"),
        F.concat(F.lit("the file was left out: "), F.col("text_class")).alias("message"),
    )
    return spark.createDataFrame(rows, schema).unionByName(undecodable)


def exclusion_report(found: Sequence[Row], rules: Sequence[IgnoreRule], sample: int = C.EXCLUSION_SAMPLE) -> list[dict]:
    """What each rule kept out: its pattern and layer, how many files and skipped directories, the first few of them."""
    every = [*DEFAULT_RULES, *rules]
    kept_out: dict[int, list[str]] = {}
    for r in found:
        if r[8] is not None:
            kept_out.setdefault(r[8], []).append(r[2])
    return [{"pattern": every[i].pattern, "source": every[i].source, "files": len(p), "sample": sorted(p)[:sample]} for i, p in sorted(kept_out.items())]


def parse_plain(text: str, name: str, code: bool = False) -> Tree:
    """Blank-line paragraphs; of code files as nodes of kind code with the extension as language."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    stem = name.rsplit(".", 1)[0] if "." in name.strip(".") else name
    tree = Tree(name if code else stem)
    block: list[str] = []
    begin = 1

    def flush(end: int) -> None:
        whole = "\n".join(block).strip()
        long = any(len(x) > 20_000 for x in block)
        if long:
            tree.warnings.append(("long-line-split", f"a line at {begin} is over 20,000 characters"))
        for i in range(0, len(whole) if long else 1, 20_000):
            extra = {"language": name.rsplit(".", 1)[-1].lower()} if code else {}
            tree.add("code" if code else "paragraph", whole[i : i + 20_000] if long else whole, begin, end, **extra)
        block.clear()

    lines = text.split("\n")
    for no, line in enumerate(lines, 1):
        if line.strip():
            if not block:
                begin = no
            block.append(line)
        elif block:
            flush(no - 1)
    if block:
        flush(len(lines))
    if len(tree.nodes) == 1:
        tree.warnings.append(("empty-file", "the file holds no text"))
    return tree


def table_node(name: str, columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    """The text by which a table is found."""
    head = [f"{name}", f"{len(rows)} rows", "Columns: " + ", ".join(columns)]
    return "\n".join(head + [" | ".join("" if c is None else str(c) for c in r) for r in rows[:5]])


Parsed = tuple[Tree, list[dict]]


def _read_sheets(data: bytes, name: str) -> Parsed:
    tree, tables = Tree(name.rsplit(".", 1)[0], None), []
    for sheet, found, warnings in sheets_of(data):
        tree.warnings += warnings
        if found is not None:
            tables.append({"name": sheet, "columns": found.columns, "rows": found.rows, "sheet": sheet, "cell_range": found.cell_range})
            tree.add("sheet", table_node(sheet, found.columns, found.rows))
    return tree, tables


def _read_html(data: bytes, name: str) -> Parsed:
    text, warnings = decode_html(data)
    tree = parse_html(text, name)
    tree.warnings += warnings
    return tree, []


def _read_delimited(data: bytes, name: str) -> Parsed:
    got, tables = parse_delimited(data.decode("utf-8")), []
    tree = Tree(name.rsplit(".", 1)[0])
    tree.warnings += got.warnings
    if got.rows:
        tables.append({"name": name.rsplit(".", 1)[0], "columns": got.columns, "rows": got.rows, "sheet": None, "cell_range": None})
        tree.add("table", table_node(name, got.columns, got.rows), 1, got.row_lines[-1])
    elif got.width:
        tree.add("table", f"{name}\n{got.row_count} rows, {got.width} columns", 1)
    return tree, tables


@dataclass(frozen=True)
class Parser:
    """How files of one format are read; a new ``version`` makes them be parsed anew."""

    version: str
    read: Callable[[bytes, str], Parsed]


#: The fixed registry of parsers: (tree, tables) of a file, tables being {name, columns, rows, sheet, cell_range}.
PARSERS = {
    "markdown": Parser("2", lambda data, name: (parse_markdown(data.decode("utf-8"), name), [])),
    "text": Parser("1", lambda data, name: (parse_plain(data.decode("utf-8"), name), [])),
    "code": Parser("1", lambda data, name: (parse_plain(data.decode("utf-8"), name, True), [])),
    "html": Parser("1", _read_html),
    "pdf-text": Parser("1", lambda data, name: (parse_pdf(data, name), [])),
    "docx": Parser("2", lambda data, name: (parse_docx(data, name), [])),
    "csv": Parser("2", _read_delimited),
    "xlsx": Parser("1", _read_sheets),
}


def parse_bytes(parser: str, data: bytes, name: str) -> Parsed:
    return PARSERS[parser].read(data, name)


PARSED_SCHEMA = (
    f"artifact_id string, relative_path string, parser string, title string, nodes array<struct<{NODE_SCHEMA.replace(' ', ':').replace(',:', ',')}>>, "
    "tables array<struct<name:string,columns:array<string>,sheet:string,cell_range:string,rows:array<array<string>>>>, "
    "warnings array<struct<code:string,message:string>>"
)


def parse(files: DataFrame) -> DataFrame:
    """One row per file of (artifact_id, relative_path, parser, content): its nodes, tables and warnings.

    A file that can't be parsed gives a warning and no nodes. Cells of tables come as text.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["artifact_id", "relative_path", "parser", "title", "nodes", "tables", "warnings"]
        fields = [x.split(" ")[0] for x in NODE_SCHEMA.split(", ")]
        for pdf in batches:
            out = []
            for artifact, path, parser, content in pdf.itertuples(index=False):
                try:
                    tree, tables = parse_bytes(parser, bytes(content), path.rsplit("/", 1)[-1])
                    nodes = [dict(zip(fields, r, strict=True)) for r in tree.rows(artifact)]
                    listed = [
                        {**{k: t[k] for k in ("name", "columns", "sheet", "cell_range")}, "rows": [[_cell_text(c) for c in r] for r in t["rows"]]}
                        for t in tables
                    ]
                    warned = [{"code": c, "message": m} for c, m in tree.warnings]
                    out.append((artifact, path, parser, tree.nodes[0].title, nodes, listed, warned))
                except Exception as e:
                    out.append((artifact, path, parser, None, [], [], [{"code": "parse-failed", "message": f"{type(e).__name__}: {e}"[:300]}]))
            yield pd.DataFrame(out, columns=names, dtype=object)

    return files.select("artifact_id", "relative_path", "parser", "content").mapInPandas(run, PARSED_SCHEMA)


def _cell_text(c: object) -> str | None:
    if c is None:
        return None
    if isinstance(c, bool):
        return "true" if c else "false"
    if isinstance(c, float):
        return repr(c)
    return str(c)


def nodes_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.inline("nodes"))


def warnings_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("relative_path").alias("path"), F.inline("warnings")).select("code", F.lit("parser").alias("class"), "path", "message")

