"""Delimited text: delimiter and header detection, quoted records, ragged rows, and typed import.

A file is read as whole text in one task (files over 64 MiB are excluded from builds); a corpus of files is read in
parallel. Cells stay text until types are inferred over all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.constants import MAX_TABLE_COLUMNS, MAX_TABLE_ROWS
from stratalith.operators.records import RecordParser

DELIMITERS = (",", ";", "\t", "|")
HEAD_LINES = 20
_NUMERIC = re.compile(r"[+-]?(\d+([.,]\d+)*|\.\d+)([eE][+-]?\d+)?%?\Z")


@dataclass
class DelimitedFile:
    columns: list[str] = field(default_factory=list)
    rows: list[list[str | None]] = field(default_factory=list)
    row_lines: list[int] = field(default_factory=list)
    delimiter: str = ","
    has_header: bool = False
    width: int = 0
    row_count: int = 0
    warnings: list[tuple[str, str]] = field(default_factory=list)
    rejected: list[int] = field(default_factory=list)


def _line_ends(text: str) -> str:
    return text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


def read_records(text: str, delimiter: str) -> list[tuple[int, list[str]]]:
    """(first line, fields) of every record that isn't blank; quoted fields may hold delimiters and line ends."""
    return list(_records(_line_ends(text), delimiter))


def _records(text: str, delimiter: str, broken: list[int] | None = None) -> Iterator[tuple[int, list[str]]]:
    """Records as they stand. One whose quote never closes swallows nothing but itself: its line is noted in ``broken``
    and reading goes on at the next line from which a whole record of the first one's width parses."""
    at, line, n = 0, 1, len(text)
    fields: list[str] = []
    start, begin, width = 1, 0, 0
    last_quote = text.rfind('"')
    while at <= n:
        if at < n and text[at] == '"':
            value, at = [], at + 1
            closed = False
            while at < n:
                close = text.find('"', at) if at <= last_quote else -1
                if close < 0:
                    break
                closed = True
                value.append(text[at:close])
                line += text.count("\n", at, close)
                at = close + 1
                if at < n and text[at] == '"':
                    value.append('"')
                    at += 1
                    closed = False
                    continue
                break
            if not closed:
                if broken is not None:
                    broken.append(start)
                at = RecordParser(text, delimiter, width or len(fields) + 1).resume(begin)
                fields, line = [], start + text.count("\n", begin, at)
                at += 1
                line += 1
                start, begin = line, at
                continue
            cell = "".join(value)
        else:
            cell = ""
        end = at
        while end < n and text[end] != delimiter and text[end] != "\n":
            end += 1
        fields.append(cell + text[at:end])
        at = end
        if at < n and text[at] == delimiter:
            at += 1
            continue
        if fields != [""]:
            width = width or len(fields)
            yield start, fields
        fields = []
        at += 1
        line += 1
        start, begin = line, at


def delimiter_of(text: str) -> str:
    """The candidate that splits each of the first 20 logical lines alike into the most fields; ties to the earlier."""
    best, most = ",", 1
    text = _line_ends(text)
    for d in DELIMITERS:
        widths = {len(f) for _, f in islice(_records(text, d), HEAD_LINES)}
        if len(widths) == 1 and (w := widths.pop()) > most:
            best, most = d, w
    return best


def looks_like_header(first: Sequence[str]) -> bool:
    """Every cell of the first row is filled and none is a number or a truth value."""
    cells = [c.strip() for c in first]
    return all(c and not _NUMERIC.match(c) and c.lower() not in ("true", "false") for c in cells)


def unique_headers(names: Sequence[str], code: str = "csv-duplicate-header") -> tuple[list[str], list[tuple[str, str]]]:
    """Blank names become column_N, repeated ones get the first free numbered suffix."""
    taken = {n.strip() for n in names if n.strip()}
    out: list[str] = []
    warnings = []
    for i, raw in enumerate(names, 1):
        name = raw.strip() or f"column_{i}"
        if name in out:
            k = 2
            while f"{name}_{k}" in out or f"{name}_{k}" in taken:
                k += 1
            warnings.append((code, f"column {name!r} occurs more than once"))
            name = f"{name}_{k}"
        out.append(name)
    return out, warnings


def parse_delimited(text: str, delimiter: str | None = None) -> DelimitedFile:
    d = delimiter or delimiter_of(text)
    broken: list[int] = []
    records = list(_records(_line_ends(text), d, broken))
    got = DelimitedFile(delimiter=d, rejected=broken)
    if broken:
        got.warnings.append(("csv-unclosed-quote", f"{len(broken)} records were left out, at lines {', '.join(map(str, broken[:5]))}"))
    if not records:
        got.warnings.append(("empty-file", "the file holds no record"))
        return got
    got.width = max(len(f) for _, f in records)
    got.has_header = looks_like_header(records[0][1])
    body = records[1:] if got.has_header else records
    names = records[0][1] if got.has_header else []
    got.columns, warned = unique_headers([*names, *[""] * (got.width - len(names))])
    got.warnings += warned
    got.row_count = len(body)
    if got.width > MAX_TABLE_COLUMNS:
        got.warnings.append(("csv-too-many-columns", f"{got.width} columns, over {MAX_TABLE_COLUMNS}"))
        return got
    if len(body) > MAX_TABLE_ROWS:
        got.warnings.append(("csv-too-many-rows", f"{len(body)} rows, over {MAX_TABLE_ROWS}"))
        return got
    ragged = [line for line, f in body if len(f) != got.width]
    if ragged:
        got.warnings.append(("csv-ragged-row", f"{len(ragged)} rows differ in width, at lines {', '.join(map(str, ragged[:5]))}"))
    got.rows = [[*f, *[None] * (got.width - len(f))] for _, f in body]
    got.row_lines = [line for line, _ in body]
    return got


def detect_delimiters(lines: DataFrame, head: int = HEAD_LINES) -> DataFrame:
    """(file_path, delimiter, fields) from the first records of each file, for files delivered record by record.

    A candidate must split every one of the head's whole records alike; the most fields win, ties go to the earlier.
    """
    first = lines.where((F.col("record_no") <= head) & (F.trim(F.regexp_replace("raw_record", r"\s+", " ")) != "")).select("file_path", "record_no", "raw_record").distinct()
    plain = F.regexp_replace("raw_record", '"([^"]|"")*"', "q")
    counts = F.array(
        *[
            F.struct(F.lit(-i).alias("prefer"), F.lit(d).alias("delimiter"), (F.length(plain) - F.length(F.replace(plain, F.lit(d), F.lit("")))).alias("n"))
            for i, d in enumerate(DELIMITERS)
        ]
    )
    judged = first.select("file_path", F.inline(counts)).groupBy("file_path", "prefer", "delimiter").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    ok = judged.where((F.col("low") == F.col("high")) & (F.col("low") > 0))
    best = ok.groupBy("file_path").agg(F.max(F.struct("low", "prefer", "delimiter")).alias("b"))
    return lines.select("file_path").distinct().join(best, "file_path", "left").select(
        "file_path", F.coalesce("b.delimiter", F.lit(",")).alias("delimiter"), (F.coalesce("b.low", F.lit(0)) + 1).alias("fields")
    )
