"""Rows that fail to parse: an error-recovering recursive-descent parser of delimited records.

Grammar, with D the delimiter of the file:

    file    = record { newline record }
    record  = field { D field }
    field   = quoted | bare
    quoted  = '"' { char-but-quote | '""' } '"'          followed by D or the end of the record
    bare    = { char-but-quote-but-D }

A broken quote is reported with its offset, and parsing resumes at the next validated record-start anchor: the next line
start from which a whole record of the expected number of fields, led by a filled field, parses. So one bad quote never
swallows its successors.

Delivered raw records are put together again into their files, in blocks of ``BLOCK_RECORDS`` record numbers, and each
block is parsed as one text that says nothing of where records begin; what the parser finds there, recovering as it goes,
is the result. A parsed record is laid against the delivered ones: where it covers just one of them its verdict stands;
a delivered record that it doesn't cover (a quote that ran on, a line break in a bare field, a start passed over by the
recovery) and every broken quote is checked once more within its own bounds.

Each record comes out once: typed (segment, need, priority) or rejected with the first reason that holds of
``quoting``, ``column_count`` and ``value``. Defined cases: a null record, a header and a record of white space only are
no records at all; repeated rows of one record_id come out once, by the latest ``received_at``; a file without a
header takes the comma and the order segment, need, priority; null paths and numbers are a file and a block of their own;
extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.session import ship

BLOCK_RECORDS = 4_096
COLUMNS = ("segment", "need", "priority")
DELIMITERS = ",;\t|"
NULLS = {"", "null", "n/a", "na"}
PRIORITIES = {"high", "medium", "low"}
SLUG = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*\Z")
BYTE_ORDER_MARK = "\ufeff"
NOT_BLANK = r"[^\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


@dataclass(frozen=True)
class SyntaxFault:
    """A located error: ``at`` is the offset in the parsed text."""

    at: int
    what: str


@dataclass(frozen=True)
class Record:
    start: int
    end: int
    fields: tuple[str, ...]
    fault: SyntaxFault | None


class RecordParser:
    """Recursive descent over one text. With ``single`` the whole text is one record: line ends are ordinary characters."""

    def __init__(self, text: str, delimiter: str, width: int = len(COLUMNS), single: bool = False):
        self.text, self.delimiter, self.width, self.single = text, delimiter, width, single
        self.limit = len(text) - (single and text.endswith("\r"))
        self.last_quote = text.rfind('"')
        self._special = re.compile(f'["{re.escape(delimiter)}]' if single else f'["\n{re.escape(delimiter)}]')

    def records(self) -> Iterator[Record]:
        at = 0
        while at < self.limit:
            record = self.record(at)
            yield record
            at = record.end + 1

    def record(self, at: int) -> Record:
        fields: list[str] = []
        start = at
        while True:
            value, at, fault = self.field(at)
            if fault is not None:
                return Record(start, self.resume(start), tuple(fields), fault)
            fields.append(value)
            if at >= self.limit or self.text[at] != self.delimiter:
                return Record(start, at, tuple(fields), None)
            at += 1

    def field(self, at: int) -> tuple[str, int, SyntaxFault | None]:
        return self.quoted(at) if at < self.limit and self.text[at] == '"' else self.bare(at)

    def bare(self, at: int) -> tuple[str, int, SyntaxFault | None]:
        m = self._special.search(self.text, at, self.limit)
        end = m.start() if m else self.limit
        if m and m[0] == '"':
            return "", end, SyntaxFault(end, "quote inside a bare field")
        value = self.text[at:end]
        return (value[:-1] if not self.single and value.endswith("\r") and self.ends_record(end) else value), end, None

    def quoted(self, at: int) -> tuple[str, int, SyntaxFault | None]:
        begin, parts, at = at, [], at + 1
        while True:
            close = self.text.find('"', at, self.limit) if at <= self.last_quote else -1
            if close < 0:
                return "", self.limit, SyntaxFault(begin, "quoted field isn't closed")
            parts.append(self.text[at:close])
            at = close + 1
            if at < self.limit and self.text[at] == '"':
                parts.append('"')
                at += 1
                continue
            if at >= self.limit or self.text[at] == self.delimiter:
                return "".join(parts), at, None
            if not self.single and self.text.startswith(("\n", "\r\n"), at):
                return "".join(parts), at + (self.text[at] == "\r"), None
            return "", at, SyntaxFault(at, "text after a closing quote")

    def ends_record(self, at: int) -> bool:
        return at >= self.limit or self.text[at] == "\n"

    def resume(self, start: int) -> int:
        """The end of a broken record: just before the next validated anchor."""
        if self.single:
            return self.limit
        at = self.text.find("\n", start)
        while at >= 0:
            if self.validated(at + 1):
                return at
            at = self.text.find("\n", at + 1)
        return len(self.text)

    def validated(self, at: int) -> bool:
        """Whether a whole record of the expected width, led by a slug, parses from here."""
        fields = 0
        first = None
        while at <= self.limit:
            value, at, fault = self.field(at)
            if fault is not None:
                return False
            first = value if first is None else first
            fields += 1
            if at >= self.limit or self.text[at] != self.delimiter:
                return fields == self.width and bool(first and first.strip())
            at += 1
        return False


def header_of(raw: str) -> tuple[str, tuple[int, ...]]:
    """Delimiter and, for each of segment, need, priority, its position. Unknown headers take the default order."""
    plain = raw.lstrip(BYTE_ORDER_MARK).strip().replace('"', "").lower()
    delimiter = max(DELIMITERS, key=plain.count) if any(d in plain for d in DELIMITERS) else ","
    names = [x.strip(BYTE_ORDER_MARK + " \t") for x in plain.split(delimiter)]
    if sorted(names) != sorted(COLUMNS):
        return delimiter, (0, 1, 2)
    return delimiter, tuple(names.index(c) for c in COLUMNS)


def judge(record: Record, order: tuple[int, ...]) -> tuple[str | None, str | None, str | None, str | None, int | None]:
    """(reason, segment, need, priority, offset of the fault within the record)."""
    if record.fault is not None:
        return "quoting", None, None, None, record.fault.at - record.start
    if len(record.fields) != len(COLUMNS):
        return "column_count", None, None, None, None
    segment, need, priority = (record.fields[i].strip() for i in order)
    priority = priority.lower()
    if not SLUG.match(segment) or need.lower() in NULLS or priority not in PRIORITIES:
        return "value", None, None, None, None
    return None, segment, need, priority, None


def _spans(raws: list[str]) -> tuple[list[int], str]:
    """Where each raw record begins in the text they make together, one line end after each."""
    starts, at = [], 0
    for r in raws:
        starts.append(at)
        at += len(r) + 1
    return starts, "\n".join(raws)


def parse_block(raws: list[str], delimiter: str) -> tuple[list[Record], int]:
    """The record of each raw record of a block, offsets from its own begin, and how many were checked by themselves."""
    starts, text = _spans(raws)
    out: list[Record | None] = [None] * len(raws)
    for r in RecordParser(text, delimiter).records():
        i = bisect_left(starts, r.start)
        if r.fault is None and i < len(starts) and starts[i] == r.start and r.end == r.start + len(raws[i]):
            out[i] = Record(0, len(raws[i]), r.fields, None)
    checked = 0
    for i, r in enumerate(out):
        if r is None:
            out[i] = RecordParser(raws[i], delimiter, single=True).record(0)
            checked += 1
    return out, checked


@dataclass
class Block:
    """Consecutive records of one file."""

    file_path: str | None
    header: str | None
    ids: list[int]
    numbers: list[int | None]
    raws: list[str]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Whole blocks of rows that come sorted by file and block, whatever the batches' ends."""
    last, held = None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("file_path", "block", "header", "record_id", "record_no", "raw_record")]
        for path, block, header, record, number, raw in zip(*columns, strict=True):
            if held is None or last != (path, block):
                if held is not None:
                    yield held
                last, held = (path, block), Block(path, header, [], [], [])
            held.ids.append(record)
            held.numbers.append(number)
            held.raws.append(raw)
    if held is not None:
        yield held


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


_PARSED = pa.schema([("record_id", pa.int64()), *((c, pa.string()) for c in ("reason", *COLUMNS)), ("fault_at", pa.int32())])
_FAULTS = pa.schema(
    [("file_path", pa.string()), ("record_no", pa.int32()), ("fault_record", pa.int32()), ("fault_at", pa.int32()), ("what", pa.string()), ("records", pa.int32())]
)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in _blocks(batches):
            delimiter, order = header_of(b.header if b.header is not None else ",".join(COLUMNS))
            for i, r in zip(b.ids, parse_block(b.raws, delimiter)[0], strict=True):
                yield i, *judge(r, order)

    yield from _in_batches(rows(), _PARSED)


def _fault_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in _blocks(batches):
            delimiter, _ = header_of(b.header if b.header is not None else ",".join(COLUMNS))
            starts, text = _spans(b.raws)
            for r in RecordParser(text, delimiter).records():
                if r.fault is not None:
                    first, fault, after = (bisect_left(starts, x + 1) - 1 for x in (r.start, r.fault.at, r.end))
                    yield b.file_path, b.numbers[first], b.numbers[fault], r.fault.at - starts[fault], r.fault.what, after - first + 1

    yield from _in_batches(rows(), _FAULTS)


def in_files(lines: DataFrame, block: int = BLOCK_RECORDS) -> DataFrame:
    """(record_id, file_path, block, record_no, raw_record, header): records in the order of their files.

    Blocks lie whole and in order in one partition. A file of any size is spread by its blocks; the header, and how many
    blocks there are, come from one aggregate a file.
    """
    number = F.floor(F.coalesce("record_no", F.lit(0)) / block).cast("bigint")
    heads = lines.groupBy("file_path").agg(
        F.max(F.when(F.col("record_no") == 1, F.struct("received_at", F.col("raw_record").alias("header"))))["header"].alias("header"),
        F.collect_set(number).alias("blocks"),
    )
    heads = heads.where(F.col("header").isNotNull()).select("file_path", "header", F.explode("blocks").alias("block"))
    once = (
        lines.where((F.coalesce("record_no", F.lit(0)) != 1) & F.col("raw_record").isNotNull())
        .groupBy("record_id")
        .agg(F.max(F.struct("received_at", "file_path", "record_no", "raw_record")).alias("r"))
        .select("record_id", "r.file_path", "r.record_no", "r.raw_record")
        .where(F.col("raw_record").rlike(NOT_BLANK))
        .withColumn("block", number)
    )
    placed = once.repartition("file_path", "block").join(heads, ["file_path", "block"], "left")
    return placed.sortWithinPartitions("file_path", "block", "record_no", "record_id")


def parse_records(lines: DataFrame, block: int = BLOCK_RECORDS) -> DataFrame:
    """(record_id, reason, segment, need, priority, fault_at) of every record; reason is null for valid rows."""
    ship(lines.sparkSession)
    return in_files(lines, block).mapInArrow(
        _parse_batches, "record_id bigint, reason string, segment string, need string, priority string, fault_at int"
    )


def located_faults(lines: DataFrame, block: int = BLOCK_RECORDS) -> DataFrame:
    """(file_path, record_no, fault_record, fault_at, what, records): broken quotes as the parser of whole files meets
    them: the record it was reading, where the fault lies, and over how many delivered records it went until it had a
    validated start to resume at."""
    ship(lines.sparkSession)
    return in_files(lines, block).mapInArrow(
        _fault_batches, "file_path string, record_no int, fault_record int, fault_at int, what string, records int"
    )


def rejected(lines: DataFrame) -> DataFrame:
    return parse_records(lines).where(F.col("reason").isNotNull()).select("record_id", "reason")


def valid(lines: DataFrame) -> DataFrame:
    return parse_records(lines).where(F.col("reason").isNull()).select("record_id", "segment", "need", "priority")
