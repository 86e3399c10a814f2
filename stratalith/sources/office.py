"""Office documents from their ZIP parts: DOCX to a tree, XLSX to typed tables; text of PDF pages once extracted.

No library for these formats is assumed. Parts are read as streams under caps on their number and size.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

from stratalith.constants import MAX_TABLE_COLUMNS, MAX_TABLE_ROWS
from stratalith.operators.tables import unify_kinds
from stratalith.sources.delimited import unique_headers
from stratalith.sources.tree import Tree

MOST_PARTS, MOST_PART_BYTES, MOST_BYTES = 512, 1 << 30, 2 << 30
HEADER_ROWS = 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


#: Parts of a DOCX body whose content no node holds.
LEFT_OUT = (("drawings", "drawing"), ("pictures", "pict"), ("embedded objects", "object"), ("footnote references", "footnoteReference"), ("comments", "commentReference"))


class Package:
    """The parts of an office file, with caps on what unpacking may cost."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        if len(self.zip.infolist()) > MOST_PARTS:
            raise ValueError(f"more than {MOST_PARTS} parts")
        self.read_bytes = 0

    def names(self) -> list[str]:
        return self.zip.namelist()

    def read(self, name: str) -> bytes:
        out = []
        with self.zip.open(name) as f:
            size = 0
            while block := f.read(1 << 20):
                size += len(block)
                self.read_bytes += len(block)
                if size > MOST_PART_BYTES or self.read_bytes > MOST_BYTES:
                    raise ValueError("a part unpacks to more than is allowed")
                out.append(block)
        return b"".join(out)


def parse_docx(data: bytes, name: str) -> Tree:
    """Heading styles open sections; numbered or bulleted paragraphs join into lists; tables keep their cells."""
    if data.startswith(b"\xd0\xcf\x11\xe0"):
        raise ValueError("this is the older .doc format; save it as .docx")
    package = Package(data)
    styles: dict[str, str] = {}
    if "word/styles.xml" in package.names():
        for s in ET.fromstring(package.read("word/styles.xml")).iter(f"{_W}style"):
            label = s.find(f"{_W}name")
            styles[s.get(f"{_W}styleId", "")] = label.get(f"{_W}val", "") if label is not None else ""
    body = ET.fromstring(package.read("word/document.xml")).find(f"{_W}body")
    blocks: list[tuple[str, object]] = []
    unmapped: set[str] = set()

    def text_of(p: ET.Element) -> str:
        parts = []
        for e in p.iter():
            if e.tag == f"{_W}t":
                parts.append(e.text or "")
            elif e.tag == f"{_W}tab":
                parts.append("\t")
            elif e.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        return "".join(parts).strip()

    for e in body if body is not None else []:
        if e.tag == f"{_W}tbl":
            blocks.append(("table", [[text_of(c) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]))
        elif e.tag == f"{_W}p" and (text := text_of(e)):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val", "") if style is not None else ""
            label = styles.get(key, key)
            m = re.fullmatch(r"(?:heading\s*|Heading)([1-6])", label, re.I)
            if m or label.lower() == "title":
                blocks.append(("heading", (int(m[1]) if m else 1, text)))
            elif e.find(f"{_W}pPr/{_W}numPr") is not None or "list" in label.lower():
                blocks.append(("item", text))
            else:
                if label and label.lower() not in ("normal", "body text", "quote", "caption", "no spacing"):
                    unmapped.add(label)
                blocks.append(("paragraph", text))
    first = next((v[1] for k, v in blocks if k == "heading"), None)
    tree = Tree(first or re.sub(r"\.[^.]+$", "", name), None)
    items: list[str] = []
    for kind, value in [*blocks, ("end", None)]:
        if kind != "item" and items:
            tree.add("list", "\n".join(f"- {x}" for x in items))
            items = []
        if kind == "heading":
            tree.section(value[0], value[1])
        elif kind == "item":
            items.append(value)
        elif kind == "table":
            tree.add("table", "\n".join(" | ".join(r) for r in value), rows=len(value), columns=max(map(len, value), default=0))
        elif kind == "paragraph":
            tree.add("paragraph", value)
    if unmapped:
        tree.warnings.append(("docx-unmapped-style", f"styles read as plain text: {', '.join(sorted(unmapped))}"))
    lost = {f"{len(found)} {what} left out" for what, tag in LEFT_OUT if (found := list(body.iter(f"{_W}{tag}")) if body is not None else [])}
    for what in sorted(lost):
        tree.warnings.append(("docx-conversion", what))
    return tree


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def parse_reference(ref: str) -> tuple[int, int]:
    """(row, column) of an A1 reference, both from 1."""
    m = re.fullmatch(r"\$?([A-Z]{1,3})\$?(\d+)", ref)
    if not m:
        raise ValueError(f"{ref!r} is no cell reference")
    column = 0
    for c in m[1]:
        column = column * 26 + ord(c) - 64
    return int(m[2]), column


def cell_range(top: int, left: int, bottom: int, right: int) -> str:
    return f"{column_letters(left)}{top}:{column_letters(right)}{bottom}"


def serial_to_iso(serial: float, date1904: bool = False) -> str:
    """A spreadsheet's day number as an ISO date, with the time if it has one. The 1900 system counts a day that
    never was, so its days before March 1900 are one off."""
    base = datetime(1904, 1, 1) if date1904 else (datetime(1899, 12, 31) if serial < 60 else datetime(1899, 12, 30))
    at = base + timedelta(milliseconds=round(serial * 86_400_000))
    if float(serial).is_integer():
        return at.strftime("%Y-%m-%d")
    return at.strftime("%Y-%m-%dT%H:%M:%S")


def is_date_format(number: int, code: str | None) -> bool:
    if 14 <= number <= 22 or 45 <= number <= 47:
        return True
    plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code or "")
    return bool(re.search("[dmyhs]", plain, re.I)) and plain.lower() != "general"


@dataclass
class Sheet:
    name: str
    rows: dict[int, dict[int, tuple[str, object]]] = field(default_factory=dict)  # row, column: (kind, value)
    merged: list[str] = field(default_factory=list)
    row_count: int = 0


@dataclass
class SheetTable:
    name: str
    columns: list[str]
    types: list[str]
    rows: list[list[object]]
    cell_range: str
    header_row: int


@dataclass
class Workbook:
    sheets: list[Sheet]
    date1904: bool = False


def _shared_strings(package: Package) -> list[str]:
    if "xl/sharedStrings.xml" not in package.names():
        return []
    out = []
    for si in ET.fromstring(package.read("xl/sharedStrings.xml")).findall(f"{_S}si"):
        runs = [si.find(f"{_S}t")] + [r.find(f"{_S}t") for r in si.findall(f"{_S}r")]  # phonetic runs aren't text
        out.append("".join(t.text or "" for t in runs if t is not None))
    return out


def _date_styles(package: Package) -> set[int]:
    if "xl/styles.xml" not in package.names():
        return set()
    root = ET.fromstring(package.read("xl/styles.xml"))
    codes = {int(f.get("numFmtId", "0")): f.get("formatCode") for f in root.iter(f"{_S}numFmt")}
    xfs = root.find(f"{_S}cellXfs")
    return {i for i, x in enumerate(xfs if xfs is not None else []) if is_date_format(int(x.get("numFmtId", "0")), codes.get(int(x.get("numFmtId", "0"))))}


def read_workbook(data: bytes) -> Workbook:
    package = Package(data)
    shared, dates = _shared_strings(package), _date_styles(package)
    root = ET.fromstring(package.read("xl/workbook.xml"))
    properties = root.find(f"{_S}workbookPr")
    date1904 = properties is not None and properties.get("date1904") in ("1", "true")
    targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(package.read("xl/_rels/workbook.xml.rels"))}
    sheets = []
    for s in root.iter(f"{_S}sheet"):
        target = targets.get(s.get(f"{_R}id"), "").lstrip("/")
        part = target if target.startswith("xl/") else f"xl/{target}"
        if part in package.names():
            sheets.append(_read_sheet(package.read(part), s.get("name", ""), shared, dates, date1904))
    return Workbook(sheets, date1904)


def _read_sheet(data: bytes, name: str, shared: list[str], dates: set[int], date1904: bool) -> Sheet:
    sheet = Sheet(name)
    row = 0
    for _, e in ET.iterparse(io.BytesIO(data)):
        if e.tag == f"{_S}mergeCell":
            sheet.merged.append(e.get("ref", ""))
        elif e.tag == f"{_S}row":
            row = int(e.get("r", row + 1))
            sheet.row_count += 1
            if sheet.row_count <= MAX_TABLE_ROWS + HEADER_ROWS + 1:
                cells: dict[int, tuple[str, object]] = {}
                column = 0
                for c in e.findall(f"{_S}c"):
                    column = parse_reference(c.get("r"))[1] if c.get("r") else column + 1
                    value = _cell(c, shared, dates, date1904)
                    if value is not None:
                        cells[column] = value
                if cells:
                    sheet.rows[row] = cells
            e.clear()
    return sheet


def _cell(c: ET.Element, shared: list[str], dates: set[int], date1904: bool) -> tuple[str, object] | None:
    """(kind, value): formulas count as the value they were saved with; an error keeps its token."""
    kind = c.get("t", "n")
    if kind == "inlineStr":
        text = "".join(t.text or "" for t in c.iter(f"{_S}t"))
        return ("text", text) if text else None
    v = c.find(f"{_S}v")
    raw = v.text if v is not None else None
    if raw is None:
        return None
    if kind == "s":
        return ("text", shared[int(raw)]) if shared[int(raw)] else None
    if kind == "str":
        return ("text", raw)
    if kind == "b":
        return ("boolean", raw == "1")
    if kind == "e":
        return ("error", raw)
    number = float(raw)
    if int(c.get("s", "0")) in dates:
        return ("date", serial_to_iso(number, date1904))
    return ("integer", int(number)) if number.is_integer() and abs(number) < 2**53 else ("real", number)


def sheet_table(sheet: Sheet) -> tuple[SheetTable | None, list[tuple[str, str]]]:
    """The table of a sheet: the first all-text row of its first twenty that is as wide as the next row and begins
    in the same column is the header; without one the sheet holds no table."""
    warnings = [("xlsx-merged-cells", f"merged: {', '.join(sheet.merged[:5])}")] if sheet.merged else []
    order = sorted(sheet.rows)
    for here, after in zip(order[:HEADER_ROWS], order[1 : HEADER_ROWS + 1], strict=False):
        head, below = sheet.rows[here], sheet.rows[after]
        if all(k == "text" for k, _ in head.values()) and len(head) >= len(below) and min(head) == min(below):
            break
    else:
        return None, [*warnings, ("xlsx-no-table", f"no header was found in {sheet.name!r}")]
    if here != order[0]:
        warnings.append(("xlsx-preamble-skipped", f"rows before {here} aren't part of the table"))
    left, right = min(head), max(head)
    if right - left + 1 > MAX_TABLE_COLUMNS:
        return None, [*warnings, ("xlsx-too-many-columns", f"{right - left + 1} columns")]
    body = [r for r in order if r > here]
    if len(body) > MAX_TABLE_ROWS:
        return None, [*warnings, ("xlsx-too-many-rows", f"{sheet.row_count} rows")]
    names, warned = unique_headers([str(head.get(c, ("", ""))[1]) for c in range(left, right + 1)], "xlsx-duplicate-header")
    columns = []
    types = []
    for c in range(left, right + 1):
        cells = [sheet.rows[r].get(c) for r in body]
        kind = unify_kinds([x[0] if x else "null" for x in cells])
        types.append(kind)
        columns.append([None if x is None else (str(x[1]) if kind == "text" else float(x[1]) if kind == "real" else x[1]) for x in cells])
    rows = [list(r) for r in zip(*columns, strict=True)]
    return SheetTable(sheet.name, names, types, rows, cell_range(here, left, body[-1] if body else here, right), here), warnings + warned


_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def pdf_page_paragraphs(text: str) -> list[str]:
    """Paragraphs of a page's extracted text: ligatures opened, words broken by a hyphen joined with it, lines joined."""
    for lig, plain in _LIGATURES.items():
        text = text.replace(lig, plain)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = re.sub(r"(?<=[^\W\d_])([-‐])\n(?=[^\W\d_])", r"\1", text)
    return [p for p in (re.sub(r"\s+", " ", b).strip() for b in re.split(r"\n[ \t]*\n", text)) if p]


def pdf_tree(pages: list[str], name: str, many: int = 500, most: int = 5000) -> Tree:
    """One section per page, without inferred headings."""
    if len(pages) > most:
        raise ValueError(f"{len(pages)} pages, over {most}")
    tree = Tree(re.sub(r"\.[^.]+$", "", name), None)
    if len(pages) > many:
        tree.warnings.append(("pdf-large-document", f"{len(pages)} pages"))
    empty = []
    for i, page in enumerate(pages, 1):
        paragraphs = pdf_page_paragraphs(page)
        if not paragraphs:
            empty.append(i)
            continue
        tree.section(1, f"Page {i}")
        for p in paragraphs:
            tree.add("paragraph", p, page=i)
    if pages and len(empty) == len(pages):
        raise ValueError("no page holds text; a scanned document can't be read")
    if empty:
        tree.warnings.append(("pdf-pages-without-text", f"pages {', '.join(map(str, empty[:10]))}"))
    return tree


def sheets_of(data: bytes) -> Iterator[tuple[str, SheetTable | None, list[tuple[str, str]]]]:
    book = read_workbook(data)
    for sheet in book.sheets:
        found, warnings = sheet_table(sheet)
        if book.date1904:
            warnings = [("xlsx-1904-dates", "dates count from 1904"), *warnings]
        yield sheet.name, found, warnings
