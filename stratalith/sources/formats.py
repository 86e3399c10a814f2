"""Which parser reads a file, and whether its bytes are text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalith.constants import BYTE_PARSERS, FORMATS


def _choose(path: Column, index: int) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    extension = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    out = F.lit(None).cast("string")
    for entry in reversed(FORMATS):
        hit = extension.isin(*entry[2])
        if entry[3]:
            hit = hit | name.isin(*entry[3])
        out = F.when(hit, entry[index]).otherwise(out)
    return out


def parser_of(path: Column) -> Column:
    """Parser id by extension or whole name; null for an unsupported file."""
    return _choose(path, 0)


def media_type_of(path: Column) -> Column:
    return _choose(path, 1)


def _entry_for(path: str) -> tuple | None:
    name = path.rsplit("/", 1)[-1].lower()
    return next((f for f in FORMATS if name in f[3] or any(name.endswith(e) for e in f[2])), None)


def parser_for(path: str) -> str | None:
    found = _entry_for(path)
    return found[0] if found else None


def media_type_for(path: str) -> str | None:
    found = _entry_for(path)
    return found[1] if found else None


def text_class(content: Column, parser: Column) -> Column:
    """``text``, ``utf-16`` (by its byte order mark), ``binary`` (a NUL byte) or ``invalid-utf8``; formats that read
    bytes are exempt."""
    head = F.hex(F.substring(content, 1, 2))
    return (
        F.when(parser.isin(*BYTE_PARSERS), "bytes")
        .when(head.isin("FFFE", "FEFF"), "utf-16")
        .when(F.locate("\0", content.cast("string")) > 0, "binary")
        .when(~F.is_valid_utf8(content.cast("string")), "invalid-utf8")
        .otherwise("text")
    )


def _choose_sql(path: str, index: int) -> str:
    name = f"lower(regexp_extract({path}, '[^/]*$'))"
    cases = []
    for entry in FORMATS:
        tests = [f"{name} LIKE '%{e}'" for e in entry[2]] + [f"{name} = '{n}'" for n in entry[3]]
        cases.append(f"WHEN {' OR '.join(tests)} THEN '{entry[index]}'")
    return "CASE " + " ".join(cases) + " END"


def parser_sql(path: str) -> str:
    return _choose_sql(path, 0)


def media_type_sql(path: str) -> str:
    return _choose_sql(path, 1)
