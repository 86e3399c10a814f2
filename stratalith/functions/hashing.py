"""Content hashes, canonical encodings, identifiers and build roots."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(value: object) -> str:
    """An unambiguous text of a nested value: lengths before strings and numbers, counts before lists and maps."""
    if value is None:
        return "n"
    if isinstance(value, bool):
        return "b1" if value else "b0"
    if isinstance(value, str):
        return f"s{len(value.encode('utf-16-le', 'surrogatepass')) // 2}:{value}"
    if isinstance(value, int | float):
        if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
            return "x"
        text = str(int(value)) if float(value).is_integer() else f"{value:.17g}"
        return f"i{len(text)}:{text}"
    if isinstance(value, Mapping):
        return f"o{len(value)}:" + "".join(canonical(k) + canonical(value[k]) for k in sorted(value))
    if isinstance(value, Sequence):
        return f"a{len(value)}:" + "".join(map(canonical, value))
    raise TypeError(f"no canonical form of {type(value).__name__}")


def sha256(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def hash_root(members: Sequence[str]) -> str:
    return sha256(f"r{len(members)}:" + "".join(sorted(members)))


def hash_roots(members: DataFrame, hash_column: str = "member_hash", by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, root): the root of each group's hashes; equal hashes count as often as they occur.

    A tree of SHA-256 over hex digests: members of one class (their first four digits) are sorted, each with its number,
    and hashed; classes of one branch (the first two digits) likewise, then the branches. A list holds a 65,536th of a
    group's members or 256 digests, and a root doesn't depend on how rows are spread.
    """
    h = F.col(hash_column)
    counted = members.where(h.isNotNull()).groupBy(*by, h.alias("h")).agg(F.count(F.lit(1)).alias("n"))

    def digest(*parts: str) -> Column:
        lines = F.transform(F.array_sort(F.collect_list(F.struct(*parts))), lambda x: F.concat_ws(":", *[x[p].cast("string") for p in parts]))
        return F.sha2(F.array_join(lines, ","), 256).alias("d")

    level = counted.groupBy(*by, F.substring("h", 1, 4).alias("c")).agg(F.sum("n").alias("n"), digest("h", "n"))
    level = level.groupBy(*by, F.substring("c", 1, 2).alias("c")).agg(F.sum("n").alias("n"), digest("c", "d"))
    return level.groupBy(*by).agg(F.sum("n").alias("n"), digest("c", "d").alias("root"))


def artifact_id(source: Column, path: Column) -> Column:
    return F.concat_ws(":", source, path)


def parse_artifact_id(c: Column) -> tuple[Column, Column]:
    """(source id, relative path)."""
    return F.substring_index(c, ":", 1), F.regexp_replace(c, "^[^:]*:", "")


def node_id(artifact: Column, ordinals: Column) -> Column:
    return F.concat(artifact, F.lit("#"), F.array_join(F.transform(ordinals, lambda x: x.cast("string")), "."))


def chunk_id(artifact: Column, index: Column) -> Column:
    return F.concat(artifact, F.lit("@"), index.cast("string"))


def normalize_source_id(text: str) -> str:
    return re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9]+", "-", text.lower()))


def build_id(inputs: Mapping[str, object]) -> str:
    """Identity of a build: a hash of its named inputs, free of time, host and place."""
    return "bld_" + sha256(canonical(inputs))


def shortest_prefix(build: str, others: Sequence[str], least: int = 12) -> str:
    """The shortest unique prefix of at least ``least`` hash digits."""
    head, _, digits = build.partition("_")
    for n in range(least, len(digits) + 1):
        short = f"{head}_{digits[:n]}"
        if not any(o != build and o.startswith(short) for o in others):
            return short
    return build


def resolve_prefix(prefix: str, known: Sequence[str]) -> str:
    hits = sorted({k for k in known if k.startswith(prefix) or k.partition("_")[2].startswith(prefix)})
    if len(hits) != 1:
        raise LookupError(f"{prefix!r} names {len(hits)} builds")
    return hits[0]


def slug(text: str) -> str:
    return re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", text.lower()))


def slug_column(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


_IDENTIFIER = re.compile(r"[a-z][a-z0-9_]{0,62}\Z")


def identifier(name: str) -> str:
    if not _IDENTIFIER.match(name):
        raise ValueError(f"{name!r} is no safe identifier")
    return name


def table_sql_name(table_id: str, name: str) -> str:
    s, digest = slug(name)[:40], sha256(table_id)[:12]
    return identifier(f"t_{s}_{digest}" if s else f"t_{digest}")


def column_sql_name(ordinal: int, name: str) -> str:
    s = slug(name)[:40]
    return identifier(f"c_{ordinal}_{s}" if s else f"c_{ordinal}")


def table_sql_name_column(table_id: Column, name: Column) -> Column:
    s, digest = F.substring(slug_column(name), 1, 40), F.substring(F.sha2(table_id, 256), 1, 12)
    return F.when(s == "", F.concat(F.lit("t_"), digest)).otherwise(F.concat(F.lit("t_"), s, F.lit("_"), digest))
