"""Glob patterns as regular expressions: path globs, SQLite's GLOB, and ignore rules."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_glob(pattern: str) -> str:
    """A glob over whole paths: ``**`` crosses separators, ``*`` and ``?`` don't, ``{a,b}`` and ``[..]`` as usual."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            stars = len(pattern[i:]) - len(pattern[i:].lstrip("*"))
            i += stars
            if stars > 1:
                if pattern[i : i + 1] == "/":
                    i += 1
                    out.append("(?:.*/)?")
                else:
                    out.append(".*")
            else:
                out.append("[^/]*")
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and "]" in pattern[i + 2 :]:
            close = pattern.index("]", i + 2)
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def sqlite_glob(pattern: str) -> str:
    """SQLite's GLOB: ``*`` and ``?`` match any characters, separators too; case-sensitive."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 2 :]:
            close = pattern.index("]", i + 2)
            out.append("[" + pattern[i + 1 : close].replace("\\", "\\\\") + "]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


@dataclass(frozen=True)
class IgnoreRule:
    pattern: str
    negated: bool = False
    source: str = "default"


def parse_ignore(contents: str, source: str) -> list[IgnoreRule]:
    rules = []
    for raw in contents.splitlines():
        line = raw.strip()
        if line and not line.startswith("#"):
            negated = line.startswith("!")
            body = line[1:].strip() if negated else line
            if body:
                rules.append(IgnoreRule(body, negated, source))
    return rules


def ignore_regex(pattern: str, directory: bool = False) -> str | None:
    """What an ignore pattern excludes: the named path, at any depth unless anchored, and everything below it.

    With ``directory``, what directories it names as such (those can be skipped without being read); a pattern that
    ends in ``/**`` names only what lies below, so it skips none.
    """
    p = pattern.replace("\\", "/")
    if directory and p.endswith("/**"):
        return None
    p = p.rstrip("/") if p.endswith("/") else p
    rooted = p.startswith("/")
    p = p.lstrip("/") if rooted else p
    anchored = rooted or ("/" in p and not p.startswith("**/"))
    body = path_glob(p)[1:-1]
    head = "" if anchored else "(?:.*/)?"
    tail = "" if directory else "(?:/.*)?"
    return f"^{head}{body}{tail}$"


def deciding_rule(path: Column, rules: Sequence[IgnoreRule]) -> Column:
    """Index of the rule that excludes a path, or null: of all rules that match it the last decides, a negated one
    takes the path back in; nothing inside a skipped directory can be taken back."""
    last = F.lit(-1)
    for i, rule in enumerate(rules):
        last = F.when(path.rlike(ignore_regex(rule.pattern)), F.lit(i)).otherwise(last)
    negated = [i for i, r in enumerate(rules) if r.negated]
    own = F.when((last >= 0) & ~last.isin(negated), last) if negated else F.when(last >= 0, last)
    return F.coalesce(pruning_rule(path, rules), own)


def pruning_rule(path: Column, rules: Sequence[IgnoreRule]) -> Column:
    """Index of the rule that skips one of the path's directories, or null."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    dirs = F.when(
        depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ).otherwise(F.array().cast("array<string>"))
    forms = [(i, r, ignore_regex(r.pattern, directory=True)) for i, r in enumerate(rules)]

    def decide(d: Column) -> Column:
        last = F.lit(-1)
        for i, rule, regex in forms:
            if regex is not None:
                last = F.when(d.rlike(regex), F.lit(-1 if rule.negated else i)).otherwise(last)
        return last

    return F.element_at(F.concat(F.filter(F.transform(dirs, decide), lambda i: i >= 0), F.array(F.lit(None).cast("int"))), 1)


class Decider:
    """The same decisions on the driver, for a walk that doesn't enter skipped directories."""

    def __init__(self, rules: Sequence[IgnoreRule]):
        self.rules = list(rules)
        self.whole = [re.compile(ignore_regex(r.pattern)) for r in rules]
        self.dirs = [re.compile(x) if (x := ignore_regex(r.pattern, directory=True)) else None for r in rules]

    def skips(self, directory: str) -> int | None:
        """Index of the rule by which a directory isn't entered, or null."""
        last = None
        for i, (rule, regex) in enumerate(zip(self.rules, self.dirs, strict=True)):
            if regex is not None and regex.match(directory):
                last = None if rule.negated else i
        return last

    def excludes(self, path: str) -> int | None:
        """Index of the rule that excludes a file of a directory that is entered, or null."""
        last = None
        for i, (rule, regex) in enumerate(zip(self.rules, self.whole, strict=True)):
            if regex.match(path):
                last = None if rule.negated else i
        return last
