"""Markdown: front matter, ATX and setext headings, paragraphs, lists, fenced and indented code, tables, quotes.

A block scanner over lines; inline marks are taken off, link texts kept. Thematic breaks and raw HTML blocks give no
nodes. The title is the front matter's, else the first level-one heading, else the file name.
"""

from __future__ import annotations

import re

from stratalith.sources.tree import Tree

_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^`]*)$")
_BREAK = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^( {0,3})(?:([-*+])|(\d{1,9})[.)])(?:[ \t]+(.*))?$")
_RULE = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_HTML = re.compile(r"^ {0,3}<(?:[a-zA-Z/!?])")
_INLINE = (
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"),
    (re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"\1"),
    (re.compile(r"\[([^\]]*)\]\[[^\]]*\]"), r"\1"),
    (re.compile(r"<((?:https?|mailto):[^>\s]+)>"), r"\1"),
    (re.compile(r"(`+)(.+?)\1"), r"\2"),
    (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"), r"\2"),
    (re.compile(r"(?<![\w*])\*(?=\S)(.+?)(?<=\S)\*(?!\w)"), r"\1"),
    (re.compile(r"(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)"), r"\1"),
    (re.compile(r"~~(.+?)~~"), r"\1"),
    (re.compile(r"\\([!-/:-@\[-`{-~])"), r"\1"),
)


def inline(text: str) -> str:
    for pattern, keep in _INLINE:
        text = pattern.sub(keep, text)
    return text.strip()


def front_matter(lines: list[str]) -> tuple[dict[str, str], int, list[tuple[str, str]]]:
    """(top-level scalar fields, lines taken, warnings)."""
    if not lines or lines[0].strip() != "---":
        return {}, 0, []
    end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() in ("---", "...")), None)
    if end is None:
        return {}, 0, []
    fields: dict[str, str] = {}
    warnings = []
    held = [x for x in lines[1:end] if x.strip() and not x.lstrip().startswith("#")]
    if held and (held[0].startswith(("- ", "[")) or not any(":" in x for x in held)):
        # A list or a bare value: fit to be read, but no mapping.
        return {}, end + 1, [("frontmatter-not-a-mapping", "the front matter is no mapping, so it was left out")]
    for raw in lines[1:end]:
        if not raw.strip() or raw.lstrip().startswith("#") or raw[:1] in " \t-":
            continue
        key, colon, value = raw.partition(":")
        if not colon:
            warnings.append(("frontmatter-invalid", "the front matter isn't a mapping of keys to values"))
            continue
        fields[key.strip()] = value.strip().strip("\"'")
    return fields, end + 1, warnings


def parse_markdown(text: str, name: str) -> Tree:
    """The tree of a Markdown text; ``name`` is the file name, the last resort for a title."""
    lines = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    fields, at, warnings = front_matter(lines)
    first = next((m[2] for x in lines[at:] if (m := _ATX.match(x)) and len(m[1]) == 1 and m[2]), None)
    tree = Tree(fields.get("title") or (inline(first) if first else None) or re.sub(r"\.[^.]+$", "", name))
    tree.warnings += warnings
    tree.nodes[0].metadata = {"frontmatter": fields} if fields else {}
    n = len(lines)
    if not text.strip():
        tree.warnings.append(("empty-file", "the file holds no text"))
    while at < n:
        line = lines[at]
        if not line.strip():
            at += 1
            continue
        begin = at
        if m := _ATX.match(line):
            tree.section(len(m[1]), inline(m[2] or ""), at + 1, at + 1)
            at += 1
        elif m := _FENCE.match(line):
            mark, info, body = m[1], m[2].strip(), []
            at += 1
            while at < n and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[at]):
                body.append(lines[at])
                at += 1
            at += 1
            tree.add("code", "\n".join(body).strip("\n"), begin + 1, min(at, n), language=info.split(" ")[0] if info else None)
        elif _BREAK.match(line) and not _ITEM.match(line.replace("- -", "--")):
            at += 1
        elif line.startswith(("    ", "\t")):
            body = []
            while at < n and (lines[at].startswith(("    ", "\t")) or not lines[at].strip()):
                body.append(re.sub(r"^(?: {4}|\t)", "", lines[at]))
                at += 1
            tree.add("code", "\n".join(body).strip("\n"), begin + 1, at)
        elif _ITEM.match(line):
            items, ordered = [], _ITEM.match(line)[3] is not None
            while at < n:
                m = _ITEM.match(lines[at])
                if m:
                    items.append(m[4] or "")
                elif lines[at].strip() and (lines[at][:1] in " \t" or lines[at - 1].strip()) and not _ATX.match(lines[at]) and not _FENCE.match(lines[at]):
                    inner = re.sub(r"^\s*(?:[-*+]|\d{1,9}[.)])\s+", "", lines[at])
                    if inner != lines[at].lstrip() or not items:
                        items.append(inner)
                    else:
                        items[-1] += " " + inner.strip()
                elif not lines[at].strip() and at + 1 < n and (_ITEM.match(lines[at + 1]) or lines[at + 1].startswith("  ")):
                    pass
                else:
                    break
                at += 1
            tree.add("list", "\n".join(f"- {inline(x)}" for x in items if x.strip()), begin + 1, at, ordered=ordered)
        elif "|" in line and at + 1 < n and _RULE.match(lines[at + 1]) and "|" in lines[at + 1]:
            rows = [line]
            at += 2
            while at < n and lines[at].strip() and "|" in lines[at]:
                rows.append(lines[at])
                at += 1
            # Cells follow one another without a separator, row by row, as the text of a table always has.
            cells = [[inline(c) for c in re.split(r"(?<!\\)\|", r.strip().strip("|"))] for r in rows]
            tree.add("table", "".join("".join(r) for r in cells), begin + 1, at, rows=len(rows) - 1, columns=len(cells[0]))
        elif _HTML.match(line):
            while at < n and lines[at].strip():
                at += 1
        elif line.lstrip().startswith(">"):
            body = []
            while at < n and lines[at].strip():
                body.append(re.sub(r"^\s*>[ \t]?", "", lines[at]))
                at += 1
            tree.add("paragraph", inline(" ".join(x.strip() for x in body)), begin + 1, at, quote=True)
        else:
            body = []
            level = 0
            while at < n and lines[at].strip():
                if body and (m := _SETEXT.match(lines[at])):
                    level = 1 if m[1][0] == "=" else 2
                    at += 1
                    break
                if body and (_ATX.match(lines[at]) or _FENCE.match(lines[at]) or _ITEM.match(lines[at]) or lines[at].lstrip().startswith(">") or _BREAK.match(lines[at])):
                    break
                body.append(lines[at].strip())
                at += 1
            if level:
                tree.section(level, inline(" ".join(body)), begin + 1, at)
            else:
                tree.add("paragraph", inline("\n".join(body)), begin + 1, at)
    return tree
