"""HTML: headings open sections; paragraphs, lists, code and tables become nodes; scripts and page chrome are dropped.

Text directly inside an unrecognised container isn't part of any block and is lost; how many characters that were is
kept in the document node's metadata.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from stratalith.constants import HTML_CHROME, HTML_DROPPED, HTML_LANDMARKS, HTML_NOISE_SHARE
from stratalith.sources.tree import Tree

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {"p": "paragraph", "blockquote": "paragraph", "figcaption": "paragraph", "dt": "paragraph", "dd": "paragraph",
           "ul": "list", "ol": "list", "pre": "code", "table": "table"}
_HEADINGS = {f"h{i}": i for i in range(1, 7)}
_CHARSET = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def decode_html(data: bytes) -> tuple[str, list[tuple[str, str]]]:
    """Text of a page: a declared legacy encoding is honoured with a warning, else strict UTF-8."""
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8"), []
    m = _CHARSET.search(data[:4096])
    name = m[1].decode("ascii").lower() if m else "utf-8"
    if name in ("utf-8", "utf8"):
        return data.decode("utf-8"), []
    try:
        return data.decode(name), [("html-declared-encoding", f"decoded as {name}, which the page declares")]
    except LookupError:
        return data.decode("utf-8"), [("html-unknown-encoding", f"the declared encoding {name} isn't known")]


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title = ""
        self.events: list[tuple] = []  # ("heading", level, text, line, id) or (kind, text, line, end line, metadata)
        self.open: list[str] = []
        self.dropped = 0
        self.landmarks = 0
        self.in_title = False
        self.block: list | None = None  # kind, tag, parts, line, metadata
        self.depth = 0
        self.total = self.noise = self.lost = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            if tag == "br" and self.block:
                self.block[2].append("\n")
            return
        a = dict(attrs)
        self.open.append(tag)
        if self.dropped or tag in HTML_DROPPED or (tag in HTML_CHROME and not self.landmarks):
            self.dropped += 1
            return
        self.landmarks += tag in HTML_LANDMARKS
        if tag == "title" and not self.title:
            self.in_title = True
        elif self.block is None and (tag in _HEADINGS or tag in _BLOCKS):
            self.block = [tag if tag in _HEADINGS else _BLOCKS[tag], tag, [], self.getpos()[0], {}]
            if tag in ("ol", "ul"):
                self.block[4]["ordered"] = tag == "ol"
            if a.get("id") and tag in _HEADINGS:
                self.block[4]["anchor"] = a["id"]
            self.depth = 1
        elif self.block is not None:
            self.depth += tag == self.block[1]
            if tag in ("li", "tr", "p", "div"):
                self.block[2].append("\n")
            elif tag in ("td", "th"):
                self.block[2].append("\t")
            elif tag == "code" and "class" in a and self.block[0] == "code":
                m = re.search(r"language-([\w+-]+)", a["class"] or "")
                if m:
                    self.block[4]["language"] = m[1]
            elif tag == "a" and a.get("href"):
                self.block[4].setdefault("links", []).append(a["href"])

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open:
            top = self.open.pop()
            self._closed(top)
            if top == tag:
                return

    def _closed(self, tag: str) -> None:
        if self.dropped:
            self.dropped -= 1
            return
        self.landmarks -= tag in HTML_LANDMARKS
        if tag == "title":
            self.in_title = False
        elif self.block is not None and tag == self.block[1]:
            self.depth -= 1
            if not self.depth:
                self._finish()

    def _finish(self) -> None:
        kind, tag, parts, line, metadata = self.block
        self.block = None
        raw = "".join(parts)
        end = self.getpos()[0]
        if kind == "code":
            text = raw.strip("\n")
        elif kind == "table":
            rows = [[re.sub(r"\s+", " ", c).strip() for c in r.split("\t")[1:]] for r in raw.split("\n") if "\t" in r]
            text = "\n".join(" | ".join(r) for r in rows)
            metadata |= {"rows": len(rows), "columns": max(map(len, rows), default=0)}
        elif kind == "list":
            text = "\n".join(f"- {x}" for x in (re.sub(r"\s+", " ", i).strip() for i in raw.split("\n")) if x)
        else:
            text = "\n".join(x for x in (re.sub(r"[ \t\r\f\v]+", " ", i).strip() for i in re.sub(r"(?<!\n)\n(?!\n)", "\n", raw).split("\n")) if x)
        if tag in _HEADINGS:
            self.events.append(("heading", _HEADINGS[tag], re.sub(r"\s+", " ", text), line, metadata))
        elif text:
            self.events.append((kind, text, line, end, metadata))

    def handle_data(self, data: str) -> None:
        seen = len(data.strip())
        self.total += seen
        if self.in_title:
            self.title += data
            self.total -= seen
        elif self.dropped:
            self.noise += seen
        elif self.block is not None:
            # Line ends in the source are white space, except in code.
            self.block[2].append(data if self.block[0] == "code" else re.sub(r"\s+", " ", data))
        else:
            self.lost += seen

    def close(self) -> None:
        super().close()
        while self.open:
            self._closed(self.open.pop())
        if self.block is not None:
            self._finish()


def parse_html(text: str, name: str) -> Tree:
    reader = _Reader()
    reader.feed(text)
    reader.close()
    first = next((e[2] for e in reader.events if e[0] == "heading" and e[2]), None)
    tree = Tree(re.sub(r"\s+", " ", reader.title).strip() or first or re.sub(r"\.[^.]+$", "", name))
    for e in reader.events:
        if e[0] == "heading":
            tree.section(e[1], e[2], e[3], e[3], **e[4])
        else:
            tree.add(e[0], e[1], e[2], e[3], **e[4])
    tree.nodes[0].metadata = {"lost_characters": reader.lost}
    if reader.total and reader.noise >= HTML_NOISE_SHARE * reader.total:
        tree.warnings.append(("html-noise-removed", f"{reader.noise} of {reader.total} characters were page chrome or code"))
    return tree
