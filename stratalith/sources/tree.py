"""A document tree under construction: what every parser of prose emits."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

NODE_SCHEMA = (
    "id string, artifact_id string, parent_id string, kind string, ordinal int, title string, text string, "
    "heading_path array<string>, line_start int, line_end int, page int, metadata string, revision_hash string, seq int"
)


@dataclass
class Node:
    kind: str
    title: str | None = None
    text: str | None = None
    line_start: int | None = None
    line_end: int | None = None
    page: int | None = None
    metadata: dict = field(default_factory=dict)
    heading_path: list[str] = field(default_factory=list)
    place: tuple[int, ...] = (0,)
    ordinal: int = 0


class Tree:
    """Nodes in document order; sections nest by heading level."""

    def __init__(self, title: str, line_start: int | None = 1):
        self.nodes = [Node("document", title, None, line_start)]
        self.stack: list[tuple[int, Node, int]] = [(0, self.nodes[0], 0)]  # level, section, children so far
        self.warnings: list[tuple[str, str]] = []

    def _attach(self, node: Node) -> Node:
        level, parent, count = self.stack[-1]
        node.ordinal, node.place = count, (*parent.place, count)
        node.heading_path = [s.title for _, s, _ in self.stack[1:] if s.title]
        self.stack[-1] = (level, parent, count + 1)
        self.nodes.append(node)
        return node

    def section(self, level: int, title: str, line_start: int | None = None, line_end: int | None = None, code: str = "empty-heading", **metadata) -> None:
        if not title:
            self.warnings.append((code, "a heading without text was skipped"))
            return
        while self.stack[-1][0] >= level and len(self.stack) > 1:
            self.stack.pop()
        node = self._attach(Node("section", title, None, line_start, line_end, metadata={"depth": level, **metadata}))
        node.heading_path = [*node.heading_path, title]
        self.stack.append((level, node, 0))

    def add(self, kind: str, text: str, line_start: int | None = None, line_end: int | None = None, page: int | None = None, **metadata) -> None:
        if text:
            self._attach(Node(kind, None, text, line_start, line_end, page, metadata))

    def rows(self, artifact: str) -> list[tuple]:
        out = []
        for seq, n in enumerate(self.nodes):
            own = f"{artifact}#{'.'.join(map(str, n.place))}"
            parent = f"{artifact}#{'.'.join(map(str, n.place[:-1]))}" if len(n.place) > 1 else None
            digest = hashlib.sha256(" ".join((n.kind, n.title or "", n.text or "")).encode("utf-8", "surrogatepass")).hexdigest()
            out.append(
                (own, artifact, parent, n.kind, n.ordinal, n.title, n.text, n.heading_path, n.line_start, n.line_end, n.page,
                 json.dumps(n.metadata, sort_keys=True, ensure_ascii=False), digest, seq)
            )
        return out
