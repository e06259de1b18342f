"""What a parser gives, and how declarations become nodes and edges.

A language module finds spans of tokens: declarations, calls, references. `assemble` nests the spans, so a
declaration's parent and a call's owner are the innermost spans around them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from .tokens import Source


@dataclass
class Declaration:
    kind: str
    name: str
    first: int
    last: int
    extends: list[str] = field(default_factory=list)
    implements: list[str] = field(default_factory=list)


@dataclass
class Parsed:
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)


def content_hash(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest()[:12]


def block_comment(lines: list[str], start: int) -> str | None:
    """The comment right above a line: a block, without its marks, or consecutive `//` lines."""
    at = start - 2
    if at < 0 or at >= len(lines):
        return None
    if lines[at].strip().endswith("*/"):
        first = next((i for i in range(at, -1, -1) if lines[i].lstrip().startswith("/*")), 0)
        text = re.sub(r"/\*\*?|\*/", "", "\n".join(lines[first : at + 1]))
        return re.sub(r"(?m)^\s*\*\s?", "", text).strip() or None
    return line_comment(lines, start, r"^//\s?")


def line_comment(lines: list[str], start: int, mark: str = r"^///?\s?") -> str | None:
    """Consecutive `//` lines right above a line."""
    at, found = start - 2, []
    while 0 <= at < len(lines) and lines[at].lstrip().startswith("//"):
        found.append(re.sub(mark, "", lines[at].strip() if mark.startswith("^///") else lines[at].lstrip()))
        at -= 1
    return "\n".join(reversed(found)).strip() or None


def assemble(
    path: str,
    source: Source,
    language: str,
    declarations: list[Declaration],
    calls: list[tuple[int, str]],
    qualify: Callable[[Declaration, list[Declaration]], str],
    comment: Callable[[list[str], int], str | None],
    file_name: str,
    defines: Callable[[str], bool],
    may_call: Callable[[str], bool] = lambda kind: True,
    on_call: Callable[[str, int, int, list[dict]], None] | None = None,
) -> tuple[Parsed, dict[int, str]]:
    """Nodes and edges of spans and calls (token, name); ids of declarations by their first token.

    A call counts once for each owner and name, where it comes first; calls of the owner's own name do not.
    """
    out, tokens = Parsed(), source.tokens
    file_id = f"{path}:FILE:{path}:0"
    out.nodes.append({"id": file_id, "type": "FILE", "name": path.rpartition("/")[2], "file_path": path, "start_line": 1, "end_line": len(source.lines), "hash": content_hash(source.text), "qualified_name": file_name, "language": language, "documentation": None})
    events: list[tuple[int, int, object]] = [(d.first, -d.last, d) for d in declarations]
    events += [(at, 1, name) for at, name in calls]
    stack: list[tuple[Declaration, str]] = []
    ids: dict[int, str] = {}
    seen: set[tuple[str, str]] = set()
    for at, _, what in sorted(events, key=lambda e: e[:2]):
        while stack and stack[-1][0].last < at:
            stack.pop()
        if isinstance(what, Declaration):
            start, end = tokens[what.first].line, tokens[what.last].end_line
            own = f"{path}:{what.kind}:{what.name}:{start}"
            ids[what.first] = own
            body = "\n".join(source.lines[start - 1 : end])
            out.nodes.append({"id": own, "type": what.kind, "name": what.name, "file_path": path, "start_line": start, "end_line": end, "hash": content_hash(body), "qualified_name": qualify(what, [d for d, _ in stack]), "language": language, "documentation": comment(source.lines, start)})
            out.edges.append(_edge(stack[-1][1] if stack else file_id, own, "CONTAINS", 1.0, "structural"))
            if defines(what.kind):
                out.edges.append(_edge(file_id, own, "DEFINES", 1.0, "structural"))
            out.refs += [{"kind": "extends", "source_id": own, "target_name": n} for n in what.extends]
            out.refs += [{"kind": "implements", "source_id": own, "target_name": n} for n in what.implements]
            stack.append((what, own))
        elif stack:
            owner, own = stack[-1]
            if may_call(owner.kind) and what != owner.name and (own, what) not in seen:
                seen.add((own, what))
                line = tokens[source.line_of_call(at)].line
                out.edges.append(_edge(own, what, "CALLS", 0.6, "ast", line))
                if on_call:
                    on_call(own, at, line, out.edges)
    return out, ids


def _edge(source: str, target: str, kind: str, confidence: float, resolution: str, line: int | None = None) -> dict:
    return {"source": source, "target": target, "type": kind, "confidence": confidence, "resolution": resolution, "source_line": line}
