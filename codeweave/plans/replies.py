"""What the tools say: text from the small tables that they return.

`Reply` is a tool's text and, where a counter of tokens is given, what request and reply cost. Tables that come here are capped
by their plans (limits of results, neighbours, findings), so collecting them is bounded; the statistics have a row for each
repository.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row

from .diagnose import Context

Counter = Callable[[str], int]

#: What tools say where there is nothing (fixed values).
NOTHING_FOUND = "No relevant code found. Try symbol= with an exact class/method name, or broaden the question."
NOT_AT_LINE = "No method or function was resolved at that file and line."
NOTHING_INDEXED = "No repos indexed yet. Use index_repo or index_github to get started."
NO_SOURCE = "(source unavailable)"
#: Width of the names of types in the statistics.
TYPE_WIDTH = 12


def vocabulary_counter(path: str) -> Counter:
    """Counts by a vocabulary file of the tokenizers library."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@dataclass(frozen=True)
class Reply:
    text: str
    input_tokens: int | None = None
    output_tokens: int | None = None

    def __str__(self) -> str:
        if self.input_tokens is None or self.output_tokens is None:
            return self.text
        total = self.input_tokens + self.output_tokens
        return f"{self.text}\n\nToken usage: input {self.input_tokens}, output {self.output_tokens}, total {total}."


def request_json(**params: object) -> str:
    """The request as it is counted; what is not given is left out."""
    return json.dumps({k: v for k, v in params.items() if v is not None}, ensure_ascii=False, separators=(",", ":"))


def reply(text: str, request: str, counter: Counter | None = None) -> Reply:
    return Reply(text) if counter is None else Reply(text, counter(request), counter(text))


def plural(n: int, word: str) -> str:
    return f"{n} {word}{'' if n == 1 else 's'}"


def results(found: DataFrame, repo: str | None = None) -> str:
    """Results under their files, in the order of each file's best, with their degrees."""
    rows = found.collect()
    if not rows:
        return NOTHING_FOUND
    rows.sort(key=lambda r: (-r["score"], r["id"]))
    files: dict[str, list[str]] = {}
    for r in rows:
        files.setdefault(r["file_path"], []).append(f"  [{r['type']} L{_of(r, 'start_line')}] {_line(r)} ← {plural(r['callers'], 'caller')} · {plural(r['callees'], 'callee')}")
    repos = sorted({_of(r, "repo_name") or "" for r in rows})
    label = repo or (repos[0] if len(repos) == 1 else f"{len(repos)} repos")
    return f"Repo: {label} | {len(rows)} results\n\n" + "\n\n".join("\n".join([path, *lines]) for path, lines in files.items())


def _of(r: Row, name: str):
    return r[name] if name in r.__fields__ else None


def _line(r: Row) -> str:
    """The first of the lines that a result shows, else its first line, else its name."""
    shown = _of(r, "source_lines") or []
    return shown[0].strip() if shown else _of(r, "first_line") or r["name"]


def node(found: DataFrame) -> str:
    """One node with its documentation and source."""
    r = found.first()
    if r is None or not r["found"]:
        return NOT_AT_LINE
    head = [f"{r['type']} {r['qualified_name'] or r['name']}", f"Location: {r['file_path']}:{r['start_line']}-{r['end_line']}", f"Language: {r['language'] or 'unknown'}"]
    head += [f"Documentation:\n{r['documentation']}"] if r["documentation"] else []
    return "\n".join([*head, "Source:", r["source"] or r["first_line"] or NO_SOURCE])


def nodes(found: DataFrame) -> str:
    """Several nodes, in the order in which they were asked for."""
    out = []
    for r in found.orderBy("probe").collect():
        if not r["found"]:
            out.append(f"{r['file_hint']}:{r['line']} — not found")
            continue
        own = [f"── {r['type']} {r['qualified_name'] or r['name']}  ({r['file_path']}:{r['start_line']}-{r['end_line']})"]
        own += [f"Doc: {r['documentation']}"] if r["documentation"] else []
        out.append("\n".join([*own, r["source"] or r["first_line"] or NO_SOURCE]))
    return "\n\n".join(out)


def statistics(repos: DataFrame, edges: int, name: str, detailed: bool = True) -> str:
    """Each repository's nodes by type; the tool names the path in a line of its own, the command line beside the name."""
    rows = sorted(repos.collect(), key=lambda r: r["repo_name"])
    total = f"Total nodes: {sum(r['total'] for r in rows)}   Total edges: {edges}"
    if not rows:
        return NOTHING_INDEXED if detailed else f"Code graph (db: {name})\n{total}\n\nNo repos indexed yet."
    blocks = []
    for r in rows:
        types = sorted(r["by_type"].items(), key=lambda p: (-p[1], p[0]))
        head, gap = ([f"  {r['repo_name']}", f"    Path: {r['repo_path']}"], "    ") if detailed else ([f"  {r['repo_name']}  ({r['repo_path']})"], "      ")
        blocks.append("\n".join([*head, f"    Nodes: {r['total']}", *[f"{gap}{t:<{TYPE_WIDTH}} {n}" for t, n in types]]))
    title = f"Code graph  (db: {name})" if detailed else f"Code graph (db: {name})"
    return "\n".join([title, total, "", *(["Indexed repos:"] if detailed else []), ("\n\n" if detailed else "\n").join(blocks)])


def diagnosis(context: Context, analyse: Callable[[str], str] | None = None, prompt: str = "") -> str:
    """What the graph knows of a failure; a cause is claimed only where the evidence is exact and there is an analyst."""
    where = context.epicentre.first()
    if where is not None and context.evidence_level == "exact":
        out = [f"📍 Epicentre: `{where['name']}`", f"   File: {where['file_path']}  Line: {where['start_line']}", f"   {where['first_line'] or ''}"]
    elif where is not None:
        out = ["⚠  The report names no place that the graph knows.", f"   Closest code by meaning: {where['name']}  ({where['file_path']}:{where['start_line']})"]
    else:
        out = ["⚠  The report names no place that the graph knows, and no code is close to it."]
    for title, table, line in (
        ("Callers", context.callers, _place),
        ("Callees", context.callees, _place),
        ("Related tests", context.tests, _place),
        ("Deterministic findings", context.findings, lambda r: f"{r['rule_id']} ({r['file_path']}:{r['line']}) — {r['message']}"),
        ("Linked incident evidence", context.evidence, lambda r: f"{r['id']} ({r['observed_at'] or 'time unknown'}) — {r['summary']}"),
    ):
        rows = table.collect()
        if rows:
            out += [f"\n{title} ({len(rows)}):", *[f"  • {line(r)}" for r in rows]]
    text = "\n".join(out)
    if context.evidence_level != "exact":
        return (
            f"{text}\n── What is missing ──\nWithout a place in the code no cause is named.\n"
            "Give a trace, or a file and a line; what was observed at run time (requests, routes, deployments, dependencies, resources) goes into runtimeEvidence."
        )
    if analyse is None:
        return f"{text}\n── AI diagnosis unavailable ──\nNo analyst is configured."
    try:
        return f"{text}\n{'─' * 60}\n{analyse(prompt)}"
    except Exception as e:  # noqa: BLE001  what the graph knows is worth saying without the analyst
        return f"{text}\n── AI diagnosis unavailable ──\nAI analysis failed: {e}"


def _place(r: Row) -> str:
    return f"{r['name']}  ({r['file_path']}:{r['start_line']})"


def stored_evidence(incident: str, linked: Row | None) -> str:
    if linked is None:
        return f"Stored evidence {incident}. No exact code location was linked."
    return f"Stored evidence {incident} and linked it to {linked['file_path']}:{linked['start_line']} ({linked['name']})."


def stored_evaluation(evaluation: str) -> str:
    return f"Recorded evaluation {evaluation}."
