"""Parsers of source files, by extension; `register` adds one or puts one in another's place.

The registry is the driver's. What runs on workers gets it with the task (`registry()` in the closure of `plans.index.parse` and of the
table function `register_function`), so parsers that a user registers need only be picklable.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from typing import Protocol

from pyspark.sql import SparkSession

from ...functions.text import FIRST_LINE, SOURCE_LINES
from .records import Parsed


class LanguageParser(Protocol):
    extensions: Iterable[str]

    def parse(self, path: str, source: str) -> Parsed: ...


Registry = Mapping[str, LanguageParser]

_BY_EXTENSION: dict[str, LanguageParser] = {}


def register(parser: LanguageParser) -> None:
    for e in parser.extensions:
        _BY_EXTENSION[e.lower()] = parser


def registry() -> dict[str, LanguageParser]:
    """The parsers that are registered now."""
    return dict(_BY_EXTENSION)


def supported_extensions() -> list[str]:
    return sorted(_BY_EXTENSION)


def parse_source(path: str, source: str, parsers: Registry | None = None) -> Parsed:
    """What a file declares and calls; nothing, not even the file, where no parser has its extension."""
    name = path.rpartition("/")[2]
    dot = name.rfind(".")
    parser = (_BY_EXTENSION if parsers is None else parsers).get(name[dot:].lower() if dot > 0 else "")
    return parser.parse(path, source) if parser else Parsed()


#: Columns of the tables that a file gives, by kind of record.
TABLES = {
    "node": "id string, type string, name string, file_path string, start_line int, end_line int, hash string, qualified_name string, language string, documentation string, source_code string, first_line string",
    "edge": "source string, target string, type string, confidence double, resolution string, source_line int",
    "ref": "kind string, source_id string, target_name string",
    "error": "file_path string, error string",
}

def records(path: str, content: str | None, parsers: Registry | None = None) -> Iterator[tuple[str, dict]]:
    """(kind, values) of all records of a file; the error alone where its parser fails."""
    try:
        parsed = parse_source(path, content or "", parsers)
    except Exception as e:  # noqa: BLE001  one bad file must not end the index; it is reported as a row
        yield "error", {"file_path": path, "error": f"{type(e).__name__}: {e}"}
        return
    lines = (content or "").split("\n")
    for n in parsed.nodes:
        start = n.get("start_line", 1) - 1
        own = lines[start : min(n.get("end_line", 1), start + SOURCE_LINES)] if n.get("type") != "FILE" else []
        yield "node", {**n, "source_code": "\n".join(own), "first_line": (lines[start] if start < len(lines) else "").strip()[:FIRST_LINE]}
    yield from (("edge", e) for e in parsed.edges)
    yield from (("ref", r) for r in parsed.refs)


def register_function(spark: SparkSession, name: str = "parse_source", parsers: Registry | None = None) -> None:
    """Registers a table function for SQL: `SELECT f.rel_path, r.* FROM files f, LATERAL parse_source(f.rel_path, f.content, 'node') r`.

    Its third argument, a constant, is the kind of record, one of `TABLES`; the columns follow it. Parsers are those that are registered
    now, or the ones given.
    """
    from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
    from pyspark.sql.types import StructType

    known = registry() if parsers is None else dict(parsers)
    schemas = {kind: StructType.fromDDL(table) for kind, table in TABLES.items()}

    class ParseSource:
        @staticmethod
        def analyze(path: AnalyzeArgument, content: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
            if not kind.isConstantExpression or kind.value not in schemas:
                raise ValueError(f"the third argument must be one of {', '.join(schemas)}")
            return AnalyzeResult(schema=schemas[kind.value])

        def eval(self, path: str, content: str, kind: str) -> Iterator[tuple]:
            for own, values in records(path or "", content, known):
                if own == kind:
                    yield tuple(values.get(c) for c in schemas[kind].names)

    spark.udtf.register(name, udtf(ParseSource))


from . import csharp, java, typescript  # noqa: E402

for _p in (java.JavaParser(), typescript.TypeScriptParser(), csharp.CSharpParser()):
    register(_p)
