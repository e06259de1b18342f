"""Queries over source trees on disk, parsers that a user registers, and sources with what makes parsing hard.

Trees are written by tasks, a file for each part or page, below the shared folder, and then scanned as any tree is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import stats
from ..sources import parsers, scan
from ..sources.places import shared_folder
from . import index
from . import lenses as L
from .queries import query
from .queries_code import REPO, made, made_sql, sources

#: Each file has itself and three declarations, two of which it contains, with two or three that it defines, and one or two calls.
_EVERY_NODE = "SELECT p_partkey FROM part, range(4)"
_EVERY_EDGE = "SELECT p_partkey FROM part, range(CASE p_partkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 6 ELSE 5 END)"


# --- trees ------------------------------------------------------------------------------------------------------------


def planted(files: DataFrame, folder: str) -> None:
    """Writes files (rel_path, content binary) below a folder that all executors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch.column("rel_path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at = f"{top}/{path}"
                system.create_dir(at.rpartition("/")[0], recursive=True)
                with system.open_output_stream(at) as out:
                    out.write(content)
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    files.select("rel_path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()


#: By k % 8: hidden and underlined names, ignored folders, tests, bytes that are no UTF-8.
_TREE = ["src/_app{k}.tsx", "pkg{s}/__init__{k}.py", "_internal/p{s}/x{k}.ts", ".config/{k}/y.yaml", "a/node_modules/{k}/z.ts", "src/p{s}/It{k}.Test.TS", "docs/{k}.md", "src/p{s}/Dockerfile"]
_BAD = "unhex('ff')"


@query(f"""WITH t AS (SELECT p_partkey AS k, CASE p_partkey % 8 {" ".join(f"WHEN {i} THEN {made_sql(x)}" for i, x in enumerate(_TREE))} END AS rel_path, 'é ' || p_partkey AS text FROM part)
SELECT rel_path, CASE WHEN contains(rel_path, 'Dockerfile') THEN '' ELSE lower(regexp_extract(rel_path, '\\.[a-zA-Z]+$')) END AS extension, CASE WHEN contains(rel_path, 'Dockerfile') THEN 'x' ELSE text || CASE WHEN k % 3 = 0 THEN chr(65533) || '!' ELSE '' END END AS content
FROM t WHERE k % 8 < 4 UNION SELECT 'src/p' || p_size || '/Dockerfile', '', 'x' FROM part WHERE p_partkey % 8 = 7""")
def scan_tree(spark: SparkSession, d: str) -> DataFrame:
    part = L.table(spark, d, "part")
    path = F.lit("")
    for i, template in enumerate(_TREE):
        path = F.when(F.col("p_partkey") % 8 == i, made(template)).otherwise(path)
    text = F.encode(F.concat(F.lit("é "), F.col("p_partkey").cast("string")), "UTF-8")
    bad = F.when(F.col("p_partkey") % 3 == 0, F.expr("X'FF21'")).otherwise(F.expr("X''"))
    files = part.select(path.alias("rel_path"), F.when(F.col("p_partkey") % 8 == 7, F.expr("X'78'")).otherwise(F.concat(text, bad)).alias("content"))
    folder = shared_folder(spark, "tree")
    planted(files.dropDuplicates(["rel_path"]), folder)
    return scan.scan(spark, folder)


@query(f"""SELECT (SELECT count(*) FROM part)::bigint AS files_scanned, (SELECT count(*) FROM ({_EVERY_NODE}))::bigint AS nodes_found, (SELECT count(*) FROM ({_EVERY_EDGE}))::bigint AS edges_found, 0::bigint AS findings_found""")
def index_observed(spark: SparkSession, d: str) -> DataFrame:
    """Counts of an index that are observed while its tables are written."""
    counts, folder = stats.IndexCounts(schema.LEVEL_EDGES["high"]), shared_folder(spark, "index")
    counts.records(index.parse(counts.files(sources(spark, d)))).write.parquet(f"{folder}/records")
    nodes, edges = index.build(spark.read.schema(index.RECORD).parquet(f"{folder}/records"), REPO)
    counts.nodes(nodes).write.parquet(f"{folder}/nodes")
    edges.write.parquet(f"{folder}/edges")
    return counts.row(spark).drop("duration_ms")


# --- a parser of one's own --------------------------------------------------------------------------------------------


class Links:
    """A parser as a user may write one: pages, their titles and what they link to."""

    extensions = (".html",)

    def parse(self, path: str, source: str) -> parsers.Parsed:
        if "<html" not in source.lower():
            raise ValueError("no page")
        own = f"{path}:FILE:{path}:0"
        title = re.search(r"<title>([^<]*)</title>", source)
        node = {"id": own, "type": "FILE", "name": path.rpartition("/")[2], "file_path": path, "start_line": 1, "end_line": source.count("\n") + 1, "qualified_name": title[1] if title else None, "language": "html"}
        return parsers.Parsed([node], [], [{"kind": "import", "source_id": own, "target_name": t} for t in re.findall(r'href="([^"]*)"', source)])


def _page_files(spark: SparkSession, d: str) -> DataFrame:
    # Every seventh page is one that the parser cannot read.
    html = F.when(F.col("page_id") % 7 == 3, F.lit("plain text")).otherwise(F.col("html"))
    return L.table(spark, d, "pages").select(F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".html")).alias("rel_path"), html.alias("content"))


_PAGES = """pages_ AS (SELECT 'web/' || page_id || '.html' AS path, CASE WHEN page_id % 7 = 3 THEN 'plain text' ELSE html END AS html FROM pages),
good AS (SELECT path || ':FILE:' || path || ':0' AS id, html FROM pages_ WHERE contains(lower(html), '<html'))"""


@query(f"""WITH {_PAGES} SELECT 'link' AS record, id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS value FROM good
UNION ALL SELECT 'title', id, CASE WHEN regexp_matches(html, '<title>[^<]*</title>') THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END FROM good
UNION ALL SELECT 'error', path, 'ValueError: no page' FROM pages_ WHERE NOT contains(lower(html), '<html')""")
def parse_registered(spark: SparkSession, d: str) -> DataFrame:
    """By the table function, whose columns follow the kind of record."""
    parsers.register_function(spark, "parse_page", {".html": Links()})
    files = _page_files(spark, d)
    parsed = "FROM {f} f, LATERAL parse_page(f.rel_path, f.content, '%s') r"
    return spark.sql(
        f"SELECT 'link' AS record, r.source_id AS id, r.target_name AS value {parsed % 'ref'} UNION ALL SELECT 'title', r.id, r.qualified_name {parsed % 'node'} UNION ALL SELECT 'error', r.file_path, r.error {parsed % 'error'}",
        f=files,
    )


@query(f"WITH {_PAGES} SELECT path AS file_path, 'ValueError: no page' AS error FROM pages_ WHERE NOT contains(lower(html), '<html')")
def parse_errors(spark: SparkSession, d: str) -> DataFrame:
    return index.errors(index.parse(_page_files(spark, d), {".html": Links()}))


# --- sources that are hard to parse -----------------------------------------------------------------------------------

_JAVA = """package shop.deep;
import java.util.List;
import static java.lang.Math.max;
/**
 * Box {k}.
 */
@Named("class Fake { void fake() {} }")
public final class Box{k}<T extends Comparable<T>> extends Base<List<T>> implements Held, store.Kept {
  @Inject private Instance<Clock{s}> clock;
  // void gone() { lost(); }
  /* class Gone { } */
  private String text = "void no() { never(); }";
  interface Lid{k} { void open(); }
  enum Size { SMALL(1) { int of() { return pick(); } }, LARGE(2); Size(int n) { keep(n); } }
  public <X> List<X> put(String a) throws Err {
    String v = config.getConfigurationItem(LIMIT_{s}, a);
    new Helper(a).help(x -> other(x));
    return put(a, 1);
  }
  public <X> List<X> put(String a, int n) { return max(a, find{s}(n)); }
}
"""
_TYPESCRIPT = """import { need } from './need{s}';
import type { Kind } from "../kind";
// export class Gone { lost() {} }
/** Panel {k}. */
export abstract class Panel{k}<T> extends ui.Base<Map<string, T>> implements Shown, Kept<T> {
  private text = `class No {k} ${deep{s}(1)} { never() {} }`;
  static make(): Panel{k}<any> { return build(); }
  draw(a: string): void;
  draw(a: any, b = /x"(y{/.test(a)) { /* hidden(); */ return this.paint(inner(a)); }
  get size() { return count(this); }
}
interface Shown extends Seen, Held<number> { show(x: number): void }
export const fold{k} = <T,>(xs: T[]) => xs.map(x => step{s}(x));
export async function load{k}() {
  function nested() { return pick(); }
  await nested(); load{k}();
}
"""
_CSHARP = """using System;
using static Lib.Tools;
namespace Deep.P{s} {
  // class Gone { void Lost() { } }

  /// About {k}.
  public abstract partial class Job{k}<T> : Base<List<T>>, IRun<T>, IDisposable where T : class {
    private string text = @"class No { void Never() { } }";
    public int Size => Count(text);
    public Job{k}(Dep d) : base(d) { Init(d); }
    protected override async Task<T> Run(int a) { return await d.Work<T>(a, Inner(a)); }
    protected T Run(string a) { T Add(int x) => Sum(x); return Add(1); }
    struct Key : IEquatable<Key> { public bool Equals(Key k) { return Same{s}(k); } }
  }
  interface IRun<T> : IBase<T> { void Go(); }
  enum Level : byte { Low, High }
}
"""
_DEEP = [(_JAVA, "deep/Box{k}.java"), (_TYPESCRIPT, "deep/panel{k}.ts"), (_CSHARP, "deep/Job{k}.cs")]
#: By language: (kind, name, first line, last line, qualified name, documentation, number of the one around it, -1 for the file).
_NODES = [
    [
        ("CLASS", "Box{k}", 7, 21, "shop.deep.Box{k}", "Box {k}.", -1), ("INTERFACE", "Lid{k}", 13, 13, "shop.deep.Lid{k}", None, 0), ("METHOD", "open", 13, 13, "shop.deep.Box{k}.Lid{k}.open", None, 1), ("CLASS", "Size", 14, 14, "shop.deep.Size", None, 0),
        ("METHOD", "of", 14, 14, "shop.deep.Box{k}.Size.of", None, 3), ("METHOD", "Size", 14, 14, "shop.deep.Box{k}.Size.Size", None, 3), ("METHOD", "put", 15, 19, "shop.deep.Box{k}.put", None, 0), ("METHOD", "put", 20, 20, "shop.deep.Box{k}.put", None, 0),
    ],
    [
        ("CLASS", "Panel{k}", 5, 11, "Panel{k}", "Panel {k}.", -1), ("METHOD", "make", 7, 7, "make", None, 0), ("METHOD", "draw", 8, 8, "draw", None, 0), ("METHOD", "draw", 9, 9, "draw", None, 0), ("METHOD", "size", 10, 10, "size", None, 0),
        ("INTERFACE", "Shown", 12, 12, "Shown", None, -1), ("METHOD", "show", 12, 12, "show", None, 5), ("FUNCTION", "fold{k}", 13, 13, "fold{k}", None, -1), ("FUNCTION", "load{k}", 14, 17, "load{k}", None, -1), ("FUNCTION", "nested", 15, 15, "nested", None, 8),
    ],
    [
        ("CLASS", "Job{k}", 7, 14, "Deep.P{s}.Job{k}", "About {k}.", -1), ("METHOD", "Job{k}", 10, 10, "Deep.P{s}.Job{k}.Job{k}", None, 0), ("METHOD", "Run", 11, 11, "Deep.P{s}.Job{k}.Run", None, 0), ("METHOD", "Run", 12, 12, "Deep.P{s}.Job{k}.Run", None, 0),
        ("FUNCTION", "Add", 12, 12, "Deep.P{s}.Job{k}.Run.Add", None, 3), ("CLASS", "Key", 13, 13, "Deep.P{s}.Job{k}.Key", None, 0), ("METHOD", "Equals", 13, 13, "Deep.P{s}.Job{k}.Key.Equals", None, 5), ("INTERFACE", "IRun", 15, 15, "Deep.P{s}.IRun", None, -1),
        ("METHOD", "Go", 15, 15, "Deep.P{s}.IRun.Go", None, 7), ("CLASS", "Level", 16, 16, "Deep.P{s}.Level", None, -1),
    ],
]
#: (number of the caller, name, line, type)
_CALLS = [
    [(4, "pick", 14, "CALLS"), (5, "keep", 14, "CALLS"), (6, "getConfigurationItem", 16, "CALLS"), (6, "LIMIT_{s}", 16, "READS_CONFIG"), (6, "help", 17, "CALLS"), (6, "other", 17, "CALLS"), (7, "max", 20, "CALLS"), (7, "find{s}", 20, "CALLS")],
    [(0, "deep{s}", 6, "CALLS"), (1, "build", 7, "CALLS"), (3, "test", 9, "CALLS"), (3, "paint", 9, "CALLS"), (3, "inner", 9, "CALLS"), (4, "count", 10, "CALLS"), (7, "map", 13, "CALLS"), (7, "step{s}", 13, "CALLS"), (9, "pick", 15, "CALLS"), (8, "nested", 16, "CALLS")],
    [(1, "Init", 10, "CALLS"), (2, "Work", 11, "CALLS"), (2, "Inner", 11, "CALLS"), (4, "Sum", 12, "CALLS"), (3, "Add", 12, "CALLS"), (6, "Same{s}", 13, "CALLS")],
]
#: (kind, number of the source, name)
_REFS = [
    [("extends", 0, "Base"), ("implements", 0, "Held"), ("import", -1, "java.util.List"), ("import", -1, "java.lang.Math.max"), ("injects", 0, "Clock{s}")],
    [("extends", 0, "Base"), ("implements", 0, "Shown"), ("implements", 0, "Kept"), ("extends", 5, "Seen"), ("extends", 5, "Held"), ("import", -1, "./need{s}"), ("import", -1, "../kind")],
    [("extends", 0, "Base"), ("implements", 0, "IRun"), ("implements", 0, "IDisposable"), ("implements", 5, "IEquatable"), ("extends", 7, "IBase"), ("import", -1, "System"), ("import", -1, "Lib.Tools")],
]
#: Whether a file defines what lies within methods and types, too: which kinds it defines.
_DEFINED = [("CLASS", "INTERFACE"), ("CLASS", "INTERFACE", "FUNCTION"), ("CLASS", "INTERFACE")]


def _id(turn: int, i: int) -> str:
    path = _DEEP[turn][1]
    kind, name, first = ("FILE", path, 0) if i < 0 else _NODES[turn][i][:3]
    return made_sql(f"{path}:{kind}:{name}:{first}")


def _each(rows: list[tuple[int, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {values} FROM part WHERE p_partkey % 3 = {turn}" for turn, values in rows)


def _deep(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("p_partkey") % 3
    path, text = (F.when(turn == 0, made(_DEEP[0][i])).when(turn == 1, made(_DEEP[1][i])).otherwise(made(_DEEP[2][i])) for i in (1, 0))
    return index.parse(L.table(spark, d, "part").select(path.alias("rel_path"), text.alias("content")))


@query(_each([(t, f"{_id(t, i)} AS id, '{n[0]}' AS type, {made_sql(n[1])} AS name, {n[2]} AS start_line, {n[3]} AS end_line, {made_sql(n[4])} AS qualified_name, {made_sql(n[5]) if n[5] else 'NULL::varchar'} AS documentation") for t in range(3) for i, n in enumerate(_NODES[t])]))
def parse_deep_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _deep(spark, d).where("record = 'node' AND type <> 'FILE'").select("id", "type", "name", "start_line", "end_line", "qualified_name", "documentation")


@query(_each(
    [(t, f"{_id(t, a)} AS source, {made_sql(name)} AS target, '{kind}' AS type, {line} AS source_line") for t in range(3) for a, name, line, kind in _CALLS[t]]
    + [(t, f"{_id(t, n[6])}, {_id(t, i)}, 'CONTAINS', NULL") for t in range(3) for i, n in enumerate(_NODES[t])]
    + [(t, f"{_id(t, -1)}, {_id(t, i)}, 'DEFINES', NULL") for t in range(3) for i, n in enumerate(_NODES[t]) if n[0] in _DEFINED[t]]
))
def parse_deep_edges(spark: SparkSession, d: str) -> DataFrame:
    return _deep(spark, d).where("record = 'edge'").select("source", "target", "type", "source_line")


@query(_each([(t, f"'{kind}' AS kind, {_id(t, i)} AS source_id, {made_sql(name)} AS target_name") for t in range(3) for kind, i, name in _REFS[t]]))
def parse_deep_refs(spark: SparkSession, d: str) -> DataFrame:
    return _deep(spark, d).where("record = 'ref'").select("kind", "source_id", "target_name")
