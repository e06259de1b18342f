"""Queries over source trees and methods that are made of the driver's parts: parsing, indexing, diagnosis, question retrieval, merges.

Each part is a source file in one of three languages, and a method in a chain of calls. Templates say a text once for
both engines: `{k}` is the part's key, `{s}` its size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embed
from ..functions import text as T
from ..operators import filters, intervals, traverse, upsert
from ..sources.places import spread
from . import diagnose, index
from . import lenses as L
from . import retrieve as R
from .queries import query

JAVA = """package shop.p{s};
import lib.Need{s};
/** About {k}. */
public class Item{k} extends Item{s} implements Sold {
  public int sell{k}(int a) {
    check{k}(a);
    return pick{s}(a);
  }
  void check{k}(int a) { }
}
"""
TYPESCRIPT = """import { need } from './need{s}';
export class View{k} extends View{s} {
  show{k}(a: number) {
    return pick{s}(a);
  }
}
export function pick{s}(a: number) { return a; }
"""
CSHARP = """using Lib.Core;
namespace Shop.P{s};
class Job{k} : Job{s}, ISold {
  void Start{k}() { Step{k}(); }
  void Step{k}() { }
}
"""
#: By k % 3: text, path (sizes of 10 lie among data containers), language.
LANGUAGES = [(JAVA, "src/p{s}/Item{k}.java", "java"), (TYPESCRIPT, "src/p{s}/view{k}.ts", "typescript"), (CSHARP, "src/p{s}/Job{k}.cs", "csharp")]
REPO = "shop"


def _pieces(template: str) -> list[str]:
    return [p for p in re.split(r"(\{[ks]\})", template) if p]


def made(template: str) -> Column:
    return F.concat(*[F.col({"{k}": "p_partkey", "{s}": "p_size"}[p]).cast("string") if p in ("{k}", "{s}") else F.lit(p) for p in _pieces(template)])


def made_sql(template: str) -> str:
    return " || ".join({"{k}": "p_partkey", "{s}": "p_size"}[p] if p in ("{k}", "{s}") else "'" + p.replace("'", "''") + "'" for p in _pieces(template))


def sources(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("p_partkey") % 3
    path, text = (F.when(turn == 0, made(LANGUAGES[0][i])).when(turn == 1, made(LANGUAGES[1][i])).otherwise(made(LANGUAGES[2][i])) for i in (1, 0))
    path = F.when(F.col("p_size") == 10, F.regexp_replace(path, "^src/p10/", "src/dto/")).otherwise(path)
    return L.table(spark, d, "part").select(path.alias("rel_path"), text.alias("content"))


def records(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    return index.parse(sources(spark, d), kinds=kinds)


def _case(values: list[str]) -> str:
    return f"CASE p_partkey % 3 WHEN 0 THEN {values[0]} WHEN 1 THEN {values[1]} ELSE {values[2]} END"


#: (kind, name, line, last line, qualified name, documentation) of each language's declarations, in the order of the text.
_DECLARED = [
    [("CLASS", "Item{k}", 4, 10, "shop.p{s}.Item{k}", "About {k}."), ("METHOD", "sell{k}", 5, 8, "shop.p{s}.Item{k}.sell{k}", None), ("METHOD", "check{k}", 9, 9, "shop.p{s}.Item{k}.check{k}", None)],
    [("CLASS", "View{k}", 2, 6, "View{k}", None), ("METHOD", "show{k}", 3, 5, "show{k}", None), ("FUNCTION", "pick{s}", 7, 7, "pick{s}", None)],
    [("CLASS", "Job{k}", 3, 6, "Shop.P{s}.Job{k}", None), ("METHOD", "Start{k}", 4, 4, "Shop.P{s}.Job{k}.Start{k}", None), ("METHOD", "Step{k}", 5, 5, "Shop.P{s}.Job{k}.Step{k}", None)],
]
_FILES = f"""files AS (SELECT *, CASE WHEN p_size = 10 THEN regexp_replace(p, '^src/p10/', 'src/dto/') ELSE p END AS path FROM (
  SELECT p_partkey, p_size, {_case([made_sql(x[1]) for x in LANGUAGES])} AS p, {_case([made_sql(x[0]) for x in LANGUAGES])} AS content, {_case([f"'{x[2]}'" for x in LANGUAGES])} AS language FROM part))"""


def _declared_sql(turn: int, place: int) -> str:
    kind, name, start, end, qualified, doc = _DECLARED[turn][place]
    return f"""SELECT p_partkey, path, language, content, '{kind}' AS type, {made_sql(name)} AS name, {start} AS start_line, {end} AS end_line, {made_sql(qualified)} AS qualified_name,
  {made_sql(doc) if doc else 'NULL::varchar'} AS documentation, path || ':{kind}:' || {made_sql(name)} || ':{start}' AS id FROM files WHERE p_partkey % 3 = {turn}"""


_DECLARATIONS = "declared AS (" + "\nUNION ALL ".join(_declared_sql(t, i) for t in range(3) for i in range(3)) + ")"
_FILE_ID = "path || ':FILE:' || path || ':0'"
_NODES = f"""{_FILES}, {_DECLARATIONS}, lines AS (SELECT path AS p, string_split(content, chr(10)) AS l FROM files),
file_nodes AS (SELECT {_FILE_ID} AS id, 'FILE' AS type, string_split(path, '/')[-1] AS name, path AS file_path, 1 AS start_line, len(string_split(content, chr(10)))::integer AS end_line, substr(sha1(content), 1, 12) AS hash,
  CASE p_partkey % 3 WHEN 0 THEN 'shop.p' || p_size ELSE path END AS qualified_name, language, NULL::varchar AS documentation, string_split(content, chr(10))[1] AS first_line FROM files),
all_nodes AS (SELECT * FROM file_nodes UNION ALL
  SELECT id, type, name, path, start_line, end_line, substr(sha1(array_to_string(l[start_line:end_line], chr(10))), 1, 12), qualified_name, language, documentation, regexp_replace(l[start_line], '^\\s+|\\s+$', '', 'g') FROM declared JOIN lines ON p = path)"""


@query(f"WITH {_NODES} SELECT * FROM all_nodes")
def parse_nodes(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, "node").where("record = 'node'").select("id", "type", "name", "file_path", "start_line", "end_line", "hash", "qualified_name", "language", "documentation", "first_line")


def _own(turn: int, place: int) -> str:
    kind, name, start, *_ = _DECLARED[turn][place]
    return f"path || ':{kind}:' || {made_sql(name)} || ':{start}'"


def _call(turn: int, source: int, name: str, line: int) -> str:
    return f"SELECT {_own(turn, source)} AS source, {made_sql(name)} AS target, 'CALLS' AS type, 0.6::double AS confidence, {line} AS source_line, p_partkey, path FROM files WHERE p_partkey % 3 = {turn}"


_CALLS = "code_calls AS (" + " UNION ALL ".join([_call(0, 1, "check{k}", 6), _call(0, 1, "pick{s}", 7), _call(1, 1, "pick{s}", 4), _call(2, 1, "Step{k}", 4)]) + ")"
_STRUCTURE = "code_structure AS (" + " UNION ALL ".join(
    f"SELECT {a} AS source, {_own(t, i)} AS target, '{kind}' AS type FROM files WHERE p_partkey % 3 = {t}"
    for t in range(3)
    for i, kind, a in [(0, "CONTAINS", _FILE_ID), (0, "DEFINES", _FILE_ID), (1, "CONTAINS", _own(t, 0)), *([(2, "CONTAINS", _FILE_ID), (2, "DEFINES", _FILE_ID)] if t == 1 else [(2, "CONTAINS", _own(t, 0))])]
) + ")"


@query(f"WITH {_FILES}, {_CALLS}, {_STRUCTURE} SELECT source, target, type, confidence, source_line FROM code_calls UNION ALL SELECT source, target, type, 1.0::double, NULL FROM code_structure")
def parse_edges(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, "edge").where("record = 'edge'").select("source", "target", "type", "confidence", "source_line")


def _ref(turn: int, kind: str, source: str, name: str) -> str:
    return f"SELECT '{kind}' AS kind, {source} AS source_id, {made_sql(name)} AS target_name FROM files WHERE p_partkey % 3 = {turn}"


_REFS = "code_refs AS (" + " UNION ALL ".join(
    [_ref(0, "extends", _own(0, 0), "Item{s}"), _ref(0, "implements", _own(0, 0), "Sold"), _ref(0, "import", _FILE_ID, "lib.Need{s}"), _ref(1, "extends", _own(1, 0), "View{s}"), _ref(1, "import", _FILE_ID, "./need{s}")]
    + [_ref(2, "extends", _own(2, 0), "Job{s}"), _ref(2, "implements", _own(2, 0), "ISold"), _ref(2, "import", _FILE_ID, "Lib.Core")]
) + ")"


@query(f"WITH {_FILES}, {_REFS} SELECT * FROM code_refs")
def parse_refs(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, "ref").where("record = 'ref'").select("kind", "source_id", "target_name")


#: Calls of a name: the only method or function of that name, else those in the caller's file, else the first three by id.
_INDEXED = f"""{_NODES}, {_CALLS}, {_STRUCTURE}, {_REFS},
callable AS (SELECT id, name, file_path FROM all_nodes WHERE type IN ('METHOD', 'FUNCTION')),
ranked AS (SELECT c.source, n.id AS target, source_line, count(*) OVER w AS n, count(*) FILTER (n.file_path = c.path) OVER w AS own, n.file_path = c.path AS same, row_number() OVER (PARTITION BY c.source, c.target ORDER BY n.id) AS rank
  FROM code_calls c JOIN callable n ON n.name = c.target WINDOW w AS (PARTITION BY c.source, c.target)),
types AS (SELECT name, min(id) AS id FROM all_nodes WHERE type IN ('CLASS', 'INTERFACE') GROUP BY name HAVING count(*) = 1),
indexed AS (SELECT source, target, type, 1.0::double AS confidence, 'structural' AS resolution, NULL::integer AS source_line FROM code_structure
  UNION ALL SELECT source, target, 'CALLS', 0.6::double, 'ast', source_line FROM ranked WHERE n = 1 OR same OR (own = 0 AND rank <= 3)
  UNION ALL SELECT source_id, id, upper(kind), 1.0::double, 'ast', NULL FROM code_refs JOIN types ON name = target_name WHERE kind <> 'import')"""


@query(f"WITH {_INDEXED} SELECT '{REPO}::' || source AS source, '{REPO}::' || target AS target, type, confidence, resolution, source_line FROM indexed")
def index_edges(spark: SparkSession, d: str) -> DataFrame:
    return index.build(L.held(spark, d, records), REPO)[1].select("source", "target", "type", "confidence", "resolution", "source_line")


_KIN = "k AS (SELECT DISTINCT source, target FROM indexed WHERE type IN ('EXTENDS', 'IMPLEMENTS'))"


@query(f"""WITH {_INDEXED}, {_KIN}, k2 AS (SELECT DISTINCT a.source, b.target FROM k a JOIN k b ON a.target = b.source), k3 AS (SELECT DISTINCT a.source, b.target FROM k2 a JOIN k b ON a.target = b.source)
SELECT '{REPO}::' || source AS id, '{REPO}::' || target AS ancestor, min(d)::integer AS distance FROM (SELECT *, 1 AS d FROM k UNION ALL SELECT *, 2 FROM k2 UNION ALL SELECT *, 3 FROM k3) GROUP BY source, target""")
def inheritance(spark: SparkSession, d: str) -> DataFrame:
    """What 1 to 3 steps of extending and implementing lead to."""
    edges = index.build(L.held(spark, d, records), REPO)[1]
    return traverse.ancestors(edges, ["EXTENDS", "IMPLEMENTS"], 3)


@query(f"WITH {_NODES} SELECT '{REPO}::' || id AS id, type, 'high' AS index_level, '{REPO}' AS repo_name FROM all_nodes")
def index_nodes(spark: SparkSession, d: str) -> DataFrame:
    return index.build(L.held(spark, d, records), REPO)[0].select("id", "type", "index_level", "repo_name")


@query(f"WITH {_FILES} SELECT '{REPO}::' || path || ':FILE:' || path || ':0' AS id, string_split(path, '/')[-1] AS name, 1 AS start_line, 1 AS end_line, 'low' AS index_level FROM files")
def index_low(spark: SparkSession, d: str) -> DataFrame:
    return index.inventory(sources(spark, d), REPO, "").select("id", "name", "start_line", "end_line", "index_level")


@query(f"WITH {_NODES} SELECT '{REPO}::' || id AS id, 1.0::double AS norm FROM all_nodes WHERE type <> 'FILE' AND NOT contains(lower(file_path), '/dto/')")
def embedded_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = index.build(L.held(spark, d, records), REPO)[0]
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return embed.embed_nodes(nodes).select("id", F.round(norm, 4).alias("norm"))


@query(r"""WITH RECURSIVE words AS (SELECT p_partkey AS k, unnest(regexp_extract_all(p_name || ' loadXMLItem' || p_partkey || ' HTTP2Server_' || p_brand || ' ' || p_type, '\w+')) AS w FROM part),
parts AS (SELECT k, lower(unnest(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|\d+'))) AS p FROM words),
features AS (SELECT k, lower(w) AS f FROM words UNION ALL SELECT k, p FROM parts UNION ALL SELECT k, '#' || substr(p, i, 3) FROM (SELECT k, p, unnest(range(1, length(p) - 1)) AS i FROM parts)),
steps(n, c, s) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, s + 1 FROM steps WHERE s < 8),
bytes AS (SELECT n, c FROM steps WHERE s = 8),
crc(f, i, c) AS (SELECT DISTINCT f, 0, 4294967295::bigint FROM features UNION ALL SELECT f, i + 1, xor(crc.c >> 8, bytes.c) FROM crc JOIN bytes ON n = xor(crc.c & 255, ord(substr(f, i + 1, 1))) WHERE i < length(f)),
hashes AS (SELECT f, xor(c, 4294967295) AS h FROM crc WHERE i = length(f)),
counts AS (SELECT k, h % 256 AS i, sum(CASE WHEN h >> 31 = 1 THEN 1 ELSE -1 END) AS c FROM features JOIN hashes USING (f) GROUP BY k, h % 256 HAVING c <> 0),
least_ AS (SELECT k, min(abs(c)) AS least FROM counts GROUP BY k)
SELECT k AS part_id, string_agg(i || ':' || round(12.0 * c / least)::integer, ',' ORDER BY i) AS components FROM counts JOIN least_ USING (k) GROUP BY k""")
def embedding_components(spark: SparkSession, d: str) -> DataFrame:
    """All components that are not zero, as twelfths of the smallest of them; the SQL hashes the features anew."""
    p = spread(L.table(spark, d, "part"), "p_partkey")
    text = F.concat("p_name", F.lit(" loadXMLItem"), F.col("p_partkey").cast("string"), F.lit(" HTTP2Server_"), "p_brand", F.lit(" "), "p_type")
    rows = p.select(F.col("p_partkey").alias("part_id"), F.filter(F.transform(embed.embed_column(text), lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x"))), lambda e: e["x"] != 0).alias("e"))
    least = F.array_min(F.transform("e", lambda e: F.abs(e["x"])))
    told = F.transform("e", lambda e: F.concat_ws(":", e["i"].cast("string"), F.round(12 * e["x"] / F.col("least")).cast("int").cast("string")))
    return rows.withColumn("least", least).select("part_id", F.array_join(told, ",").alias("components"))


@query("SELECT page_id, path FROM (SELECT page_id, 'conf/' || CASE page_id % 4 WHEN 0 THEN 'App.YAML' WHEN 1 THEN 'Dockerfile' WHEN 2 THEN 'main.ts' ELSE 'CODEOWNERS' END AS path FROM pages) WHERE page_id % 4 <> 2")
def config_files(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("page_id") % 4
    path = F.concat(F.lit("conf/"), F.when(turn == 0, "App.YAML").when(turn == 1, "Dockerfile").when(turn == 2, "main.ts").otherwise("CODEOWNERS"))
    return L.table(spark, d, "pages").select("page_id", path.alias("path")).where(T.is_configuration(F.col("path")))


@query("SELECT 'm' || p_partkey AS id, 'n' || p_size AS name, CASE WHEN p_size % 2 = 0 THEN 'q' || p_size ELSE 'n' || p_size END AS qualified_name, '' AS documentation, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'java' END AS language FROM part")
def node_projection(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    nodes = L.table(spark, d, "part").select(F.concat(F.lit("m"), key).alias("id"), F.concat(F.lit("n"), size.cast("string")).alias("name"), F.when(size % 2 == 0, F.concat(F.lit("q"), size.cast("string"))).alias("qualified_name"), F.when(size % 3 != 0, "java").alias("language"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    return filters.project(nodes).select("id", "name", "qualified_name", "documentation", "language")


# --- methods in a chain ---------------------------------------------------------------------------------------------

#: Methods of 20 files, each ten lines after the one before; every third has a test of its own.
METHODS = """methods AS (SELECT 'm' || p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'FUNCTION' ELSE 'METHOD' END AS type, 'do' || p_partkey AS name, 'p.do' || p_partkey AS qualified_name, 'src/f' || (p_partkey % 20) || '.java' AS file_path,
  (10 * (p_partkey // 20) + 1)::integer AS start_line, (10 * (p_partkey // 20) + 9)::integer AS end_line, 'void do' || p_partkey AS first_line, 'alpha' || p_size || ' beta' || (p_partkey % 7) AS source_code FROM part
  UNION ALL SELECT 't' || p_partkey, 'METHOD', 'do' || p_partkey || 'Test', 'p.do' || p_partkey || 'Test', 'src/test/T' || p_partkey || '.java', 1, 9, 'void test', 'check' FROM part WHERE p_partkey % 3 = 1),
chain AS (SELECT 'm' || a.p_partkey AS source, 'm' || b.p_partkey AS target FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"""
_PLACE = ("f7.java", 34, "m67")


def methods(spark: SparkSession, d: str) -> DataFrame:
    part = L.table(spark, d, "part")
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    line = F.floor(k / 20).cast("int") * 10
    values = {
        "id": F.concat(F.lit("m"), key), "type": F.when(k % 5 == 0, "FUNCTION").otherwise("METHOD"), "name": F.concat(F.lit("do"), key), "qualified_name": F.concat(F.lit("p.do"), key), "file_path": F.concat(F.lit("src/f"), (k % 20).cast("string"), F.lit(".java")),
        "start_line": line + 1, "end_line": line + 9, "first_line": F.concat(F.lit("void do"), key), "source_code": F.concat(F.lit("alpha"), F.col("p_size").cast("string"), F.lit(" beta"), (k % 7).cast("string")), "repo_name": F.lit("parts"),
    }
    name = F.concat(F.lit("do"), key, F.lit("Test"))
    tests = {"id": F.concat(F.lit("t"), key), "type": F.lit("METHOD"), "name": name, "qualified_name": F.concat(F.lit("p."), name), "file_path": F.concat(F.lit("src/test/T"), key, F.lit(".java")), "start_line": F.lit(1), "end_line": F.lit(9), "first_line": F.lit("void test"), "source_code": F.lit("check"), "repo_name": F.lit("parts")}
    return part.select(*[v.alias(c) for c, v in values.items()]).unionAll(part.where(k % 3 == 1).select(*[v.alias(c) for c, v in tests.items()]))


def chain(spark: SparkSession, d: str) -> DataFrame:
    part = L.table(spark, d, "part").select("p_partkey")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("next"))
    name = lambda c: F.concat(F.lit("m"), F.col(c).cast("string"))
    return part.join(after, "p_partkey").select(name("p_partkey").alias("source"), name("next").alias("target"), F.lit("CALLS").alias("type"), F.lit(0.9).alias("confidence"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, embedding): methods around half a circle."""
    angle = F.col("p_partkey") * 0.003
    return L.table(spark, d, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("id"), F.array(F.cos(angle), F.sin(angle)).alias("embedding"))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("p_size") % 3 == 0, "high").when(F.col("p_size") % 3 == 1, "medium").otherwise("low")
    key = F.col("p_partkey").cast("string")
    return L.table(spark, d, "part").select(F.concat(F.lit("f"), key).alias("id"), F.concat(F.lit("m"), key).alias("node_id"), F.lit("R").alias("rule_id"), level.alias("severity"), F.lit("").alias("message"), F.lit("").alias("file_path"), F.lit(1).alias("line"))


def _incidents(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "events").select(F.concat(F.lit("i"), F.col("event_id").cast("string")).alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("observed_at"), F.lit("").alias("summary"), "event_id")


def _context(spark: SparkSession, d: str, question: str, **where) -> DataFrame:
    incidents = _incidents(spark, d)
    affects = incidents.where("event_id % 10 = 7").select(F.col("id").alias("source"), F.lit(_PLACE[2]).alias("target"))
    found = diagnose.context(methods(spark, d), chain(spark, d), _findings(spark, d), affects, incidents, question, vectors(spark, d), [1.0, 0.0], **where)
    out = found.epicentre.select(F.lit("epicentre").alias("part"), "id")
    for part, df in (("callers", found.callers), ("callees", found.callees), ("findings", found.findings), ("evidence", found.evidence), ("tests", found.tests)):
        out = out.unionAll(df.select(F.lit(part), "id"))
    return out.withColumn("level", F.lit(found.evidence_level))


_AROUND = """SELECT 'callers' AS part, 'm' || (k - i) AS id FROM spot, range(1, 3) r(i) WHERE 'm' || (k - i) IN (SELECT id FROM methods) UNION ALL SELECT 'callees', 'm' || (k + i) FROM spot, range(1, 3) r(i) WHERE 'm' || (k + i) IN (SELECT id FROM methods)
UNION ALL SELECT 'tests', 't' || k FROM spot WHERE k % 3 = 1"""


@query(f"""WITH {METHODS}, spot AS (SELECT 67 AS k), known AS (SELECT 'f' || p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS rank FROM part WHERE p_partkey BETWEEN 67 AND 69),
late AS (SELECT 'i' || event_id AS id FROM events WHERE event_id % 10 = 7 ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S') DESC, 'i' || event_id LIMIT 3)
SELECT part, id, 'exact' AS level FROM (SELECT 'epicentre' AS part, id FROM methods WHERE id = 'm67' UNION ALL {_AROUND} UNION ALL SELECT 'findings', id FROM (SELECT id FROM known ORDER BY rank, id LIMIT 5) UNION ALL SELECT 'evidence', id FROM late)""")
def diagnose_exact(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, "it fails", trace=f"java.lang.IllegalStateException: x\n\tat p.Do.do67({_PLACE[0]}:{_PLACE[1]})")


@query(f"""WITH {METHODS}, spot AS (SELECT min(p_partkey) AS k FROM part) SELECT part, id, 'semantic' AS level FROM (SELECT 'epicentre' AS part, 'm' || k AS id FROM spot UNION ALL {_AROUND})""")
def diagnose_semantic(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, "it is slow")


_QUESTION = "where does alpha3 meet Beta4"


@query(f"""WITH {METHODS}, docs AS (SELECT id, regexp_extract_all(lower(concat_ws(' ', name, qualified_name, file_path, first_line, source_code)), '[\\p{{L}}\\p{{N}}]+') AS terms FROM methods),
c AS (SELECT count(*) AS n, avg(len(terms)) AS a FROM docs), h AS (SELECT id, len(terms) AS len, t, len(list_filter(terms, lambda x: x = t)) AS tf FROM docs, (SELECT unnest(['where', 'does', 'alpha3', 'meet', 'beta4']) AS t) WHERE list_contains(terms, t)),
f AS (SELECT t, count(*) AS df FROM h GROUP BY t), s AS (SELECT id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / a))), 9) AS s FROM h JOIN f USING (t), c GROUP BY id),
lex AS (SELECT id, 0.85::double - 0.05::double * (row_number() OVER (ORDER BY s DESC, id) - 1) AS l FROM s ORDER BY s DESC, id LIMIT 3),
sem AS (SELECT 'm' || p_partkey AS id, cos(p_partkey * 0.003::double) AS c FROM part WHERE cos(p_partkey * 0.003::double) >= 0.30 ORDER BY 2 DESC, 1 LIMIT 3),
seed AS (SELECT id FROM lex UNION SELECT id FROM sem),
near AS (SELECT id, max(x) AS call, 1 AS distance FROM (SELECT target AS id, 0.25::double AS x FROM chain WHERE source IN (SELECT id FROM seed) UNION ALL SELECT source, 0.20::double FROM chain WHERE target IN (SELECT id FROM seed)) WHERE id NOT IN (SELECT id FROM seed) GROUP BY id),
fused AS (SELECT id, greatest(coalesce(c, 0), coalesce(l, 0)) AS score, 0 AS distance FROM seed LEFT JOIN lex USING (id) LEFT JOIN sem USING (id) UNION ALL SELECT id, call, distance FROM near)
SELECT m.id, m.name, round(score, 9) AS score, distance::integer AS distance, (SELECT count(*) FROM chain WHERE target = m.id)::bigint AS callers, (SELECT count(*) FROM chain WHERE source = m.id)::bigint AS callees
FROM fused JOIN methods m USING (id) ORDER BY score DESC, distance, m.id LIMIT 8""")
def retrieve_question(spark: SparkSession, d: str) -> DataFrame:
    nodes = methods(spark, d)
    seeds = R.seeds(nodes, vectors(spark, d), _QUESTION, symbol="nothing of that name", vector=[1.0, 0.0])
    return R.retrieve(nodes, chain(spark, d), *seeds, depth=1, limit=8).select("id", "name", F.round("score", 9).alias("score"), "distance", "callers", "callees")


@query(f"""WITH {METHODS} SELECT e.name AS of, t.id FROM methods e JOIN methods t ON t.name = e.name || 'Test' WHERE e.id = 'm67'""")
def related_tests(spark: SparkSession, d: str) -> DataFrame:
    nodes = methods(spark, d)
    return diagnose.tests(nodes, nodes.where(F.col("id") == _PLACE[2])).select(F.lit("do67").alias("of"), "id")


@query(f"""WITH {METHODS} SELECT m.id, coalesce(string_agg(c.source, ',' ORDER BY c.source), '') AS callers FROM methods m LEFT JOIN chain c ON c.target = m.id GROUP BY m.id""")
def collected_callers(spark: SparkSession, d: str) -> DataFrame:
    return traverse.collected_callers(methods(spark, d), chain(spark, d)).select("id", F.array_join("callers", ",").alias("callers"))


@query(f"""WITH {_NODES} SELECT qualified_name[:length(qualified_name) - length(name) - 1] AS package, count(*)::bigint AS classes, min(name) AS first FROM all_nodes WHERE type = 'CLASS' AND contains(qualified_name, '.') GROUP BY 1""")
def class_packages(spark: SparkSession, d: str) -> DataFrame:
    nodes = records(spark, d, "node").where("record = 'node'").select("id", "type", "name", "qualified_name", "file_path")
    return traverse.classes_by_package(nodes).groupBy("package").agg(F.count("*").alias("classes"), F.min("name").alias("first"))


# --- merges and hints -----------------------------------------------------------------------------------------------


@query("""SELECT 'f' || p_partkey AS id, CASE WHEN p_size % 3 <> 0 AND p_partkey % 4 = 0 THEN 'second' WHEN p_size % 3 <> 0 AND p_partkey % 2 = 0 THEN 'first' ELSE 'old' END AS message, CASE WHEN p_size % 3 <> 0 AND p_partkey % 2 = 0 THEN 'new' ELSE 'was' END AS repo_name FROM part""")
def finding_upsert(spark: SparkSession, d: str) -> DataFrame:
    part = L.table(spark, d, "part")
    base = _findings(spark, d).withColumn("message", F.lit("old")).withColumn("repo_name", F.lit("was"))
    first = _findings(spark, d).where("cast(substring(id, 2) as long) % 2 = 0").withColumns({"message": F.lit("first"), "ordinal": F.lit(1)})
    second = first.where("cast(substring(id, 2) as long) % 4 = 0").withColumns({"message": F.lit("second"), "ordinal": F.lit(2)})
    nodes = part.where("p_size % 3 <> 0").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("id"))
    return upsert.merge_findings(base, second.unionAll(first), nodes, "new").select("id", "message", "repo_name")


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE toxic END::integer AS verdict FROM labels UNION ALL SELECT -doc_id, 1 FROM labels WHERE doc_id % 50 = 1""")
def evaluation_upsert(spark: SparkSession, d: str) -> DataFrame:
    base = L.table(spark, d, "labels").select("doc_id", F.col("toxic").cast("int").alias("verdict"))
    one = base.where("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("verdict"), F.lit(1).alias("ordinal"))
    two = base.where("doc_id % 6 = 0").select("doc_id", F.lit(2).alias("verdict"), F.lit(2).alias("ordinal"))
    new = base.where("doc_id % 50 = 1").select(-F.col("doc_id"), F.lit(1), F.lit(1))
    return upsert.merge_rows(base, two.unionAll(one).unionAll(new), "doc_id")


@query(f"""WITH {L.CALLS} SELECT source, target, type, CASE WHEN source LIKE '%3' THEN 0.1::double ELSE confidence END AS confidence FROM calls""")
def edge_last_wins(spark: SparkSession, d: str) -> DataFrame:
    calls = L.calls(spark, d)
    own = calls.where("source LIKE '%3'")
    delta = own.withColumns({"confidence": F.lit(0.9), "turn": F.lit(1)}).unionAll(own.withColumns({"confidence": F.lit(0.1), "turn": F.lit(2)}))
    return upsert.merge_edges(calls, delta, ["turn"], 2 * L.call_parts(spark, d))


@query("""WITH i AS (SELECT 'inc:' || event_id AS id, 'd' || (user_id % 9) AS deployment, 'v' || (event_id % 3) AS version FROM events)
SELECT 'acme::deployment::' || deployment AS id, 'Deployment' AS label, max(version) AS version, count(*)::bigint AS incidents FROM i GROUP BY deployment""")
def evidence_deployments(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    incidents = L.table(spark, d, "events").select(
        F.concat(F.lit("inc:"), F.col("event_id").cast("string")).alias("id"), F.lit("acme").alias("repo_name"), none.alias("service"), none.alias("route"), F.concat(F.lit("d"), (F.col("user_id") % 9).cast("string")).alias("deployment_id"),
        F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("version"), none.alias("dependency"),
    )
    entities, links = upsert.evidence_entities(incidents)
    counted = links.where("type = 'AT_DEPLOYMENT'").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("incidents"))
    return entities.select("id", "label", "version").join(counted, "id")


@query(f"""WITH {L.SPANS}, paths AS (SELECT id, 'src/main/' || file_path || '.java' AS file_path, start_line, end_line FROM spans),
probes AS (SELECT c_custkey AS probe, CASE WHEN c_custkey % 2 = 0 THEN 'main/c' || c_custkey || '.java' ELSE c_custkey || '.java' END AS hint, {L.PROBE} AS line FROM customer),
ranked AS (SELECT probe, id, CASE WHEN end_line >= line AND end_line > start_line THEN end_line - start_line ELSE 999999 END::integer AS span,
  row_number() OVER (PARTITION BY probe ORDER BY CASE WHEN end_line >= line AND end_line > start_line THEN end_line - start_line ELSE 999999 END, start_line DESC, id)::integer AS rank FROM probes JOIN paths ON contains(file_path, hint) AND start_line <= line)
SELECT * FROM ranked WHERE rank <= 3""")
def hint_lookup(spark: SparkSession, d: str) -> DataFrame:
    nodes = L.spans(spark, d).withColumn("file_path", F.concat(F.lit("src/main/"), "file_path", F.lit(".java")))
    key = F.col("c_custkey").cast("string")
    hint = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("main/c"), key, F.lit(".java"))).otherwise(F.concat(key, F.lit(".java")))
    probes = L.table(spark, d, "customer").select(F.col("c_custkey").alias("probe"), hint.alias("file_hint"), F.expr("cast(9000 + (c_custkey * 37) % 1500 AS int)").alias("line"))
    return intervals.at_line(nodes, probes).select("probe", "id", "span", "rank")
