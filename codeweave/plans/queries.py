"""Queries over the driver's tables, one for each operator, with their SQL.

`@query(sql)` registers a function under its name; the SQL is DuckDB's form of the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import traces as X
from ..operators import filters, fusion, intervals, ranking, resolve, search, stats, traverse, upsert
from ..operators.fields import FieldIndex
from ..operators.vector_index import VectorIndex, scoped_search
from ..sources import scan
from ..sources.places import shared_folder
from . import lenses as L
from . import retrieve as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- lookups and gates ----------------------------------------------------------------------------------------------


@query(f"WITH {L.NODES} SELECT id, type, name, file_path, repo_name FROM nodes WHERE name = (SELECT min(p_name) FROM part) AND repo_name = 'parts'")
def point_lookup_name(spark: SparkSession, d: str) -> DataFrame:
    name = L.table(spark, d, "part").agg(F.min("p_name")).first()[0]
    return filters.by_name(L.nodes(spark, d), name, "parts")


@query(f"WITH {L.NODES} SELECT id, name FROM nodes WHERE file_path = 'Brand#13' UNION ALL SELECT id, name FROM nodes WHERE file_path = 'FRANCE'")
def nodes_in_file(spark: SparkSession, d: str) -> DataFrame:
    nodes = L.nodes(spark, d)
    return filters.in_file(nodes, "Brand#13").unionAll(filters.in_file(nodes, "FRANCE")).select("id", "name")


@query(f"WITH {L.NODES} SELECT id, name, repo_name FROM nodes WHERE type = 'CLASS' AND repo_name = (SELECT min(r_name) FROM region)")
def nodes_by_type(spark: SparkSession, d: str) -> DataFrame:
    repo = L.table(spark, d, "region").agg(F.min("r_name")).first()[0]
    return filters.by_type(L.nodes(spark, d), "CLASS", repo).select("id", "name", "repo_name")


@query(f"WITH {L.NODES} SELECT id, file_path FROM nodes WHERE contains(file_path, 'A1') OR contains(file_path, '#2')")
def path_contains(spark: SparkSession, d: str) -> DataFrame:
    nodes = L.nodes(spark, d)
    return filters.path_contains(nodes, "A1").unionAll(filters.path_contains(nodes, "#2")).select("id", "file_path").distinct()


@query(f"""WITH {L.NODES}, {L.EDGES}
SELECT 'low' AS level, 'node' AS kind, type, count(*)::bigint AS n FROM nodes WHERE type = 'FILE' GROUP BY type
UNION ALL SELECT 'med', 'node', type, count(*)::bigint FROM nodes WHERE type IN ('FILE', 'CLASS', 'INTERFACE') GROUP BY type
UNION ALL SELECT 'high', 'node', type, count(*)::bigint FROM nodes GROUP BY type
UNION ALL SELECT 'med', 'edge', type, count(*)::bigint FROM edges WHERE type = 'CONTAINS' GROUP BY type
UNION ALL SELECT 'high', 'edge', type, count(*)::bigint FROM edges GROUP BY type
UNION ALL SELECT 'med', 'embed', type, count(*)::bigint FROM nodes WHERE type IN ('CLASS', 'INTERFACE') GROUP BY type
UNION ALL SELECT 'high', 'embed', type, count(*)::bigint FROM nodes WHERE type <> 'FILE' GROUP BY type""")
def level_filter(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, out = L.nodes(spark, d), L.edges(spark, d), None
    for level in ("low", "med", "high"):
        for kind, df in (("node", filters.level_nodes(nodes, level)), ("edge", filters.level_edges(edges, level)), ("embed", filters.level_embeds(nodes, level))):
            part = df.groupBy("type").count().select(F.lit(level).alias("level"), F.lit(kind).alias("kind"), "type", F.col("count").alias("n"))
            out = part if out is None else out.unionAll(part)
    return out


@query(f"WITH {L.CALLS} SELECT source, target, confidence FROM calls WHERE confidence >= 0.5")
def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    return filters.confident(L.calls(spark, d)).select("source", "target", "confidence")


@query(f"WITH {L.NODES} SELECT type, count(*)::bigint AS n FROM nodes WHERE type IN ('METHOD', 'FUNCTION') GROUP BY type")
def result_types(spark: SparkSession, d: str) -> DataFrame:
    nodes = L.nodes(spark, d)
    return filters.results(nodes).unionAll(filters.results(nodes, "CLASS")).groupBy("type").agg(F.count("*").alias("n"))


# --- resolution -----------------------------------------------------------------------------------------------------


@query(f"""WITH {L.NODES}, {L.EDGES}, kept AS (SELECT * FROM nodes WHERE type <> 'INTERFACE' AND id NOT LIKE '%7')
SELECT source, target, type, confidence FROM edges WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)""")
def structural_edges(spark: SparkSession, d: str) -> DataFrame:
    kept = L.nodes(spark, d).where("type <> 'INTERFACE' AND NOT endswith(id, '7')")
    return resolve.structural_edges(L.edges(spark, d).withColumn("resolution", F.lit(None).cast("string")), kept).select("source", "target", "type", "confidence")


_REFS = """refs AS (
  SELECT DISTINCT 'order:' || l_orderkey AS source, p_name AS target_name, p_brand AS file_path, 'parts' AS repo_name FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION SELECT DISTINCT 'order:' || l_orderkey, s_name, 'x', 'suppliers' FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
callables AS (SELECT 'part:' || p_partkey AS id, p_name AS name, p_brand AS file_path, 'parts' AS repo_name FROM part
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 's', 'suppliers' FROM supplier),
one_ref AS (SELECT source, target_name, repo_name, min(file_path) AS file_path FROM refs GROUP BY ALL)"""


@query(f"""WITH {_REFS}, ranked AS (
  SELECT source, c.id AS target, count(*) OVER w AS n, count(*) FILTER (c.file_path = r.file_path) OVER w AS own, c.file_path = r.file_path AS same, row_number() OVER (PARTITION BY source, target_name, r.repo_name ORDER BY c.id) AS rank
  FROM one_ref r JOIN callables c ON c.name = target_name AND c.repo_name = r.repo_name WINDOW w AS (PARTITION BY source, target_name, r.repo_name))
SELECT DISTINCT source, target, 0.6::double AS confidence FROM ranked WHERE n = 1 OR same OR (own = 0 AND rank <= 3)""")
def resolve_calls_by_name(spark: SparkSession, d: str) -> DataFrame:
    items = L.table(spark, d, "lineitem")
    part, supplier = L.table(spark, d, "part"), L.table(spark, d, "supplier")
    n, key = L.call_parts(spark, d), ["l_orderkey", "target_name"]
    # Dealt first: an order hardly repeats a name. Orders are in no supplier's file.
    made = items.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("p_name").alias("target_name"), F.col("p_brand").alias("file_path"))
    made = made.repartition(n, *key).groupBy(*key).agg(F.min("file_path").alias("file_path")).withColumn("repo_name", F.lit("parts"))
    sold = items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_name").alias("target_name"))
    sold = sold.repartition(n, *key).distinct().withColumns({"file_path": F.lit("x"), "repo_name": F.lit("suppliers")})
    refs = made.unionAll(sold).select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("source"), "target_name", "repo_name", "file_path", F.lit(0.6).alias("confidence"))
    nodes = part.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("FUNCTION").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.lit("parts").alias("repo_name"))
    nodes = nodes.unionAll(supplier.select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")), F.lit("METHOD"), F.col("s_name"), F.lit("s"), F.lit("suppliers")))
    return resolve.resolve_calls(refs, nodes, unique=True, parts=n).select("source", "target", "confidence")


@query("""WITH named AS (SELECT 'customer:' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'part:' || p_partkey, p_name FROM part),
refs AS (SELECT DISTINCT 'order:' || o_orderkey AS source, c_name AS target_name FROM orders JOIN customer ON o_custkey = c_custkey
  UNION SELECT DISTINCT 'order:' || l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey),
single AS (SELECT name, min(id) AS target FROM named GROUP BY name HAVING count(*) = 1)
SELECT DISTINCT source, target, 'EXTENDS' AS type FROM refs JOIN single ON name = target_name""")
def resolve_unique_names(spark: SparkSession, d: str) -> DataFrame:
    customer, part = L.table(spark, d, "customer"), L.table(spark, d, "part")
    nodes = customer.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.lit("CLASS").alias("type"), F.lit("r").alias("repo_name"))
    nodes = nodes.unionAll(part.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")), F.col("p_name"), F.lit("INTERFACE"), F.lit("r")))
    refs = L.table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("source"), F.col("c_name").alias("target_name"))
    refs = refs.unionAll(L.table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")), "p_name"))
    return resolve.resolve_unique(refs.withColumns({"type": F.lit("EXTENDS"), "repo_name": F.lit("r")}), nodes).select("source", "target", "type")


@query(f"""WITH {L.EDGES} SELECT 'r::' || source AS source, CASE WHEN type = 'CONTAINS' THEN 'r::' ELSE '' END || target AS target FROM edges""")
def globalise_ids(spark: SparkSession, d: str) -> DataFrame:
    return resolve.globalise(L.edges(spark, d), "r").select("source", "target")


@query("""SELECT 'part:' || l_partkey AS source, l_orderkey || '/' || l_linenumber || '/' || l_suppkey AS target FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 10""")
def link_findings(spark: SparkSession, d: str) -> DataFrame:
    items = L.table(spark, d, "lineitem")
    findings = items.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")).alias("id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("node_id"))
    nodes = L.table(spark, d, "part").where("p_size <= 10").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))
    return resolve.link_findings(findings, nodes).select("source", "target")


@query("""SELECT DISTINCT 'order:' || l_orderkey AS source, 'part:' || l_partkey AS target FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 10""")
def link_evidence(spark: SparkSession, d: str) -> DataFrame:
    items = L.table(spark, d, "lineitem").select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("p"))
    incidents = items.groupBy("id").agg(F.collect_list("p").alias("linked_ids"))
    nodes = L.table(spark, d, "part").where("p_size <= 10").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))
    return resolve.link_evidence(incidents, nodes).select("source", "target")


# --- intervals ------------------------------------------------------------------------------------------------------

_AT_LINE = f"""{L.SPANS}, {L.PROBES}, ranked AS (
  SELECT probe, id, CASE WHEN end_line >= line AND end_line > start_line THEN end_line - start_line ELSE 999999 END::integer AS span, start_line,
    row_number() OVER (PARTITION BY probe ORDER BY CASE WHEN end_line >= line AND end_line > start_line THEN end_line - start_line ELSE 999999 END, start_line DESC, id)::integer AS rank
  FROM probes JOIN spans USING (file_path) WHERE start_line <= line)"""


@query(f"WITH {_AT_LINE} SELECT probe, id, span, rank FROM ranked WHERE rank <= 3")
def interval_lookup_top3(spark: SparkSession, d: str) -> DataFrame:
    return intervals.at_line(L.spans(spark, d), L.probes(spark, d), on=["file_path"]).select("probe", "id", "span", "rank")


@query(f"WITH {_AT_LINE} SELECT p.probe, p.line, r.id, r.id IS NOT NULL AS found FROM probes p LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r ON p.probe = r.probe")
def batch_interval_lookup(spark: SparkSession, d: str) -> DataFrame:
    return intervals.batch_lookup(L.spans(spark, d), L.probes(spark, d), on=["file_path"]).select("probe", "line", "id", "found")


# --- traversal ------------------------------------------------------------------------------------------------------


def _walk_sql(edges: str, start: str, hops: int, inbound: bool = False, name: str = "w") -> str:
    a, b = ("target", "source") if inbound else ("source", "target")
    levels = [f"{name}1 AS (SELECT DISTINCT {b} AS id FROM {edges} WHERE {a} IN ({start}))"]
    levels += [f"{name}{i} AS (SELECT DISTINCT {b} AS id FROM {edges} WHERE {a} IN (SELECT id FROM {name}{i - 1}))" for i in range(2, hops + 1)]
    union = " UNION ALL ".join(f"SELECT id, {i} AS distance FROM {name}{i}" for i in range(1, hops + 1))
    return ", ".join(levels) + f", {name} AS (SELECT id, min(distance)::integer AS distance FROM ({union}) GROUP BY id)"


_SEEDS = "SELECT 'user:' || user_id FROM (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 2)"


def _seed_users(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "events").select("user_id").distinct().orderBy("user_id").limit(2).select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id"))


def _calls_graph_sql(inbound: bool) -> str:
    return f"""WITH {L.USERS}, sure AS (SELECT * FROM user_calls WHERE confidence >= 0.5), {_walk_sql("sure", _SEEDS, 3, inbound)}
SELECT id, distance FROM w WHERE id NOT IN ({_SEEDS})"""


@query(_calls_graph_sql(False))
def calls_graph_callee(spark: SparkSession, d: str) -> DataFrame:
    return traverse.calls_graph(L.user_nodes(spark, d), L.adjacent(spark, d, L.user_calls), _seed_users(spark, d), 3).where("direction = 'callee'").select("id", "distance")


@query(_calls_graph_sql(True))
def calls_graph_caller(spark: SparkSession, d: str) -> DataFrame:
    return traverse.calls_graph(L.user_nodes(spark, d), L.adjacent(spark, d, L.user_calls), _seed_users(spark, d), 3).where("direction = 'caller'").select("id", "distance")


def _user_related(inbound: bool) -> str:
    return f"""WITH {L.USERS}, {_walk_sql("user_calls", "SELECT min(id) FROM user_nodes", 2, inbound)} SELECT id, distance FROM w"""


@query(_user_related(True))
def callers_2hop(spark: SparkSession, d: str) -> DataFrame:
    nodes = L.user_nodes(spark, d)
    return traverse.callers(nodes, L.adjacent(spark, d, L.user_calls), nodes.agg(F.min("id")).first()[0], 2).select("id", "distance")


@query(_user_related(False))
def callees_2hop(spark: SparkSession, d: str) -> DataFrame:
    nodes = L.user_nodes(spark, d)
    return traverse.callees(nodes, L.adjacent(spark, d, L.user_calls), nodes.agg(F.min("id")).first()[0], 2).select("id", "distance")


@query(f"""WITH {L.NODES}, {L.EDGES}, {_walk_sql("edges", "SELECT id FROM nodes WHERE id = 'region:1'", 3)} SELECT w.id, distance, type FROM w JOIN nodes USING (id)""")
def bfs_neighbors(spark: SparkSession, d: str) -> DataFrame:
    nodes = L.kept(spark, d, L.nodes)
    return traverse.neighbours(nodes, L.kept(spark, d, L.edges), nodes.where("id = 'region:1'"), 5).select("id", "distance", "type")


@query(f"""WITH {L.NODES}, {L.CALLS}, into_ AS (SELECT target AS id, count(DISTINCT source) AS n FROM calls GROUP BY 1), out_ AS (SELECT source AS id, count(DISTINCT target) AS n FROM calls GROUP BY 1)
SELECT id, coalesce(i.n, 0)::bigint AS callers, coalesce(o.n, 0)::bigint AS callees FROM nodes LEFT JOIN into_ i USING (id) LEFT JOIN out_ o USING (id) WHERE type IN ('FUNCTION', 'CLASS')""")
def call_counts(spark: SparkSession, d: str) -> DataFrame:
    nodes = L.nodes(spark, d)
    return traverse.call_counts(nodes, L.calls(spark, d), nodes.where("type IN ('FUNCTION', 'CLASS')"), L.call_parts(spark, d))


@query(f"""WITH {L.CONTAINS}, p1 AS (SELECT target AS id, source || '>' || target AS path, 1 AS hops FROM contains_ WHERE source LIKE 'region:%'),
p2 AS (SELECT target AS id, path || '>' || target AS path, 2 AS hops FROM p1 JOIN contains_ ON source = id)
SELECT * FROM p1 UNION ALL SELECT * FROM p2""")
def hierarchy_paths(spark: SparkSession, d: str) -> DataFrame:
    seeds = L.table(spark, d, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id"))
    return traverse.paths(L.contains(spark, d), seeds, ["CONTAINS"], 2).select("id", F.array_join("path", ">").alias("path"), "hops")


@query(f"""WITH {L.USERS}, s AS (SELECT min(id) AS id FROM user_nodes),
p1 AS (SELECT target AS id, source || '>' || target AS path FROM user_calls, s WHERE source = s.id),
p2 AS (SELECT target AS id, path || '>' || target AS path FROM p1 JOIN user_calls ON source = p1.id WHERE path <> source || '>' || target)
SELECT id, path, 1 AS hops FROM p1 UNION ALL SELECT id, path, 2 FROM p2""")
def call_paths(spark: SparkSession, d: str) -> DataFrame:
    seed = L.user_nodes(spark, d).agg(F.min("id").alias("id"))
    return traverse.paths(L.user_calls(spark, d), seed, ["CALLS"], 2).select("id", F.array_join("path", ">").alias("path"), "hops")


_CHAIN = [f"c{i} AS (SELECT target AS id, path || '>' || target AS path, list_append(used, source || '>' || target) AS used FROM c{i - 1} JOIN user_calls ON source = c{i - 1}.id WHERE NOT list_contains(used, source || '>' || target))" for i in (2, 3, 4)]


@query(f"""WITH {L.USERS}, c1 AS (SELECT target AS id, source || '>' || target AS path, [source || '>' || target] AS used FROM user_calls WHERE source = (SELECT min(id) FROM user_nodes)), {", ".join(_CHAIN)},
found AS ({" UNION ALL ".join(f"SELECT id, path, {i} AS hops FROM c{i}" for i in (1, 2, 3, 4))})
SELECT * FROM found WHERE id IN (SELECT 'user:' || user_id FROM events WHERE event_type = 'signup')""")
def call_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains of 1 to 4 calls from a user to those who have signed up."""
    seed = L.user_nodes(spark, d).agg(F.min("id").alias("id"))
    ends = L.table(spark, d, "events").where("event_type = 'signup'").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id"))
    return traverse.paths(L.adjacent(spark, d, L.user_calls), seed, ["CALLS"], 4, ends).select("id", F.array_join("path", ">").alias("path"), "hops")


# --- aggregates -----------------------------------------------------------------------------------------------------


@query(f"""WITH {L.NODES}, c AS (SELECT repo_name, type, count(*) AS n FROM nodes GROUP BY ALL)
SELECT repo_name, sum(n)::bigint AS total, string_agg(type || '=' || n, ',' ORDER BY n DESC, type) AS by_type FROM c GROUP BY repo_name""")
def repo_stats(spark: SparkSession, d: str) -> DataFrame:
    found = stats.repo_stats(L.nodes(spark, d).withColumn("repo_path", F.lit("")))
    return found.select("repo_name", "total", F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("by_type"))


@query(f"WITH {L.EDGES} SELECT count(*)::bigint AS edges FROM edges")
def edge_total(spark: SparkSession, d: str) -> DataFrame:
    return stats.edge_total(L.edges(spark, d))


_METRICS = """count(*)::bigint AS total, round(coalesce(count(*) FILTER (quality = 1 AND toxic = 0) / nullif(count(*) FILTER (quality = 1), 0)::double, 0), 9) AS precision,
  round(coalesce(avg(quality)::double, 0), 9) AS recall, round(coalesce(count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (quality = 1), 0)::double, 0), 9) AS unsupported_claim_rate,
  round(coalesce(avg(n_chars)::double, 0), 6) AS avg_latency_ms, round(coalesce(avg(n_chars * 0.5::double), 0), 6) AS avg_cost_usd
FROM labels JOIN documents USING (doc_id)"""


@query(f"""SELECT source, {_METRICS} WHERE source = 'src1' GROUP BY source
UNION ALL SELECT NULL::varchar AS source, {_METRICS}""")
def evaluation_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = L.table(spark, d, "labels").join(L.table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    evaluations = rows.select(F.col("source").alias("repo_name"), good.alias("made_causal_claim"), (~toxic).alias("resolved_correctly"), good.alias("expected_cause_identified"), (~toxic).alias("supported_by_evidence"), F.col("n_chars").cast("double").alias("latency_ms"), (F.col("n_chars") * 0.5).alias("cost_usd"))
    # One source, and all rows (source is null).
    one = stats.evaluation_metrics(evaluations, "src1").withColumn("source", F.lit("src1"))
    m = one.unionAll(stats.evaluation_metrics(evaluations).withColumn("source", F.lit(None).cast("string")))
    return m.select("source", "total", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "unsupported_claim_rate")], *[F.round(c, 6).alias(c) for c in ("avg_latency_ms", "avg_cost_usd")])


@query(f"WITH {L.NODES} SELECT CASE WHEN count(DISTINCT repo_name) = 1 THEN min(repo_name) ELSE count(DISTINCT repo_name) || ' repos' END AS label FROM nodes")
def repo_label(spark: SparkSession, d: str) -> DataFrame:
    return stats.repo_label(L.nodes(spark, d))


@query(f"WITH {L.NODES}, {L.EDGES} SELECT (SELECT count(*) FROM nodes WHERE type = 'FILE')::bigint AS files_scanned, (SELECT count(*) FROM nodes)::bigint AS nodes_found, (SELECT count(*) FROM edges)::bigint AS edges_found, 0::bigint AS findings_found")
def index_summary(spark: SparkSession, d: str) -> DataFrame:
    nodes = L.nodes(spark, d)
    return stats.index_summary(nodes.where("type = 'FILE'"), nodes, L.edges(spark, d))


@query("""SELECT conv_id, turn, role, round((CASE role WHEN 'user' THEN length(text) * 0.8::double WHEN 'assistant' THEN length(text) * 4.0::double ELSE 0 END) / 1000000, 9) AS cost FROM conversations""")
def llm_cost(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    usage = L.table(spark, d, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "system", "unknown").otherwise("m").alias("model"), F.when(F.col("role") == "user", n).otherwise(0).alias("input_tokens"), F.when(F.col("role") == "assistant", n).otherwise(0).alias("output_tokens"))
    rates = spark.createDataFrame([("m", "input", 0.8), ("m", "output", 4.0)], "model string, kind string, per_million double")
    return stats.llm_cost(usage, rates).select("conv_id", "turn", "role", F.round("cost", 9).alias("cost"))


# --- orders and caps ------------------------------------------------------------------------------------------------


@query("""SELECT 'order:' || o_orderkey AS id, o_orderpriority FROM orders ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 2 END, 1 LIMIT 5""")
def severity_topk(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "medium").otherwise("low")
    rows = L.table(spark, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), "o_orderpriority", level.alias("severity"))
    return ranking.by_severity(rows, 5).select("id", "o_orderpriority")


@query("""SELECT event_id, observed_at FROM (SELECT event_id, CASE WHEN event_id % 997 = 5 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS observed_at FROM events) ORDER BY observed_at DESC NULLS FIRST, event_id LIMIT 3""")
def latest_evidence(spark: SparkSession, d: str) -> DataFrame:
    at = F.when(F.col("event_id") % 997 == 5, F.lit(None)).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return ranking.latest(L.table(spark, d, "events").select("event_id", at.alias("observed_at")), 3, "observed_at", "event_id")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def dedup_best(spark: SparkSession, d: str) -> DataFrame:
    rows = L.table(spark, d, "documents").select("doc_id", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("key"))
    return ranking.first_of(rows, ["key"], [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "source")


@query("""SELECT doc_id, array_to_string(list_filter(list_slice(string_split(text, e'\\n'), 1, 2), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> ''), '|') AS preview FROM documents""")
def line_caps(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "documents").select("doc_id", F.array_join(ranking.first_lines(F.col("text"), 2), "|").alias("preview"))


@query("""SELECT c_mktsegment AS file_path, min(c_custkey)::bigint AS first_rank, string_agg(c_name, ',' ORDER BY c_custkey) AS members FROM customer GROUP BY c_mktsegment""")
def group_by_file(spark: SparkSession, d: str) -> DataFrame:
    rows = L.table(spark, d, "customer").select(F.col("c_mktsegment").alias("file_path"), F.col("c_custkey").alias("rank"), F.col("c_name").alias("id"))
    return ranking.by_file(rows).select("file_path", "first_rank", F.array_join(F.transform("members", lambda m: m["id"]), ",").alias("members"))


# --- merges ---------------------------------------------------------------------------------------------------------


@query("""WITH delta AS (SELECT o_orderkey AS id, 1 AS batch, 'X' AS status, NULL::varchar AS priority FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 2, CASE WHEN o_orderkey % 2 = 0 THEN 'Y' END, 'late' FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT -o_orderkey, 1, 'N', 'new' FROM orders WHERE o_orderkey % 100 = 0),
last AS (SELECT id, max_by(status, batch) FILTER (status IS NOT NULL) AS status, max_by(priority, batch) FILTER (priority IS NOT NULL) AS priority FROM delta GROUP BY id)
SELECT coalesce(l.id, o_orderkey) AS id, coalesce(l.status, o_orderstatus) AS status, coalesce(l.priority, o_orderpriority) AS priority, o_totalprice AS price FROM orders FULL JOIN last l ON l.id = o_orderkey""")
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    orders = L.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    none = F.lit(None).cast("string")
    one = orders.where("id % 3 = 0").select("id", F.lit(1).alias("batch"), F.lit("X").alias("status"), none.alias("priority"))
    two = orders.where("id % 9 = 0").select("id", F.lit(2), F.when(F.col("id") % 2 == 0, "Y"), F.lit("late"))
    new = orders.where("id % 100 = 0").select(-F.col("id"), F.lit(1), F.lit("N"), F.lit("new"))
    return upsert.merge_nodes(orders, one.unionAll(two).unionAll(new), ["batch"])


@query(f"""WITH {L.CALLS}, delta AS (SELECT source, target, type, 0.99::double AS confidence FROM calls WHERE source LIKE 'part:%5' UNION ALL SELECT 'part:new', target, 'CALLS', 0.1::double FROM calls WHERE source = 'part:15')
SELECT source, target, type, confidence FROM calls WHERE NOT source LIKE 'part:%5' UNION ALL SELECT DISTINCT * FROM delta""")
def edge_merge(spark: SparkSession, d: str) -> DataFrame:
    calls = L.calls(spark, d)
    delta = calls.where("source LIKE 'part:%5'").withColumn("confidence", F.lit(0.99)).unionAll(calls.where("source = 'part:15'").select(F.lit("part:new"), "target", "type", F.lit(0.1)))
    return upsert.merge_edges(calls, delta, partitions=2 * L.call_parts(spark, d))


@query(f"""WITH {L.NODES}, {L.CONTAINS}, gone AS (SELECT id FROM nodes WHERE repo_name = 'ASIA')
SELECT 'nodes' AS part, count(*)::bigint AS n FROM nodes WHERE repo_name <> 'ASIA' UNION ALL SELECT 'edges', count(*)::bigint FROM contains_ WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)""")
def clear_repo(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = upsert.clear_repo(L.nodes(spark, d), L.contains(spark, d), "ASIA")
    return nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("part"), "n").unionAll(edges.agg(F.count("*").alias("n")).select(F.lit("edges"), "n"))


@query("""SELECT vec_id AS id, vec_id % 7 = 0 AND label < 5 AS replaced FROM embeddings""")
def embedding_update(spark: SparkSession, d: str) -> DataFrame:
    e = L.table(spark, d, "embeddings")
    base = e.select(F.col("vec_id").alias("id"), "embedding")
    delta = base.where("id % 7 = 0").select("id", F.array(F.lit(9.0).cast("float")).alias("embedding")).unionAll(spark.createDataFrame([(-1, [1.0])], "id long, embedding array<float>"))
    done = upsert.set_embeddings(base, delta, e.where("label < 5").select(F.col("vec_id").alias("id")))
    return done.select("id", (F.size("embedding") == 1).alias("replaced"))


_INCIDENTS = """incidents AS (SELECT 'inc:' || event_id AS id, 'acme' AS repo, CASE WHEN user_id % 4 <> 0 THEN 'svc' || user_id END AS service, 'r' || regexp_extract(props, '[0-9]+') AS route, CASE WHEN event_type <> 'click' THEN event_type END AS dependency FROM events)"""


@query(f"""WITH {_INCIDENTS}, links AS (
  SELECT id AS source, repo || '::service::' || service AS target, 'OBSERVED_IN' AS type FROM incidents WHERE service IS NOT NULL
  UNION ALL SELECT id, coalesce(repo || '::service::' || service, '') || '::route::' || route, 'ON_ROUTE' FROM incidents WHERE route IS NOT NULL
  UNION ALL SELECT id, repo || '::dependency::' || dependency, 'DEPENDS_ON' FROM incidents WHERE dependency IS NOT NULL)
SELECT target AS id, type, count(*)::bigint AS incidents FROM links GROUP BY ALL""")
def evidence_entities(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    incidents = L.table(spark, d, "events").select(
        F.concat(F.lit("inc:"), F.col("event_id").cast("string")).alias("id"), F.lit("acme").alias("repo_name"), F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("svc"), F.col("user_id").cast("string"))).alias("service"),
        F.concat(F.lit("r"), F.regexp_extract("props", "[0-9]+", 0)).alias("route"), none.alias("deployment_id"), none.alias("version"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("dependency"),
    )
    entities, links = upsert.evidence_entities(incidents)
    return entities.select(F.col("id").alias("target")).join(links, "target").groupBy(F.col("target").alias("id"), "type").agg(F.count("*").alias("incidents"))


# --- search ---------------------------------------------------------------------------------------------------------

_COSINE = "SELECT vec_id AS id, list_cosine_similarity(embedding::double[], (SELECT embedding::double[] FROM embeddings WHERE vec_id = 0)) AS s, label FROM embeddings"


def _vector(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    e = L.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", "label"), [float(x) for x in e.where("vec_id = 0").first()["embedding"]]


@query(f"SELECT id, round(s, 6) AS score FROM ({_COSINE}) WHERE s >= 0.30 ORDER BY s DESC, id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows, q = _vector(spark, d)
    return search.vector_search(rows, q, k=10).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, round(s, 6) AS score FROM ({_COSINE}) WHERE s >= 0.05 AND label = 3")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows, q = _vector(spark, d)
    return search.vector_search(rows, q, 0.05, ids=rows.where("label = 3")).select("id", F.round("score", 6).alias("score"))


#: Cells of the index of a folder's vectors, and pieces of its codes.
_CELLS, _PIECES = 16, 16


def _vector_index(spark: SparkSession, d: str) -> tuple[VectorIndex, DataFrame, list[float]]:
    rows, q = _vector(spark, d)
    return VectorIndex.build(rows, shared_folder(spark, "vectors"), _CELLS, _PIECES), rows, q


@query(f"SELECT id, round(s, 6) AS score FROM ({_COSINE}) WHERE s >= 0.05 ORDER BY s DESC, id LIMIT 10")
def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """From the index, all cells probed and all that is read scored exactly: the exact top."""
    index, _, q = _vector_index(spark, d)
    return scoped_search(index, q, 10, threshold=0.05, probes=_CELLS, refine=None).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, round(s, 6) AS score FROM (SELECT * FROM ({_COSINE}) ORDER BY s DESC, id LIMIT 100) WHERE s >= 0.05 AND label = 3")
def vector_index_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Within one repository (a label): of the hundred nearest of all, those that are in it."""
    index, rows, q = _vector_index(spark, d)
    return scoped_search(index, q, 10, rows.where("label = 3"), 0.05, _CELLS, None).select("id", F.round("score", 6).alias("score"))


_TERMS = ["the", "ouwhea", "thonre"]


@query("""WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS terms FROM documents), c AS (SELECT count(*) AS n, avg(len(terms)) AS a FROM t),
p AS (SELECT id, len(terms) AS len, unnest(terms) AS term FROM t), h AS (SELECT id, len, term, count(*) AS tf FROM p WHERE term IN ('the', 'ouwhea', 'thonre') GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / a))), 6) AS score
FROM h JOIN f USING (term), c GROUP BY id ORDER BY round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / a))), 9) DESC, id LIMIT 20""")
def fulltext_bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(L.table(spark, d, "documents"), "doc_id", F.col("text"), _TERMS, 20).select("id", F.round("score", 6).alias("score"))


_FIELDS = {"name": 2.0, "file_path": 1.5, "first_line": 1.0, "documentation": 0.5, "source_code": 1.0}
_FIELD_TERMS = ["src3", "en", "the", "ouwhea", "thonre"]


@query(f"""WITH d AS (SELECT doc_id AS id, source AS name, 'src/' || lang || '/' || source || '.java' AS file_path, string_split(text, e'\n')[1] AS first_line, coalesce(string_split(text, e'\n')[2], '') AS documentation, text AS source_code FROM documents),
f AS (SELECT id, field, regexp_extract_all(lower(value), '[\\p{{L}}\\p{{N}}]+') AS terms FROM ({" UNION ALL ".join(f"SELECT id, '{f}' AS field, {f} AS value FROM d" for f in _FIELDS)})),
s AS (SELECT field, count(*) AS n, avg(len(terms)) AS a FROM f GROUP BY field), h AS (SELECT id, field, len(terms) AS len, t, len(list_filter(terms, lambda x: x = t)) AS tf FROM f, (SELECT unnest({_FIELD_TERMS}) AS t) WHERE list_contains(terms, t)),
df AS (SELECT field, t, count(*) AS df FROM h GROUP BY field, t),
r AS (SELECT id, round(sum(CASE field {" ".join(f"WHEN '{f}' THEN {w}::double" for f, w in _FIELDS.items())} END * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / a))), 9) AS score FROM h JOIN df USING (field, t) JOIN s USING (field) GROUP BY id)
SELECT id, round(score, 6) AS score FROM r ORDER BY r.score DESC, id LIMIT 20""")
def fulltext_fields(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    path = F.concat(F.lit("src/"), "lang", F.lit("/"), "source", F.lit(".java"))
    docs = L.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), path.alias("file_path"), F.get(lines, F.lit(0)).alias("first_line"), F.get(lines, F.lit(1)).alias("documentation"), F.col("text").alias("source_code"))
    index = FieldIndex.build(docs, shared_folder(spark, "fields"), _FIELDS)
    return index.search(docs, _FIELD_TERMS, 20).select("id", F.round("score", 6).alias("score"))


@query("""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS u, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS a FROM benchmark),
e AS (SELECT item_id, unnest(u) AS term, a FROM t), w AS (SELECT item_id, term, list_position(a, term) AS pos, length(term) + CASE WHEN term[1] <> lower(term[1]) THEN 3 ELSE 0 END AS weight FROM e WHERE length(term) >= 4),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, pos) AS rank FROM w)
SELECT b.item_id, coalesce(string_agg(term, ' OR ' ORDER BY rank), '') AS terms FROM benchmark b LEFT JOIN r ON r.item_id = b.item_id AND rank <= 10 GROUP BY b.item_id""")
def fulltext_query_terms(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "benchmark").select("item_id", search.full_text_query(F.col("text")).alias("terms"))


@query("""SELECT doc_id AS id, term, count(*)::bigint AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY ALL""")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(L.table(spark, d, "documents"), "doc_id", F.col("text")).select("id", "term", "tf")


#: What full-text search looks for among the types of a user's events.
_EVENT_TERMS = ["error", "signup"]
_BEST_USERS = """x AS (SELECT user_id, count(*) AS len FROM events GROUP BY user_id), xc AS (SELECT count(*) AS n, avg(len) AS a FROM x),
xh AS (SELECT user_id, event_type AS term, count(*) AS tf FROM events WHERE event_type IN ('error', 'signup') GROUP BY ALL), xf AS (SELECT term, count(*) AS df FROM xh GROUP BY term),
xs AS (SELECT 'user:' || user_id AS id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / a))), 9) AS s
  FROM xh JOIN x USING (user_id) JOIN xf USING (term), xc GROUP BY 1),
lex AS (SELECT id, 0.85::double - 0.05::double * (row_number() OVER (ORDER BY s DESC, id) - 1) AS l FROM xs ORDER BY s DESC, id LIMIT 3)"""


@query(f"""WITH {L.USERS}, sure AS (SELECT * FROM user_calls WHERE confidence >= 0.5), {_walk_sql("sure", _SEEDS, 2, False, "o")}, {_walk_sql("sure", _SEEDS, 2, True, "i")},
c AS (SELECT id, max(s) AS call, min(distance) AS distance FROM (SELECT id, 0.25::double / distance AS s, distance FROM o UNION ALL SELECT id, 0.20::double / distance, distance FROM i) GROUP BY id),
sem AS (SELECT 'user:' || user_id AS id, max(value) / 200.0::double AS s FROM events WHERE event_type = 'purchase' GROUP BY 1),
{_BEST_USERS},
ids AS (SELECT id FROM c UNION SELECT id FROM sem UNION SELECT id FROM lex UNION SELECT * FROM ({_SEEDS}))
SELECT ids.id, round(CASE WHEN ids.id IN ({_SEEDS}) THEN 1.0::double WHEN greatest(coalesce(s, 0), coalesce(l, 0)) > 0 AND call IS NOT NULL THEN greatest(coalesce(s, 0), coalesce(l, 0)) + 0.10::double
  WHEN greatest(coalesce(s, 0), coalesce(l, 0)) > 0 THEN greatest(coalesce(s, 0), coalesce(l, 0)) ELSE call END, 9) AS score
FROM ids LEFT JOIN c USING (id) LEFT JOIN sem USING (id) LEFT JOIN lex USING (id)""")
def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    events = L.table(spark, d, "events")
    name = F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id")
    calls = filters.confident(L.user_calls(spark, d))
    seeds = _seed_users(spark, d)
    graph = traverse.walk(calls, seeds, 2).withColumn("direction", F.lit("callee")).unionAll(traverse.walk(calls, seeds, 2, True).withColumn("direction", F.lit("caller")))
    semantic = events.where("event_type = 'purchase'").groupBy("user_id").agg((F.max("value") / 200.0).alias("score")).select(name, "score")
    # A user's text is the types of their events: its terms are counted as they are.
    counts = events.where("event_type IS NOT NULL").groupBy("user_id", "event_type").agg(F.count("*").alias("tf"))
    sizes = counts.groupBy("user_id").agg(F.sum("tf").alias("len"))
    index = counts.join(sizes, "user_id").select(name, F.col("event_type").alias("term"), "tf", "len")
    hits = search.bm25_indexed(index, sizes.agg(F.count("*").alias("docs"), F.sum("len").alias("words")), _EVENT_TERMS, R.LEXICAL_SEEDS)
    lexical = hits.select("id", fusion.lexical_score(F.row_number().over(R.Window.orderBy(F.desc("score"), "id")) - 1).alias("score"))  # three rows
    return fusion.fuse(seeds, semantic, lexical, fusion.call_scores(graph)).select("id", F.round("score", 9).alias("score"))


@query(f"""WITH {L.NODES}, {L.EDGES}, seed AS (SELECT id FROM nodes WHERE name = (SELECT min(p_name) FROM part)), sure AS (SELECT * FROM calls WHERE confidence >= 0.5),
{_walk_sql("sure", "SELECT id FROM seed", 2, False, "o")}, {_walk_sql("sure", "SELECT id FROM seed", 2, True, "i")},
c AS (SELECT id, max(s) AS call, min(distance) AS distance FROM (SELECT id, 0.25::double / distance AS s, distance FROM o UNION ALL SELECT id, 0.20::double / distance, distance FROM i) GROUP BY id),
ends AS (SELECT c.id, call AS score, distance FROM c WHERE id NOT IN (SELECT id FROM seed) UNION ALL SELECT id, 1.0::double, 0 FROM seed),
best AS (SELECT n.id, n.name, n.file_path, score, distance, row_number() OVER (PARTITION BY file_path, name ORDER BY score DESC, distance, n.id) AS r FROM ends JOIN nodes n USING (id) WHERE type IN ('METHOD', 'FUNCTION')),
top AS (SELECT * FROM best WHERE r = 1 ORDER BY score DESC, distance, id LIMIT 40)
SELECT t.id, name, file_path, round(score, 9) AS score, distance::integer AS distance, (SELECT count(DISTINCT source) FROM calls WHERE target = t.id)::bigint AS callers, (SELECT count(DISTINCT target) FROM calls WHERE source = t.id)::bigint AS callees FROM top t""")
def retrieve(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = L.kept(spark, d, L.nodes), L.kept(spark, d, L.edges)
    name = L.table(spark, d, "part").agg(F.min("p_name")).first()[0]
    seeds = R.seeds(nodes, None, symbol=name)
    return R.retrieve(nodes, edges, *seeds, depth=2, limit=40).select("id", "name", "file_path", F.round("score", 9).alias("score"), "distance", "callers", "callees")


# --- scalar functions -----------------------------------------------------------------------------------------------


@query("SELECT page_id, substr(sha1(html), 1, 12) AS hash FROM pages")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "pages").select("page_id", T.content_hash(F.col("html")).alias("hash"))


@query(r"""WITH t AS (SELECT doc_id, source, lang, coalesce(regexp_replace(string_split(text, e'\n')[1], '^\s+|\s+$', '', 'g'), source) AS line FROM documents)
SELECT doc_id, 'METHOD ' || source || ' in ' || CASE WHEN line <> '' THEN lang || '/' || source || ': ' || substr(line, 1, 512) ELSE 'a\' || lang || '/' || source || '.java' END AS node_text FROM t""")
def node_text(spark: SparkSession, d: str) -> DataFrame:
    line = F.element_at(F.split("text", "\n", -1), 1)
    path = F.concat(F.lit("a\\"), "lang", F.lit("/"), "source", F.lit(".java"))
    return L.table(spark, d, "documents").select("doc_id", T.node_text(F.lit("METHOD"), F.col("source"), path, line, F.lit("")).alias("node_text"))


@query("""SELECT p_partkey, 'config:MAX_' || p_size || ' KEY' || p_partkey || ' reading part ' || p_partkey || ' now Name' AS extras FROM part""")
def node_text_extras(spark: SparkSession, d: str) -> DataFrame:
    body = F.format_string('int f() { a = AdapterConstants.MAX_%s; b = getConfigurationItem( KEY%s ); log("reading part %s now"); u("https://x.example/%s"); c.getgetName(); d.getName(); }', F.col("p_size").cast("string"), *[F.col("p_partkey").cast("string")] * 3)
    t = T.node_text(F.lit("METHOD"), F.lit("f"), F.lit("p/F.java"), F.lit("s"), body)
    return L.table(spark, d, "part").select("p_partkey", F.regexp_extract(t, "^METHOD f in p/F: s (.*)$", 1).alias("extras"))


@query("""WITH s AS (SELECT page_id, 'src/' || lower(regexp_extract(url, '://([^/]+)', 1)) || CASE page_id % 6 WHEN 0 THEN '/App.TS' WHEN 1 THEN '/node_modules/x.js' WHEN 2 THEN '/a.test.ts' WHEN 3 THEN '/Dockerfile' WHEN 4 THEN '/notes.txt' ELSE '/spec/x.go' END AS path FROM pages)
SELECT page_id, path FROM s WHERE page_id % 6 IN (0, 3)""")
def scan_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 6
    tail = F.when(k == 0, "/App.TS").when(k == 1, "/node_modules/x.js").when(k == 2, "/a.test.ts").when(k == 3, "/Dockerfile").when(k == 4, "/notes.txt").otherwise("/spec/x.go")
    path = F.concat(F.lit("src/"), F.lower(F.regexp_extract("url", "://([^/]+)", 1)), tail)
    return L.table(spark, d, "pages").select("page_id", path.alias("path")).where(scan.is_scanned(F.col("path")))


# --- stack traces ---------------------------------------------------------------------------------------------------


def _frames_sql(lang: str) -> str:
    return {
        "java": "SELECT p_partkey AS trace_id, pos::integer AS pos, c AS class_name, m AS method_name, f AS file_path, p_partkey::integer AS line FROM part, LATERAL (VALUES (1, 'List', 'get', 'List.java'), (2, 'Svc' || p_partkey, 'run' || p_partkey, 'Svc' || p_partkey || '.java')) v(pos, c, m, f) WHERE p_partkey % 5 = 0",
        "node": "SELECT p_partkey AS trace_id, pos::integer AS pos, c AS class_name, m AS method_name, f AS file_path, p_partkey::integer AS line FROM part, LATERAL (VALUES (1, NULL, 'load', 'node_modules/lib/index.js'), (2, 'Store', 'fetch' || p_partkey, 'src/store' || p_partkey || '.ts'), (3, NULL, NULL, 'src/main.ts')) v(pos, c, m, f) WHERE p_partkey % 5 = 1",
        "python": "SELECT p_partkey AS trace_id, pos::integer AS pos, NULL::varchar AS class_name, m AS method_name, f AS file_path, l::integer AS line FROM part, LATERAL (VALUES (1, NULL, 'app/job' || p_partkey || '.py', p_partkey), (2, 'go' || p_partkey, 'app/util.py', 7)) v(pos, m, f, l) WHERE p_partkey % 5 = 2",
        "go": "SELECT p_partkey AS trace_id, pos::integer AS pos, NULL::varchar AS class_name, m AS method_name, f AS file_path, l::integer AS line FROM part, LATERAL (VALUES (4, 'work' || p_partkey, '/srv/work' || p_partkey || '.go', p_partkey), (6, 'main', '/srv/main.go', 9)) v(pos, m, f, l) WHERE p_partkey % 5 = 3",
    }[lang]


def _frames(lang: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return X.frames(L.traces(spark, d)).where(F.col("lang") == lang).select("trace_id", "pos", "class_name", "method_name", "file_path", "line")

    run.__name__ = f"stack_frames_{lang}"
    return run


for _lang in ("java", "node", "python", "go"):
    query(_frames_sql(_lang))(_frames(_lang))


@query("""SELECT p_partkey AS trace_id, CASE p_partkey % 5 WHEN 0 THEN 'com.acme.Fail' || p_partkey || 'Exception: no stock' WHEN 1 THEN 'TypeError: x is undefined' WHEN 2 THEN 'ValueError: bad' ELSE 'panic: boom' END AS error_message FROM part WHERE p_partkey % 5 < 4""")
def error_headers(spark: SparkSession, d: str) -> DataFrame:
    return X.errors(L.traces(spark, d))


@query("""SELECT p_partkey AS trace_id, CASE p_partkey % 5 WHEN 0 THEN 'List.java' WHEN 1 THEN 'src/store' || p_partkey || '.ts' WHEN 2 THEN 'app/job' || p_partkey || '.py' ELSE '/srv/work' || p_partkey || '.go' END AS file_path, p_partkey::integer AS line FROM part WHERE p_partkey % 5 < 4""")
def epicentre(spark: SparkSession, d: str) -> DataFrame:
    return X.epicentres(X.frames(L.traces(spark, d))).select("trace_id", "file_path", "line")


_HINT = r"(\w+\.(?:java|ts|js|py|go))\s*[:#]\s*(\d+)"


@query(f"""WITH {L.TRACES}, found AS (SELECT trace_id, regexp_extract_all(text, '{_HINT}', 1) AS file, regexp_extract_all(text, '{_HINT}', 2) AS line FROM traces)
SELECT trace_id, concat_ws(';', nullif(array_to_string(list_transform(generate_series(1, len(file)), lambda i: file[i] || ':' || line[i]), ';'), ''),
  CASE WHEN trace_id % 5 = 4 THEN 'Store' || trace_id || ':' || trace_id || ';or:' || trace_id || ';Util' || trace_id || ':4' END) AS hints FROM found""")
def line_hints(spark: SparkSession, d: str) -> DataFrame:
    hints = F.array_join(F.transform(X.line_hints(F.col("text")), lambda h: F.concat_ws(":", h["file_hint"], h["line"].cast("string"))), ";")
    return L.traces(spark, d).select("trace_id", hints.alias("hints"))
