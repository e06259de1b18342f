"""Diagnosis of all traces of the driver's parts, over code that they point to.

Each part is a report and a method. Reports of Java meet in one file; every fifth names its place in words, and of
these every second names a file that there is not, so that its vector must tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vector_index import VectorIndex
from ..sources.places import shared_folder, spread, stored
from . import lenses as L
from . import reports as R
from .queries import query


def nodes(spark: SparkSession, d: str) -> DataFrame:
    p = L.table(spark, d, "part")
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    gone = F.when(k % 10 == 4, "lost/Gone").otherwise("x/Svc")
    path = (
        F.when(k % 5 == 0, F.lit("jdk/List.java")).when(k % 5 == 1, F.concat(F.lit("web/src/store"), key, F.lit(".ts"))).when(k % 5 == 2, F.concat(F.lit("root/app/job"), key, F.lit(".py")))
        .when(k % 5 == 3, F.concat(F.lit("root/srv/work"), key, F.lit(".go"))).otherwise(F.concat(gone, key, F.lit(".java")))
    )
    start = F.when(k % 5 == 0, k).otherwise(1).cast("int")
    kind = F.when(k % 7 == 0, "CLASS").when(k % 7 == 1, "FUNCTION").otherwise("METHOD")
    own = p.select(F.concat(F.lit("t"), key).alias("id"), kind.alias("type"), F.concat(F.lit("run"), key).alias("name"), path.alias("file_path"), start.alias("start_line"), (start + 3 + k % 50).cast("int").alias("end_line"), F.lit("parts").alias("repo_name"))
    # Two kinds of tests: named after a method, or of its name in a test file.
    name = F.concat(F.lit("run"), key, F.when(k % 6 == 1, "Test").otherwise(""))
    tests = p.where(k % 3 == 1).select(F.concat(F.lit("z"), key), F.lit("METHOD"), name, F.concat(F.lit("src/test/T"), key, F.lit(".java")), F.lit(1), F.lit(9), F.lit("parts"))
    return own.unionAll(tests)


NODES = """n AS (SELECT 't' || p_partkey AS id, p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN 'CLASS' WHEN 1 THEN 'FUNCTION' ELSE 'METHOD' END AS type, 'run' || p_partkey AS name,
  CASE p_partkey % 5 WHEN 0 THEN 'jdk/List.java' WHEN 1 THEN 'web/src/store' || p_partkey || '.ts' WHEN 2 THEN 'root/app/job' || p_partkey || '.py' WHEN 3 THEN 'root/srv/work' || p_partkey || '.go' ELSE CASE WHEN p_partkey % 10 = 4 THEN 'lost/Gone' ELSE 'x/Svc' END || p_partkey || '.java' END AS path,
  CASE WHEN p_partkey % 5 = 0 THEN p_partkey ELSE 1 END AS a, CASE WHEN p_partkey % 5 = 0 THEN p_partkey ELSE 1 END + 3 + p_partkey % 50 AS b FROM part)"""


def _vectors(spark: SparkSession, d: str) -> int:
    """Embeddings that both nodes and reports have: as many as there are of the fewer, parts or embeddings."""
    return min(L.table(spark, d, "embeddings").count(), L.table(spark, d, "part").count())


def reports(spark: SparkSession, d: str) -> DataFrame:
    """The traces; those in words are questions, and all have the vector of an embedding."""
    n = _vectors(spark, d)
    vectors = L.table(spark, d, "embeddings").select((F.col("vec_id")).alias("v"), F.col("embedding").cast("array<double>").alias("vector"))
    words = F.col("trace_id") % 5 == 4
    t = spread(L.traces(spark, d), "trace_id").select(F.col("trace_id").alias("report_id"), F.when(words, F.col("text")).otherwise("what is it").alias("question"), F.lit(None).cast("string").alias("error"), F.when(~words, F.col("text")).alias("trace"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), ((F.col("trace_id") * 7) % n).alias("v"))
    return t.join(vectors.hint("merge"), "v", "left").drop("v")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    n = _vectors(spark, d)
    own = L.table(spark, d, "part").select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_partkey") % n).alias("vec_id"))
    return own.join(L.table(spark, d, "embeddings").select("vec_id", "embedding").hint("merge"), "vec_id").select("id", "embedding")


@query(f"""WITH {NODES}, t AS (SELECT 'z' || k AS id, 'run' || k || CASE WHEN k % 6 = 1 THEN 'Test' ELSE '' END AS name FROM n WHERE k % 3 = 1),
e AS (SELECT least((SELECT count(*) FROM embeddings), (SELECT count(*) FROM part)) AS n),
r AS (SELECT p_partkey AS report_id, p_partkey % 5 AS turn, p_partkey AS k FROM part),
place AS (SELECT report_id, CASE turn WHEN 0 THEN 'List.java' WHEN 1 THEN 'src/store' || k || '.ts' WHEN 2 THEN 'app/job' || k || '.py' WHEN 3 THEN '/srv/work' || k || '.go' ELSE 'Svc' || k || '.java' END AS file, k AS line FROM r),
ranked AS (SELECT report_id, id, row_number() OVER (PARTITION BY report_id ORDER BY CASE WHEN b >= line AND b > a THEN b - a ELSE 999999 END, a DESC, id) AS rank FROM place JOIN n ON contains(path, file) AND a <= line),
exact AS (SELECT report_id, id FROM ranked WHERE rank = 1),
far AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS s FROM embeddings a, embeddings b, e WHERE a.vec_id < e.n AND b.vec_id < e.n AND a.vec_id IN (SELECT (k * 7) % e.n FROM r, e WHERE turn = 4)),
near AS (SELECT report_id, id, type, row_number() OVER (PARTITION BY report_id ORDER BY s DESC, id) AS rank FROM r, e, n, far WHERE report_id NOT IN (SELECT report_id FROM exact) AND far.a = (r.k * 7) % e.n AND far.b = n.k % e.n AND s >= 0.30),
semantic AS (SELECT report_id, first(id ORDER BY rank) AS id FROM near WHERE rank <= 5 AND type <> 'CLASS' GROUP BY report_id),
met AS (SELECT r.report_id, coalesce(x.id, s.id) AS id, CASE WHEN x.id IS NOT NULL THEN 'exact' WHEN s.id IS NOT NULL THEN 'semantic' ELSE 'none' END AS level FROM r LEFT JOIN exact x USING (report_id) LEFT JOIN semantic s USING (report_id)),
o AS (SELECT m.id AS o, n.k, n.name FROM (SELECT DISTINCT id FROM met) m JOIN n USING (id)),
c AS (SELECT o, string_agg('t' || (k - i), ',' ORDER BY i) AS callers FROM o, range(1, 3) x(i) WHERE k - i IN (SELECT k FROM n) GROUP BY o),
g AS (SELECT o, string_agg('t' || (k + i), ',' ORDER BY i) AS callees FROM o, range(1, 3) x(i) WHERE k + i IN (SELECT k FROM n) GROUP BY o),
f AS (SELECT o, string_agg('f' || p_partkey, ',' ORDER BY CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, 'f' || p_partkey) AS findings FROM o, range(0, 3) x(i), part WHERE p_partkey = k + i GROUP BY o),
v AS (SELECT 't' || (event_id % 500) AS o, 'i' || event_id AS id, row_number() OVER (PARTITION BY event_id % 500 ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S') DESC, 'i' || event_id) AS rank FROM events),
w AS (SELECT o, string_agg(id, ',' ORDER BY rank) AS evidence FROM v WHERE rank <= 3 GROUP BY o),
y AS (SELECT o, string_agg(t.id, ',' ORDER BY t.id) AS tests FROM o JOIN t ON t.name IN (o.name, o.name || 'Test') GROUP BY o)
SELECT report_id, level, m.id, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees, CASE WHEN level = 'exact' THEN coalesce(findings, '') ELSE '' END AS findings, CASE WHEN level = 'exact' THEN coalesce(evidence, '') ELSE '' END AS evidence, coalesce(tests, '') AS tests
FROM met m LEFT JOIN c ON c.o = m.id LEFT JOIN g ON g.o = m.id LEFT JOIN f ON f.o = m.id LEFT JOIN w ON w.o = m.id LEFT JOIN y ON y.o = m.id""")
def diagnose_reports(spark: SparkSession, d: str) -> DataFrame:
    part = L.table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    name = lambda c: F.concat(F.lit("t"), F.col(c).cast("string"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("next"))
    calls = part.join(after.hint("merge"), "p_partkey").select(name("p_partkey").alias("source"), name("next").alias("target"), F.lit("CALLS").alias("type"))
    level = F.when(F.col("p_size") % 3 == 0, "high").when(F.col("p_size") % 3 == 1, "medium").otherwise("low")
    findings = part.select(F.concat(F.lit("f"), key).alias("id"), name("p_partkey").alias("node_id"), level.alias("severity"))
    incidents = L.table(spark, d, "events").select(F.concat(F.lit("i"), F.col("event_id").cast("string")).alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("observed_at"), "event_id")
    affects = incidents.select(F.col("id").alias("source"), F.concat(F.lit("t"), (F.col("event_id") % 500).cast("string")).alias("target"))
    index = VectorIndex.build(vectors(spark, d), shared_folder(spark, "vectors"), 16, 16)
    found = R.diagnose_all(stored(reports(spark, d), "reports"), nodes(spark, d), calls, findings, affects, incidents, index, probes=16)
    return found.select("report_id", "level", "id", *[F.array_join(c, ",").alias(c) for c in ("callers", "callees", "findings", "evidence", "tests")])
