"""The driver's tables seen as a code graph, in DataFrames and, for the oracles, in SQL.

Regions are repositories, nations files; customers are classes, suppliers interfaces, orders methods, parts functions.
Regions contain nations, these customers, these orders; orders call parts and parts suppliers, through line items.
Users make a second graph, with cycles: consecutive errors call each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import traverse
from ..sources.places import parts_of, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    # 25 rows: a file and its repository.
    place = F.broadcast(nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"))

    def rows(df: DataFrame, kind: str, prefix: str, key: str, name, path, repo) -> DataFrame:
        return df.select(F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), name.alias("name"), path.alias("file_path"), repo.alias("repo_name"))

    customer, supplier = (table(spark, d, t) for t in ("customer", "supplier"))
    own = table(spark, d, "orders").join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    parts = [
        rows(region, "FILE", "region", "r_regionkey", F.col("r_name"), F.col("r_name"), F.col("r_name")),
        rows(place, "FILE", "nation", "n_nationkey", F.col("n_name"), F.col("n_name"), F.col("r_name")),
        rows(customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")), "CLASS", "customer", "c_custkey", F.col("c_name"), F.col("n_name"), F.col("r_name")),
        rows(supplier.join(place, F.col("s_nationkey") == F.col("n_nationkey")), "INTERFACE", "supplier", "s_suppkey", F.col("s_name"), F.col("n_name"), F.col("r_name")),
        rows(own, "METHOD", "order", "o_orderkey", F.concat(F.lit("Order"), F.col("o_orderkey").cast("string")), F.col("n_name"), F.col("r_name")),
        rows(table(spark, d, "part"), "FUNCTION", "part", "p_partkey", F.col("p_name"), F.col("p_brand"), F.lit("parts")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


_KEPT: dict[str, tuple[str, DataFrame]] = {}


def kept(spark: SparkSession, d: str, lens) -> DataFrame:
    """A lens in the cache (memory, then disk): walks read it once for each hop and direction. One of each kind is kept; tables of
    another folder take its place."""
    key = f"{spark.sparkContext.applicationId} {d}"
    known = _KEPT.get(lens.__name__)
    if known and known[0] == key:
        return known[1]
    if known and known[0].split()[0] == spark.sparkContext.applicationId:
        known[1].unpersist()
    # A cached plan keeps its many small shuffle partitions: they are put together, but not into so few that what a task holds grows with the table.
    _KEPT[lens.__name__] = (key, lens(spark, d).coalesce(call_parts(spark, d)).persist())
    return _KEPT[lens.__name__][1]


_HELD: dict[str, tuple[str, DataFrame]] = {}


def held(spark: SparkSession, d: str, lens) -> DataFrame:
    """A lens as a table in the shared folder, made once for a folder: what is large, and costs much to make, is not for the cache."""
    key = f"{spark.sparkContext.applicationId} {d}"
    if _HELD.get(lens.__name__, ("",))[0] != key:
        _HELD[lens.__name__] = (key, stored(lens(spark, d), lens.__name__))
    return _HELD[lens.__name__][1]


_ADJACENT: dict[str, tuple[str, traverse.Adjacency]] = {}


def adjacent(spark: SparkSession, d: str, lens) -> traverse.Adjacency:
    """A lens of edges in buckets, made once for a folder; the one of another folder goes."""
    key = f"{spark.sparkContext.applicationId} {d}"
    known = _ADJACENT.get(lens.__name__)
    if known and known[0] == key:
        return known[1]
    if known and known[0].split()[0] == spark.sparkContext.applicationId:
        known[1].drop()
    _ADJACENT[lens.__name__] = (key, traverse.adjacency(lens(spark, d)))
    return _ADJACENT[lens.__name__][1]


NODES = """places AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'FILE' AS type, r_name AS name, r_name AS file_path, r_name AS repo_name FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'FILE', n_name, n_name, r_name FROM places
  UNION ALL SELECT 'customer:' || c_custkey, 'CLASS', c_name, n_name, r_name FROM customer JOIN places ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'INTERFACE', s_name, n_name, r_name FROM supplier JOIN places ON s_nationkey = n_nationkey
  UNION ALL SELECT 'order:' || o_orderkey, 'METHOD', 'Order' || o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, 'FUNCTION', p_name, p_brand, 'parts' FROM part)"""


def call_parts(spark: SparkSession, d: str) -> int:
    return parts_of(table(spark, d, "lineitem"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, type, confidence): orders to parts, parts to suppliers."""
    items = table(spark, d, "lineitem")
    n = call_parts(spark, d)

    def rows(a: str, b: str, x: str, y: str) -> DataFrame:
        # Dealt first: pairs hardly repeat, and a task that combined those of its file would hold all that it reads.
        grouped = items.select(a, b, "l_quantity").repartition(n, a, b).groupBy(a, b).agg((F.max("l_quantity") / 50.0).alias("confidence"))
        return grouped.select(F.concat(F.lit(f"{x}:"), F.col(a).cast("string")).alias("source"), F.concat(F.lit(f"{y}:"), F.col(b).cast("string")).alias("target"), F.lit("CALLS").alias("type"), "confidence")

    return rows("l_orderkey", "l_partkey", "order", "part").unionAll(rows("l_partkey", "l_suppkey", "part", "supplier"))


CALLS = """calls AS (
  SELECT 'order:' || l_orderkey AS source, 'part:' || l_partkey AS target, 'CALLS' AS type, max(l_quantity) / 50.0::double AS confidence FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'CALLS', max(l_quantity) / 50.0::double FROM lineitem GROUP BY l_partkey, l_suppkey)"""


def contains(spark: SparkSession, d: str) -> DataFrame:
    def rows(t: str, a: str, b: str, x: str, y: str) -> DataFrame:
        return table(spark, d, t).select(F.concat(F.lit(f"{x}:"), F.col(a).cast("string")).alias("source"), F.concat(F.lit(f"{y}:"), F.col(b).cast("string")).alias("target"), F.lit("CONTAINS").alias("type"), F.lit(1.0).alias("confidence"))

    return rows("nation", "n_regionkey", "n_nationkey", "region", "nation").unionAll(rows("customer", "c_nationkey", "c_custkey", "nation", "customer")).unionAll(rows("orders", "o_custkey", "o_orderkey", "customer", "order"))


CONTAINS = """contains_ AS (
  SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'CONTAINS' AS type, 1.0::double AS confidence FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS', 1.0::double FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'CONTAINS', 1.0::double FROM orders)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    return contains(spark, d).unionAll(calls(spark, d))


EDGES = f"""{CALLS},
{CONTAINS},
edges AS (SELECT * FROM calls UNION ALL SELECT * FROM contains_)"""


def user_nodes(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct()
    return users.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id"), F.lit("METHOD").alias("type"), F.lit("users").alias("repo_name"))


def user_calls(spark: SparkSession, d: str) -> DataFrame:
    # Errors follow each other over the whole table; days part the window so that no task holds them all.
    errors = table(spark, d, "events").where("event_type = 'error'").select("ts", "event_id", "user_id", "value", F.to_date("ts").alias("day"))
    part = Window.partitionBy("day").orderBy("ts", "event_id")
    inner = errors.withColumn("next", F.lead("user_id").over(part))
    firsts = errors.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    follow = firsts.select("day", F.lead("first").over(Window.orderBy("day")).alias("following"))  # a row for each day
    step = inner.join(F.broadcast(follow), "day").select("user_id", F.coalesce("next", "following").alias("next"), "value").where("user_id <> next")
    return step.groupBy("user_id", "next").agg((F.max("value") / 100.0).alias("confidence")).select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("source"), F.concat(F.lit("user:"), F.col("next").cast("string")).alias("target"), F.lit("CALLS").alias("type"), "confidence")


USERS = """user_nodes AS (SELECT DISTINCT 'user:' || user_id AS id FROM events),
user_steps AS (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS next, value FROM events WHERE event_type = 'error'),
user_calls AS (SELECT 'user:' || user_id AS source, 'user:' || next AS target, max(value) / 100.0::double AS confidence FROM user_steps WHERE user_id <> next GROUP BY user_id, next)"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Days of orders by customer ("file") and priority: (id, file_path, start_line, end_line)."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    grouped = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min(day).alias("start_line"), F.max(day).alias("end_line"))
    return grouped.select(F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file_path"), "start_line", "end_line")


SPANS = """spans AS (SELECT o_custkey || '/' || o_orderpriority AS id, 'c' || o_custkey AS file_path, min(date_diff('day', DATE '1970-01-01', o_orderdate::date))::integer AS start_line,
  max(date_diff('day', DATE '1970-01-01', o_orderdate::date))::integer AS end_line FROM orders GROUP BY o_custkey, o_orderpriority)"""

#: Lines to look up: for each customer, a day from its number and some of no customer.
PROBE = "(9000 + (c_custkey * 37) % 1500)::integer"
PROBES = f"probes AS (SELECT c_custkey AS probe, 'c' || c_custkey AS file_path, {PROBE} AS line FROM customer UNION ALL SELECT -s_suppkey, 'none' || s_suppkey, 9500 FROM supplier)"


def probes(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("probe"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("file_path"), F.expr("cast(9000 + (c_custkey * 37) % 1500 AS int)").alias("line"))
    none = table(spark, d, "supplier").select((-F.col("s_suppkey")).alias("probe"), F.concat(F.lit("none"), F.col("s_suppkey").cast("string")).alias("file_path"), F.lit(9500).alias("line"))
    return own.unionAll(none)


def traces(spark: SparkSession, d: str) -> DataFrame:
    """Stack traces made from parts: five languages in turn, with headers, library frames and lines that mean nothing."""
    p = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    text = (
        F.when(F.col("p_partkey") % 5 == 0, F.format_string("com.acme.Fail%sException: no stock\n\tat java.util.List.get(List.java:%s)\n\tat com.acme.Svc%s.run%s(Svc%s.java:%s)\nnoise", key, key, key, key, key, key))
        .when(F.col("p_partkey") % 5 == 1, F.format_string("TypeError: x is undefined\n    at load (node_modules/lib/index.js:%s:3)\n    at Store.fetch%s (src/store%s.ts:%s:11)\n    at src/main.ts:%s:1", key, key, key, key, key))
        .when(F.col("p_partkey") % 5 == 2, F.format_string('Traceback (most recent call last):\n  File "app/job%s.py", line %s, in <module>\n  File "app/util.py", line 7, in go%s\nValueError: bad', key, key, key))
        .when(F.col("p_partkey") % 5 == 3, F.format_string("panic: boom\n\ngoroutine 1 [running]:\nmain.work%s(0x1)\n\t/srv/work%s.go:%s +0x1d\nmain.main()\n\t/srv/main.go:9 +0x2", key, key, key))
        .otherwise(F.format_string("see Svc%s.java:%s or line %s in Store%s, and Util%s at line 4", key, key, key, key, key))
    )
    return p.select(F.col("p_partkey").alias("trace_id"), text.alias("text"))


TRACES = """traces AS (SELECT p_partkey AS trace_id, CASE p_partkey % 5
  WHEN 0 THEN printf(e'com.acme.Fail%dException: no stock\\n\\tat java.util.List.get(List.java:%d)\\n\\tat com.acme.Svc%d.run%d(Svc%d.java:%d)\\nnoise', p_partkey, p_partkey, p_partkey, p_partkey, p_partkey, p_partkey)
  WHEN 1 THEN printf(e'TypeError: x is undefined\\n    at load (node_modules/lib/index.js:%d:3)\\n    at Store.fetch%d (src/store%d.ts:%d:11)\\n    at src/main.ts:%d:1', p_partkey, p_partkey, p_partkey, p_partkey, p_partkey)
  WHEN 2 THEN printf(e'Traceback (most recent call last):\\n  File "app/job%d.py", line %d, in <module>\\n  File "app/util.py", line 7, in go%d\\nValueError: bad', p_partkey, p_partkey, p_partkey)
  WHEN 3 THEN printf(e'panic: boom\\n\\ngoroutine 1 [running]:\\nmain.work%d(0x1)\\n\\t/srv/work%d.go:%d +0x1d\\nmain.main()\\n\\t/srv/main.go:9 +0x2', p_partkey, p_partkey, p_partkey)
  ELSE printf('see Svc%d.java:%d or line %d in Store%d, and Util%d at line 4', p_partkey, p_partkey, p_partkey, p_partkey, p_partkey) END AS text FROM part)"""
