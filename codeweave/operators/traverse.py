"""Bounded walks over edges, by levels.

A level is the distinct ends of the edges that leave the level before; a walk of d hops is d joins on one key. Distances
are the first level in which a node shows. Seeds are small and broadcast behind a check; later levels are not.

Edges are a table, or an `Adjacency`: the same edges twice, in buckets by their sources and by their targets. A hop over that moves the
level alone, never the edges.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.places import shared_folder, stored
from .filters import confident, in_repo

SEEDS = 10_000
#: Edges of one end beyond which they are kept apart from the buckets.
HUB = 1_000_000


@dataclass
class Adjacency:
    """Edges in buckets by their sources (`out`) and by their targets (`into`). Those of hubs are no part of a bucket, so that no task reads
    all of a hub's; they are plain tables (`hubs_out`, `hubs_into`, None without hubs), which are met by the hubs of a level alone."""

    out: DataFrame
    into: DataFrame
    hubs_out: DataFrame | None = None
    hubs_into: DataFrame | None = None
    tables: list[str] = field(default_factory=list)

    def where(self, condition: str | Column) -> Adjacency:
        kept = [t if t is None else t.where(condition) for t in (self.out, self.into, self.hubs_out, self.hubs_into)]
        return Adjacency(*kept, tables=self.tables)

    def drop(self) -> None:
        """Drops the tables; their files lie in the shared folder."""
        for name in self.tables:
            self.out.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


Edges = DataFrame | Adjacency


def adjacency(edges: DataFrame, hub: int = HUB, buckets: int | None = None) -> Adjacency:
    """edges (source, target, type, confidence) as an `Adjacency` of external tables in the shared folder. There are as many buckets
    as the session's shuffles have partitions; in a session with more of them Spark would shuffle the edges again."""
    spark = edges.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names: list[str] = []

    def bucketed(rows: DataFrame, end: str) -> DataFrame:
        name = f"adjacency_{end}_{uuid.uuid4().hex}"
        # Rows come in the order of their buckets, so a task writes few files.
        rows.repartition(n, end).write.bucketBy(n, end).sortBy(end).option("path", shared_folder(spark, name)).format("parquet").saveAsTable(name)
        names.append(name)
        return spark.table(name)

    def parted(rows: DataFrame, end: str) -> tuple[DataFrame, DataFrame | None]:
        table = bucketed(rows, end)
        hot = settled(table.groupBy(end).count().where(F.col("count") > hub).select(end))  # within buckets: no shuffle
        if hot.isEmpty():
            return table, None
        at = shared_folder(spark, f"hubs_{end}")
        table.join(hot, end, "left_semi").write.parquet(at)
        return bucketed(table.join(hot, end, "left_anti"), end), spark.read.parquet(at)

    out, hubs_out = parted(edges, "source")
    every = out if hubs_out is None else out.unionByName(hubs_out)
    into, hubs_into = parted(every, "target")
    return Adjacency(out, into, hubs_out, hubs_into, names)


def steps(edges: Edges, level: DataFrame, inbound: bool = False) -> DataFrame:
    """(_from, _to): the edges that leave a level (id), or that enter it."""
    a, b = ("target", "source") if inbound else ("source", "target")
    tables = [edges] if isinstance(edges, DataFrame) else [edges.into, edges.hubs_into] if inbound else [edges.out, edges.hubs_out]
    found = [t.select(F.col(a).alias("_from"), F.col(b).alias("_to")).join(level, F.col("_from") == F.col("id"), "left_semi") for t in tables if t is not None]
    return found[0] if len(found) == 1 else found[0].unionAll(found[1])


def clamp(depth: float, cap: int) -> int:
    return int(max(1, min(depth, cap)))


def settled(df: DataFrame, most: int = SEEDS) -> DataFrame:
    """The rows as a local table, to be broadcast, where there are at most `most`: their plan runs once, not at each use."""
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df


def walk(edges: Edges, seeds: DataFrame, hops: int, inbound: bool = False) -> DataFrame:
    """(id, distance) of the nodes that 1 to `hops` edges reach from the seeds (id), seeds in cycles included."""
    level = settled(seeds.select("id").distinct())
    out: DataFrame | None = None
    for d in range(1, hops + 1):
        level = steps(edges, level, inbound).select(F.col("_to").alias("id")).distinct()
        here = level.withColumn("distance", F.lit(d))
        out = here if out is None else out.unionAll(here)
    return out.groupBy("id").agg(F.min("distance").alias("distance"))


def walk_each(edges: Edges, seeds: DataFrame, hops: int, inbound: bool = False) -> DataFrame:
    """(origin, id, distance): what 1 to `hops` edges reach from each of the seeds (origin), at the least distance."""
    a, b = ("target", "source") if inbound else ("source", "target")
    tables = [edges] if isinstance(edges, DataFrame) else [edges.into, edges.hubs_into] if inbound else [edges.out, edges.hubs_out]
    level = settled(seeds.select("origin", F.col("origin").alias("id")).distinct())
    out: DataFrame | None = None
    for d in range(1, hops + 1):
        # Of the seeds, few are broadcast; whatever else meets is merged.
        found = [t.select(F.col(a).alias("id"), F.col(b).alias("_to")).hint("merge").join(level, "id").select("origin", F.col("_to").alias("id")) for t in tables if t is not None]
        level = (found[0] if len(found) == 1 else found[0].unionAll(found[1])).distinct()
        here = level.withColumn("distance", F.lit(d))
        out = here if out is None else out.unionAll(here)
    return out.groupBy("origin", "id").agg(F.min("distance").alias("distance"))


def calls_graph(nodes: DataFrame, edges: Edges, seeds: DataFrame, depth: int = 1, repo: str | None = None, least: float = 0.5) -> DataFrame:
    """(id, direction, distance): callees and callers of the seeds over confident calls, at most 3 hops. Ends are
    methods and functions of the repository that are no seeds; what lies between may be anything."""
    calls = confident(edges.where("type = 'CALLS'"), least)
    hops, seeds = clamp(depth, 3), settled(seeds.select("id").distinct())
    both = walk(calls, seeds, hops).withColumn("direction", F.lit("callee")).unionAll(walk(calls, seeds, hops, True).withColumn("direction", F.lit("caller")))
    ends = in_repo(nodes.where(F.col("type").isin("METHOD", "FUNCTION")), repo).select("id")
    return both.join(seeds.select("id"), "id", "left_anti").join(ends, "id", "left_semi").select("id", "direction", "distance")


def callers(nodes: DataFrame, edges: Edges, node_id: str, depth: int = 2) -> DataFrame:
    """Nodes that call a node, directly or through others; the node itself where it lies in a cycle."""
    return _related(nodes, edges, node_id, depth, True)


def callees(nodes: DataFrame, edges: Edges, node_id: str, depth: int = 2) -> DataFrame:
    return _related(nodes, edges, node_id, depth, False)


def _related(nodes: DataFrame, edges: Edges, node_id: str, depth: int, inbound: bool) -> DataFrame:
    seed = nodes.sparkSession.createDataFrame([(node_id,)], "id string")
    return nodes.join(walk(edges.where("type = 'CALLS'"), seed, clamp(depth, 4), inbound), "id")


def neighbours(nodes: DataFrame, edges: Edges, seeds: DataFrame, depth: int) -> DataFrame:
    """Nodes that containment, definitions and calls reach from the seeds in at most 3 hops, without the seeds."""
    seeds = settled(seeds.select("id").distinct())
    found = walk(edges.where(F.col("type").isin("CONTAINS", "DEFINES", "CALLS")), seeds, clamp(depth, 3))
    return nodes.join(found.join(seeds, "id", "left_anti"), "id")


def call_counts(nodes: DataFrame, edges: Edges, ids: DataFrame, partitions: int | None = None) -> DataFrame:
    """(id, callers, callees): distinct neighbours over calls; 0 where there are none, no row for unknown ids. For many ids, `partitions`
    that go with the edges keep what a task holds bounded; edges then move once for each direction."""
    wanted = settled(ids.select("id").distinct())
    known = nodes.select("id").join(wanted, "id", "left_semi")
    calls = edges.where("type = 'CALLS'")

    def degree(inbound: bool, name: str) -> DataFrame:
        # Only edges at the wanted ids are counted.
        own = calls.repartition(partitions, "target" if inbound else "source") if partitions and isinstance(calls, DataFrame) else calls
        return steps(own, wanted, inbound).distinct().groupBy(F.col("_from").alias("id")).agg(F.count("*").alias(name))

    found = known.join(degree(True, "callers"), "id", "left").join(degree(False, "callees"), "id", "left")
    return found.select("id", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))


def paths(edges: Edges, seeds: DataFrame, types: list[str], hops: int, ends: DataFrame | None = None) -> DataFrame:
    """All paths of 1 to `hops` edges from the seeds, or those alone that end at `ends` (id): (id, path, hops). No edge comes twice in one path.

    Going forward keeps the distinct edges of each level, which all paths through them share; paths are unrolled backwards, from the ends that
    are asked for, so what leads elsewhere costs no path.
    """
    own = edges.where(F.col("type").isin(types))
    level, links = settled(seeds.select("id").distinct()), []
    for _ in range(hops):
        links.append(steps(own, level).distinct())
        level = settled(links[-1].select(F.col("_to").alias("id")).distinct())
    out: DataFrame | None = None
    for d in range(1, hops + 1):
        last = links[d - 1] if ends is None else links[d - 1].join(ends.select(F.col("id").alias("_to")).distinct(), "_to", "left_semi")
        found = last.select(F.col("_to").alias("id"), F.col("_from").alias("_at"), F.array("_from", "_to").alias("path"))
        for link in reversed(links[: d - 1]):
            before = link.select(F.col("_from").alias("_before"), F.col("_to").alias("_at"))
            # The new edge must not be one of the path's: no two neighbours in it are its ends.
            pairs = F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path") - 1), lambda x, y: (x == F.col("_before")) & (y == F.col("_at")))
            found = found.join(before, "_at").where(~F.exists(pairs, lambda same: same)).select("id", F.col("_before").alias("_at"), F.concat(F.array("_before"), "path").alias("path"))
        here = found.select("id", "path", F.lit(d).alias("hops"))
        out = here if out is None else out.unionAll(here)
    return out


def ancestors(edges: DataFrame, types: list[str], hops: int) -> DataFrame:
    """(id, ancestor, distance): what 1 to `hops` edges of the types lead to from each node, at the least distance; a node in a cycle is its own ancestor.

    Pairs within twice a distance come from pairs within it, so a chain of h takes about log h joins; in cycles a pair comes once.
    """
    near = edges.where(F.col("type").isin(types)).select(F.col("source").alias("id"), F.col("target").alias("ancestor")).distinct().withColumn("distance", F.lit(1))
    reach = 1
    while reach < hops:
        near = stored(near, "ancestors")  # read three times
        over = near.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("_over"), F.col("distance").alias("_more"))
        longer = near.join(over.hint("merge"), "ancestor").select("id", F.col("_over").alias("ancestor"), (F.col("distance") + F.col("_more")).alias("distance"))
        near = near.unionAll(longer.where(F.col("distance") <= hops)).groupBy("id", "ancestor").agg(F.min("distance").alias("distance"))
        reach *= 2
    return near


def collected_callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, callers): the distinct ids that call each method or function, in order; empty where none does."""
    calls = edges.where("type = 'CALLS'").groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_set("source")).alias("callers"))
    own = nodes.where(F.col("type").isin("METHOD", "FUNCTION")).select("id")
    return own.join(calls, "id", "left").select("id", F.coalesce("callers", F.array().cast("array<string>")).alias("callers"))


def classes_by_package(nodes: DataFrame) -> DataFrame:
    """(package, id, name, file_path) of the classes and interfaces whose qualified name has a package."""
    package = F.regexp_extract("qualified_name", r"^(.*)\.[^.]+$", 1)
    found = nodes.where(F.col("type").isin("CLASS", "INTERFACE")).select(package.alias("package"), "id", "name", "file_path")
    return found.where(F.col("package") != "")
