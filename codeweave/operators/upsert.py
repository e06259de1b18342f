"""Merges into tables that have no MERGE: last writer wins, by column or by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import last_of


def merge_nodes(base: DataFrame, delta: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """One row for each key: of every column the latest value of the delta that is not null, by `order`, else the base's."""
    columns = [c for c in base.columns if c != key]
    # Column-wise maxima combine on the map side, so a key with many versions moves as one row for each task.
    latest = delta.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_{c}") for c in columns if c in delta.columns])
    joined = base.join(latest, key, "full_outer")
    return joined.select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in delta.columns else F.col(c) for c in columns])


def merge_edges(base: DataFrame, delta: DataFrame, order: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """One edge for each (source, type, target); the delta's properties replace the base's, the later by `order` those
    before, and the largest where no order says. `partitions` of the merge should go with the rows of both, as a task sorts its own."""
    key = ["source", "type", "target"]
    rest = [c for c in base.columns if c not in key]
    places = [F.col(c).alias(f"_order{i}") for i, c in enumerate(order or [])]
    new = delta.select(*[c for c in base.columns if c in delta.columns], *places, F.lit(1).alias("_new"))
    both = base.withColumn("_new", F.lit(0)).unionByName(new, allowMissingColumns=True)
    turn = F.struct("_new", *[f"_order{i}" for i in range(len(places))], *[F.coalesce(c, F.lit("")) if t == "string" else F.col(c) for c, t in base.select(*rest).dtypes])
    if partitions:
        both = both.repartition(partitions, *key)
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), turn).alias("_v")).select(*key, "_v.*").select(*base.columns)


def clear_repo(nodes: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a repository's nodes and all edges at them."""
    gone = nodes.where(F.col("repo_name") == repo).select("id")
    left = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.where(~F.col("repo_name").eqNullSafe(F.lit(repo))), left.select(*edges.columns)


def set_embeddings(embeddings: DataFrame, delta: DataFrame, nodes: DataFrame) -> DataFrame:
    """Embeddings (id, embedding) with those of the delta put in their place, of several for one id the last by `ordinal` if the
    delta has one; ids that no node has are ignored."""
    known = last_of(delta.join(nodes.select("id"), "id", "left_semi"), ["id"])
    return embeddings.join(known.select("id"), "id", "left_anti").unionByName(known.select("id", "embedding"))


def evidence_entities(incidents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (id, label, name, version) of incidents and the edges (source, target, type) to them; a dimension that
    an incident lacks makes neither. A route's id takes the service's id, or nothing, in place of the repository."""
    repo = F.coalesce("repo_name", F.lit(""))
    service_id = F.concat(repo, F.lit("::service::"), "service")

    def part(label: str, link: str, value: str, key, name=None, version=None):
        return F.when(F.col(value).isNotNull() & (F.col(value) != ""), F.struct(key.alias("id"), F.lit(label).alias("label"), (F.col(value) if name is None else name).alias("name"), (F.lit(None).cast("string") if version is None else version).alias("version"), F.lit(link).alias("link")))

    has_service = F.col("service").isNotNull() & (F.col("service") != "")
    dims = F.array(
        part("Service", "OBSERVED_IN", "service", service_id),
        part("Route", "ON_ROUTE", "route", F.concat(F.when(has_service, service_id).otherwise(""), F.lit("::route::"), "route")),
        part("Deployment", "AT_DEPLOYMENT", "deployment_id", F.concat(repo, F.lit("::deployment::"), "deployment_id"), version=F.col("version")),
        part("Dependency", "DEPENDS_ON", "dependency", F.concat(repo, F.lit("::dependency::"), "dependency")),
    )
    rows = incidents.select(F.col("id").alias("source"), F.explode(dims).alias("d")).where("d IS NOT NULL")
    entities = rows.groupBy(F.col("d.id").alias("id"), F.col("d.label").alias("label"), F.col("d.name").alias("name")).agg(F.max("d.version").alias("version"))
    return entities, rows.select("source", F.col("d.id").alias("target"), F.col("d.link").alias("type")).distinct()


def merge_findings(base: DataFrame, delta: DataFrame, nodes: DataFrame, repo: str) -> DataFrame:
    """Findings by id, the delta's over the base's and the last of the delta by `ordinal` if it has one, of nodes that exist,
    stamped with the repository."""
    known = last_of(delta.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi").withColumn("repo_name", F.lit(repo)), ["id"])
    return base.join(known.select("id"), "id", "left_anti").unionByName(known.select(*base.columns))


def merge_rows(base: DataFrame, delta: DataFrame, key: str = "id") -> DataFrame:
    """Rows by key, the delta's over the base's as a whole, the last of the delta by `ordinal` if it has one."""
    new = last_of(delta, [key])
    return base.join(new.select(key), key, "left_anti").unionByName(new.select(*base.columns))
