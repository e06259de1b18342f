"""Indexing: source text to nodes, edges and references, then to edges between ids, and embeddings.

Files are dealt to tasks by their paths and each is parsed once, by `mapInArrow`; every record of a file is one row of a tagged union, which is written once and then filtered
into tables, so no file is parsed twice and nothing is gathered on the driver. A file that cannot be parsed becomes a
row of its error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T
from ..operators import filters, resolve
from ..sources import parsers
from ..sources.places import spread

_TYPES = {"record": "string"} | {c.split()[0]: c.split()[1] for table in parsers.TABLES.values() for c in table.split(", ")}
RECORD = ", ".join(f"{c} {t}" for c, t in _TYPES.items())
_COLUMNS = list(_TYPES)


def parse(files: DataFrame, known: parsers.Registry | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Records of files (rel_path, content): nodes with their source lines, edges, references and errors. Parsers are those that are
    registered on the driver now, or the ones given; they go to the workers with the tasks. With `kinds`, records of these alone leave the workers."""
    registered, asked = parsers.registry() if known is None else dict(known), frozenset(kinds or parsers.TABLES)
    arrow = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    layout = pa.schema([(c, arrow[t]) for c, t in _TYPES.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_pylist([{"record": kind, **values} for path, content in found for kind, values in parsers.records(path, content, registered) if kind in asked], layout)

    return spread(files.select("rel_path", "content"), "rel_path").mapInArrow(run, RECORD)


def errors(records: DataFrame) -> DataFrame:
    """(file_path, error) of the files that their parsers could not read."""
    return records.where("record = 'error'").select("file_path", "error")


def inventory(files: DataFrame, repo: str, root: str) -> DataFrame:
    """A node for each file, unread: level `low`."""
    path = F.col("rel_path")
    values = {
        "id": F.concat(F.lit(f"{repo}::"), path, F.lit(":FILE:"), path, F.lit(":0")), "type": F.lit("FILE"), "name": T.base_name(path), "file_path": path, "start_line": F.lit(1), "end_line": F.lit(1), "hash": F.lit(""),
        "qualified_name": T.base_name(path), "language": F.lit(""), "index_level": F.lit("low"), "repo_name": F.lit(repo), "repo_path": F.lit(root), "source_code": F.lit(""), "first_line": F.lit(""), "documentation": F.lit(""),
    }
    return files.select(*[v.alias(k) for k, v in values.items()])


def build(records: DataFrame, repo: str, root: str = "", level: str = "high", imports: bool = False, config_reads: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a repository from its records, with the references resolved.

    Edges of imports, and reads of configuration, have names for targets; neither is kept unless asked for, and then as they are.
    """
    found = records.where("record = 'node'").select(*[c for c in _COLUMNS if c in schema.NODES])
    named = found.withColumns({"id": F.concat(F.lit(f"{repo}::"), "id"), "repo_name": F.lit(repo), "repo_path": F.lit(root), "index_level": F.lit(level)})
    nodes = filters.level_nodes(named, level).select(*[c.split()[0] for c in schema.NODES.split(", ")])
    raw = filters.level_edges(resolve.globalise(records.where("record = 'edge'").select("source", "target", "type", "confidence", "resolution", "source_line"), repo), level)
    out = resolve.structural_edges(raw.where("type NOT IN ('CALLS', 'READS_CONFIG')"), nodes)
    kinds = [c.split()[0] for c in schema.EDGES.split(", ")]
    out = out.select(*kinds)
    callers = nodes.select(F.col("id").alias("source"), "file_path", "repo_name")
    calls = raw.where("type = 'CALLS'").withColumnRenamed("target", "target_name").join(callers.hint("merge"), "source")
    out = out.unionByName(resolve.resolve_calls(calls, nodes).select(*kinds))
    refs = records.where("record = 'ref' AND kind <> 'import'").select(F.concat(F.lit(f"{repo}::"), "source_id").alias("source"), "target_name", F.upper("kind").alias("type"), F.lit(repo).alias("repo_name"))
    linked = resolve.resolve_unique(filters.level_edges(refs, level), nodes).withColumn("source_line", F.lit(None).cast("int"))
    out = out.unionByName(linked.select(*kinds))
    if config_reads:
        out = out.unionByName(raw.where("type = 'READS_CONFIG'").select(*kinds))
    if imports:
        read = records.where("record = 'ref' AND kind = 'import'").select(F.concat(F.lit(f"{repo}::"), "source_id").alias("source"), F.col("target_name").alias("target"), F.lit("IMPORTS").alias("type"), F.lit(1.0).alias("confidence"), F.lit("ast").alias("resolution"), F.lit(None).cast("int").alias("source_line"))
        out = out.unionByName(read.select(*kinds))
    return nodes, out
