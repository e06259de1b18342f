"""The tools of the server as methods that return DataFrames, and `ask`, which gives a tool's text."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import embed
from ..operators import filters, intervals, resolve, search, stats, upsert
from ..operators.fields import FieldIndex
from ..operators.vector_index import VectorIndex
from ..sources import scan
from ..sources.graph_store import GraphStore
from ..sources.journal import Journal
from . import diagnose, index, replies, retrieve

_TABLES = {"nodes": schema.NODES, "edges": schema.EDGES, "embeddings": "id string, embedding array<float>", "postings": schema.POSTINGS, "corpora": schema.CORPORA}
#: Tables that grow by rows, with their keys and whether a write leaves the fields that it lacks. A link has the repository of the node that it leads to, and none where it leads to an entity.
_GROWING = {"findings": (schema.FINDINGS, ["id"], True), "incidents": (schema.INCIDENTS, ["id"], True), "entities": (schema.ENTITIES, ["id"], False), "links": ("source string, target string, type string, repo string", ["source", "target", "type", "repo"], False), "evaluations": (schema.EVALUATIONS, ["id"], True), "cleared": ("repo string", ["repo"], False)}
MAX_NODES, MAX_LINES = 10, 100


class CodeGraph:
    def __init__(self, spark: SparkSession, folder: str, counter: replies.Counter | None = None, analyse: Callable[[str], str] | None = None) -> None:
        """`counter` counts the tokens of requests and replies, `analyse` is asked for a cause; neither is there by default."""
        self.spark, self.store, self.counter, self.analyse = spark, GraphStore(spark, folder), counter, analyse
        self.journal = Journal(spark, f"{self.store.folder}/journal")
        self.vectors: VectorIndex | None = None
        self.texts: FieldIndex | None = None

    def table(self, name: str, repo: str | None = None) -> DataFrame:
        """A table, or a repository's part of it; of what grows by rows, the last row of each key."""
        if name in _TABLES:
            return self.store.read(name, _TABLES[name], repo)
        if name == "links":
            return self._links()
        return self.journal.last(name, *_GROWING[name])

    def _links(self) -> DataFrame:
        """The links of incidents, but for those to nodes of a repository that was indexed anew after them."""
        made, cleared = (self.journal.rows(name, _GROWING[name][0]) for name in ("links", "cleared"))
        last = cleared.groupBy("repo").agg(F.max("ordinal").alias("_cleared"))
        return made.join(last, "repo", "left").where("_cleared IS NULL OR ordinal > _cleared").select("source", "target", "type").distinct()

    def compact(self) -> None:
        """Puts the writes of each growing table together, when no question is being answered."""
        for name, grown in _GROWING.items():
            self.journal.compact(name, *grown)

    # --- indexing ---------------------------------------------------------------------------------------------------

    def index_repo(self, root: str, repo: str, level: str = "high", extensions: list[str] | None = None, ignore: list[str] | None = None, embedder: str | None = None) -> DataFrame:
        """Reads a source tree in place of what was known of the repository; a row of counts."""
        dims = self.dimensions()
        if level != "low" and dims is not None and dims != (own := embed.dimensions(embedder)):
            raise ValueError(f"the stored embeddings have {dims} dimensions, the embedder {own}: reset the index first")
        counts = stats.IndexCounts(schema.LEVEL_EDGES[level])
        files = counts.files(scan.scan(self.spark, root, extensions, ignore))
        if level == "low":
            nodes, edges = index.inventory(files, repo, root), self.spark.createDataFrame([], schema.EDGES)
        else:
            self.store.write("records", counts.records(index.parse(files)), repo)
            nodes, edges = index.build(self.store.read("records", index.RECORD, repo), repo, root, level)
        # Incidents and findings stay, their edges to nodes of the old state go.
        self.journal.append("cleared", self.spark.createDataFrame([(repo,)], "repo string"))
        self.store.write("nodes", counts.nodes(nodes), repo)
        self.store.write("edges", edges, repo)
        own = self.store.read("nodes", schema.NODES, repo)
        self.store.write("embeddings", embed.embed_nodes(own, level, embedder), repo)
        text = retrieve.node_document()
        self.store.write("postings", search.postings(own, "id", text).sortWithinPartitions("term"), repo)
        self.store.write("corpora", search.corpus(own, text), repo)
        self.vectors = self.texts = None
        return counts.row(self.spark)

    def index_github(self, url: str, folder: str, present: bool = False, run=None) -> DataFrame:
        """Clones or pulls a repository with `run(command)`, then reads it."""
        if run is None:
            raise ValueError("no way to run git is given")
        run(scan.clone_command(url, folder, present))
        return self.index_repo(folder, scan.parse_repository(url)[1])

    def index_errors(self, repo: str | None = None) -> DataFrame:
        """(file_path, error) of the files that could not be parsed when they were last read."""
        return index.errors(self.store.read("records", index.RECORD, repo))

    def embeddings_of(self, repo: str) -> int:
        return self.store.read("embeddings", _TABLES["embeddings"], repo).count()

    def dimensions(self) -> int | None:
        """The dimensions of the stored embeddings; None where there are none."""
        row = self.table("embeddings").where("embedding IS NOT NULL").select(F.size("embedding")).first()
        return row[0] if row else None

    def build_vector_index(self, cells: int | None = None) -> VectorIndex:
        """Indexes the stored embeddings; questions are answered from there until something is indexed anew."""
        self.vectors = VectorIndex.build(self.table("embeddings"), f"{self.store.folder}-vectors/{uuid.uuid4().hex}", cells)
        return self.vectors

    def build_text_index(self) -> FieldIndex:
        """Indexes five fields of all nodes; questions are answered from there until something is indexed anew."""
        self.texts = FieldIndex.build(self.table("nodes"), f"{self.store.folder}-texts/{uuid.uuid4().hex}")
        return self.texts

    def reset_index(self) -> None:
        self.vectors = None
        self.store.drop("embeddings")

    # --- queries ----------------------------------------------------------------------------------------------------

    def query_codebase(self, question: str | None = None, symbol: str | None = None, file_path: str | None = None, node_type: str | None = None, depth: int = 1, limit: int = 4, repo: str | None = None, embedder: str | None = None) -> DataFrame:
        if depth < 0 or limit < 0:
            raise ValueError("depth and limit must not be negative")
        nodes, edges = self.table("nodes", repo), self.table("edges", repo)
        vector = embed.embed_query(question, embedder) if question else None
        seeds = retrieve.seeds(nodes, self.vectors or self.table("embeddings"), question, symbol, file_path, repo, vector, self.texts or (self.table("postings", repo), self.table("corpora", repo)), self.table("nodes"))
        return retrieve.retrieve(nodes, edges, *seeds, depth, limit, repo, node_type)

    def get_nodes_context(self, probes: list[tuple[str, int]], repo: str | None = None, max_lines: int = 20) -> DataFrame:
        """The best node at each (file, line), at most ten of them; a row that is not found stays."""
        if len(probes) > MAX_NODES or not 1 <= max_lines <= MAX_LINES:
            raise ValueError(f"at most {MAX_NODES} places and 1 to {MAX_LINES} lines")
        asked = self.spark.createDataFrame([(i, f, n) for i, (f, n) in enumerate(probes)], "probe int, file_hint string, line int")
        nodes = self.table("nodes", repo)
        found = intervals.batch_lookup(nodes, asked)
        body = F.array_join(F.slice(F.split(F.coalesce("source_code", F.lit("")), "\n", -1), 1, max_lines), "\n")
        known = filters.project(nodes).drop("source_code", "repo_path", "hash").join(nodes.select("id", body.alias("source")), "id")
        return found.join(known, "id", "left").orderBy("probe")

    def get_node_context(self, file: str, line: int, repo: str | None = None, max_lines: int = 20) -> DataFrame:
        return self.get_nodes_context([(file, line)], repo, max_lines)

    def get_stats(self) -> DataFrame:
        return stats.repo_stats(self.table("nodes"))

    def edge_total(self) -> DataFrame:
        """All relationships, those of findings and incidents too."""
        return self.table("edges").select("type").unionByName(self.table("links").select("type")).agg(F.count("*").alias("edges"))

    # --- incidents and evaluations ------------------------------------------------------------------------------------

    def diagnose_issue(self, question: str, repo: str | None = None, embedder: str | None = None, **where) -> diagnose.Context:
        affects = self.table("links").where("type = 'AFFECTS'")
        return diagnose.context(self.table("nodes", repo), self.table("edges", repo), self.table("findings"), affects, self.table("incidents"), question, self.vectors or self.table("embeddings"), embed.embed_query(question, embedder) if question else None, repo, **where)

    def ingest_incident_evidence(self, incident: dict, file: str | None = None, line: int | None = None) -> None:
        """Stores an incident, its entities and links; a file and line link it to the node there."""
        linked = list(incident.get("linked_ids") or [])
        if file and line:
            linked += [r["id"] for r in self.get_node_context(file, line, incident.get("repo_name")).collect() if r["id"]]
        fields = [c.split()[0] for c in schema.INCIDENTS.split(", ")]
        new = self.spark.createDataFrame([tuple({**incident, "linked_ids": linked}.get(c) for c in fields)], schema.INCIDENTS)
        self.add_incidents(new, self.table("nodes").where(F.col("id").isin(linked)))

    def add_incidents(self, incidents: DataFrame, nodes: DataFrame | None = None) -> None:
        """Stores any number of incidents, their entities and links by appending them; `nodes` are those that they may be linked with, all by default."""
        nodes = self.table("nodes") if nodes is None else nodes
        entities, links = upsert.evidence_entities(incidents)
        places = nodes.select(F.col("id").alias("target"), F.col("repo_name").alias("repo"))
        affected = resolve.link_evidence(incidents, nodes).join(places, "target").select("source", "target", "type", "repo")
        self.journal.append("entities", entities)
        self.journal.append("links", links.withColumn("repo", F.lit(None).cast("string")).unionByName(affected))
        self.journal.append("incidents", incidents)

    def add_findings(self, findings: DataFrame, repo: str) -> None:
        none = self.spark.createDataFrame([], schema.FINDINGS)
        self.journal.append("findings", upsert.merge_findings(none, findings, self.table("nodes"), repo))

    def record_evaluation(self, evaluation: dict) -> None:
        fields = [c.split()[0] for c in schema.EVALUATIONS.split(", ")]
        self.journal.append("evaluations", self.spark.createDataFrame([tuple(evaluation.get(c) for c in fields)], schema.EVALUATIONS))

    def get_evaluation_metrics(self, repo: str | None = None) -> str:
        return json.dumps(stats.evaluation_metrics(self.table("evaluations"), repo).first().asDict())

    # --- text ---------------------------------------------------------------------------------------------------------

    def ask(self, tool: str, **params) -> replies.Reply:
        """A tool's reply as text, with what it costs where there is a counter."""
        tools = {
            "index_repo": self._index_text, "index_github": self._github_text, "query_codebase": lambda **p: replies.results(self.query_codebase(**p), p.get("repo")),
            "get_node_context": lambda **p: replies.node(self.get_node_context(**p)), "get_nodes_context": lambda **p: replies.nodes(self.get_nodes_context(**p)),
            "diagnose_issue": self._diagnosis_text, "ingest_incident_evidence": self._evidence_text, "record_evaluation": self._evaluation_text,
            "get_evaluation_metrics": self.get_evaluation_metrics, "get_stats": lambda: replies.statistics(self.get_stats(), self.edge_total().first()["edges"], self.store.folder),
        }
        if tool not in tools:
            raise ValueError(f"no such tool: {tool}")
        counted = self.counter if tool in ("query_codebase", "get_node_context", "get_nodes_context", "diagnose_issue") else None
        return replies.reply(tools[tool](**params), replies.request_json(**{k: v for k, v in params.items() if not callable(v)}), counted)

    def _index_text(self, **params) -> str:
        done = self.index_repo(**params).first()
        return f"Indexed {params['repo']}: {done['files_scanned']} files · {done['nodes_found']} nodes · {done['edges_found']} edges · {self.embeddings_of(params['repo'])} embeddings"

    def _github_text(self, **params) -> str:
        done, repo = self.index_github(**params).first(), scan.parse_repository(params["url"])[1]
        return f"Indexed {repo}: {done['files_scanned']} files · {done['nodes_found']} nodes · {done['edges_found']} edges · {self.embeddings_of(repo)} embeddings"

    def _diagnosis_text(self, question: str, repo: str | None = None, embedder: str | None = None, runtime: str | None = None, **where) -> str:
        context = self.diagnose_issue(question, repo, embedder, **where)
        prompt = diagnose.prompt(context, question, where.get("error"), where.get("trace"), runtime) if self.analyse else ""
        return replies.diagnosis(context, self.analyse, prompt)

    def _evidence_text(self, incident: dict, file: str | None = None, line: int | None = None) -> str:
        self.ingest_incident_evidence(incident, file, line)
        found = self.get_node_context(file, line, incident.get("repo_name")).where("found").first() if file and line else None
        return replies.stored_evidence(incident["id"], found)

    def _evaluation_text(self, evaluation: dict) -> str:
        self.record_evaluation(evaluation)
        return replies.stored_evaluation(evaluation["id"])

    format_results = staticmethod(replies.results)
    request_json = staticmethod(replies.request_json)
