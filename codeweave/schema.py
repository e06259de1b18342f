"""Tables of the code graph."""

from __future__ import annotations

NODES = (
    "id string, type string, name string, file_path string, start_line int, end_line int, hash string, qualified_name string, language string, "
    "index_level string, repo_name string, repo_path string, source_code string, first_line string, documentation string"
)
EDGES = "source string, target string, type string, confidence double, resolution string, source_line int"
REFS = "kind string, source_id string, target_name string"
FINDINGS = "id string, node_id string, rule_id string, severity string, message string, file_path string, line int, repo_name string"
INCIDENTS = (
    "id string, summary string, repo_name string, source string, observed_at string, service string, environment string, route string, trace_id string, "
    "deployment_id string, version string, dependency string, linked_ids array<string>"
)
EVALUATIONS = (
    "id string, repo_name string, incident_id string, made_causal_claim boolean, resolved_correctly boolean, expected_cause_identified boolean, "
    "supported_by_evidence boolean, latency_ms double, cost_usd double"
)
#: The full-text index: a row for each term of a node, and what each repository's texts come to.
POSTINGS = "id string, term string, tf long, len int"
CORPORA = "docs long, words long"
ENTITIES = "id string, label string, name string, version string"

#: Columns that queries return of a node; the embedding is a table of its own, `node_embeddings(id, embedding)`.
PROJECTION = [c.split()[0] for c in NODES.split(", ") if c.split()[0] != "index_level"]

NODE_TYPES = ["FILE", "CLASS", "INTERFACE", "METHOD", "FUNCTION"]
RESULT_TYPES = ["METHOD", "FUNCTION"]
#: What each level of indexing keeps (fixed values).
LEVEL_NODES = {"low": ["FILE"], "med": ["FILE", "CLASS", "INTERFACE"], "high": ["FILE", "CLASS", "INTERFACE", "METHOD", "FUNCTION"]}
LEVEL_EDGES = {
    "low": [],
    "med": ["CONTAINS", "DEFINES", "IMPORTS", "EXTENDS", "IMPLEMENTS"],
    "high": ["CONTAINS", "DEFINES", "IMPORTS", "CALLS", "EXTENDS", "IMPLEMENTS", "INJECTS", "READS_CONFIG", "READS_FIELD"],
}
LEVEL_EMBEDS = {"low": [], "med": ["CLASS", "INTERFACE"], "high": ["METHOD", "FUNCTION", "CLASS", "INTERFACE"]}
