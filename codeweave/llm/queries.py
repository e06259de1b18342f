"""The registered queries of this subpackage, with the parameters of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, jaccard_join, learned_partitions, legacy_archive, metric_tree, mixing, packing, repeats, secrets, shared, simhash_trees, spelling, token_stream, toxicity


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_stream.stream(_read(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    counted = shared.kept(docs.select("doc_id", "lang", "source", mixing.n_words(F.col("text")).alias("n_words"), F.md5(F.col("text").cast("binary")).alias("text_md5")), "counted")
    mixed = mixing.mix(counted, mixing.tree(), mixing.WEIGHTS, budget=0.6, epochs=4, seed=17, tokens="n_words", tie="text_md5")
    return mixed.select("doc_id", "mix_domain", "mix_lang", "mix_source", "mix_epoch", "n_tokens", "take_tokens")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_read(spark, sf_dir, "documents"), k=4, percent=85)


def op4_secret_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return secrets.digest(docs, secrets.fit(docs))


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.nearest(_read(spark, sf_dir, "embeddings"), every=50, k=5)


def op6_legacy_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy_archive.archive(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _read(spark, sf_dir, "labels")), threshold=0.3)


def op8_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.top_k(_read(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary(), end_id=1, window=2048)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(_read(spark, sf_dir, "documents"), window=20).drop("kept")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trees.dedup(_read(spark, sf_dir, "documents"), k=3, radius=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_stream": op1_token_stream,
    "op2_mixing": op2_mixing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_secret_models": op4_secret_models,
    "op5_learned_partitions": op5_learned_partitions,
    "op6_legacy_archive": op6_legacy_archive,
    "op7_toxicity": op7_toxicity,
    "op8_metric_tree": op8_metric_tree,
    "op9_packing": op9_packing,
    "op10_repeats": op10_repeats,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_filter_audit": op12_filter_audit,
    "op13_simhash_trees": op13_simhash_trees,
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = "[^\\x20\\x09-\\x0D]+"

#: Links by counting common shingles, components by all that each document reaches.
_OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORDS}') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT a, y FROM reach JOIN links ON b = x)
SELECT s.doc_id, len(sh)::bigint AS n_shingles, component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = s.doc_id"""

#: Base 32 from the digest's 40 hexadecimal digits, four letters for five of them.
_OP6 = """WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::bigint AS payload_bytes, max(page_id) OVER (PARTITION BY body) AS first_page,
  list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform(range(0, 4), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (1 + 5 * g)::bigint, 5))::bigint >> (15 - 5 * k)::integer) & 31), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_page THEN first_page END AS refers_to FROM d"""

_OP8 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS g FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.g, c.g)::bigint AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.g) = len(c.g) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::integer AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

#: Windows as text, so that equal ones are equal words.
_OP10 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w),
k AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS start, unnest(list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i:i + 19], ' '))) AS words FROM w WHERE len(ws) >= 20),
later AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY words ORDER BY doc_id, start) AS r FROM k) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM later),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::bigint AS n_words, (len(ws) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

ORACLES: dict[str, str] = {"op2_mixing": mixing.ORACLE, "op3_jaccard_join": _OP3, "op6_legacy_archive": _OP6, "op8_metric_tree": _OP8, "op10_repeats": _OP10, "op11_spelling_variants": spelling.ORACLE, "op12_filter_audit": filter_audit.ORACLE}
