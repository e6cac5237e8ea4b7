"""Queries op1 to op13: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm import conversations, embedding_forest, fingerprints, langid, language_model, licenses, line_dedup, merkle, mixing, ngram_join, packing, substring_dedup, token_files
from lumisift.llm.common import long_rows
from lumisift.llm.common import table as stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    long_rows(spark)
    return stored(spark, sf_dir, name)


def op1_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_forest.forest_links(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_links(table(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, weights=(5.0, 2.0, 1.0), cap=3, carry=["doc_id"])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring_dedup.drop_repeated_bytes(docs, length=400)
    left = (F.col("n_bytes") - F.col("n_removed")).alias("kept_n_bytes"), F.length(F.col("kept_bytes").cast("string")).cast("long").alias("kept_n_chars")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"), *left, (F.col("n_removed") > 0).alias("changed"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files_round_trip(table(spark, sf_dir, "documents"), end_id=1)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), length=4096, end_id=2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~langid.held_out(docs["doc_id"])))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).drop("text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repaired(conversations.damaged(turns), turns)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed=("text", F.replace("text", F.lit("\n"), F.lit(""))), changed_if=tampered)
    return found.withColumnRenamed("item", "doc_id")


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = language_model.held_out(F.col("doc_id"))
    found = language_model.scored(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {f.__name__: f for f in (op1_embedding_forest, op2_ngram_join, op3_fingerprints, op4_mixing, op5_substring_dedup, op6_token_files, op7_packing, op8_language_id, op9_line_dedup, op10_licenses, op11_conversation_repair, op12_merkle_manifest, op13_language_model)}

_KEY = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CLOSURE = """
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT x, x AS y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x),
degrees AS (SELECT x, count(*) AS n FROM edges GROUP BY x)"""

ORACLE_SQL = {
    "op1_embedding_forest": f"""
WITH RECURSIVE vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
sound AS (SELECT * FROM vectors WHERE len(v) > 0 AND len(list_filter(v, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(v, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93e0), {_CLOSURE}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN roots ON vec_id = roots.x LEFT JOIN degrees ON vec_id = degrees.x""",
    "op2_ngram_join": rf"""
WITH RECURSIVE split AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda e: e <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM both_have JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 5 * c >= 4 * (p.n + q.n - c)), {_CLOSURE}
SELECT doc_id, coalesce(root, doc_id) AS class_id, coalesce(n, 0) AS n_links, coalesce(root, doc_id) = doc_id AS kept FROM documents LEFT JOIN roots ON doc_id = roots.x LEFT JOIN degrees ON doc_id = degrees.x""",
    "op9_line_dedup": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
keyed AS (SELECT *, {_KEY} AS key FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.key = common.key GROUP BY r, doc_id""",
}
