"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillstrata.llm import (
    alignment,
    ball_tree,
    bpe,
    licenses,
    line_templates,
    merkle,
    mixing,
    simhash,
    substrings,
    suffix_quality,
    surrogates,
    token_files,
    url_rules,
)
from skillstrata.llm.common import qualified, stored, table
from skillstrata.session import scratch

Query = Callable[[SparkSession, str], DataFrame]


PII_KEY = "corpus-key-1"  # a deployment passes its own secret


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(documents, mixing.cycled_weights(documents, (3.0, 1.0, 2.0)), share=1.5, most=2)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_templates.drop_templates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = qualified(spark, scratch(spark, "tokens"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_files.write(documents, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    read = token_files.read(spark, folder, manifest)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256")
    )


URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    altered = F.when(tampered, merkle.leaf_of(text=F.translate("text", UPPER, LOWER))).otherwise(merkle.leaf_of())
    ranked = merkle.leaves(documents, altered=altered)
    manifest = merkle.build(ranked)
    proved = manifest.prove(ranked.select("group", "rank", "doc_id", F.col("digest").alias("leaf"), "altered"))
    folded = proved.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"),
        merkle.folded(F.col("altered"), F.col("path")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), *paths)
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    aligned = stored(aligned.select("doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "links"), "aligned")
    found = alignment.scored(aligned, *paths)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Query] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_files": op6_token_files,
    "op7_bpe": op7_bpe,
    "op8_url_rules": op8_url_rules,
    "op9_quality_rules": op9_quality_rules,
    "op10_top_k": op10_top_k,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_token_alignment": op13_token_alignment,
}

OP8_SQL = r"""
WITH rules(host, path, verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
           ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), parts AS (
    SELECT row_number() OVER () AS place, page_id,
           translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), best AS (
    SELECT place, arg_max(rules.host || rules.path, [length(rules.host || rules.path), length(rules.host)]) AS rule,
           arg_max(verdict, [length(rules.host || rules.path), length(rules.host)]) AS verdict
    FROM parts JOIN rules
      ON ('.' || parts.host LIKE '%.' || rules.host) AND starts_with(parts.path, rules.path)
    GROUP BY place
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (place)
"""

OP10_SQL = """
WITH wanted AS (
    SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM wanted q JOIN wanted c ON q.vec_id % 20 = 0 AND q.place <> c.place
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""

MERKLE_LEVELS = 6  # of the SQL alone: up to 16**6 rows a source and as many sources


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR END"


def _merkle_levels_sql(tree: str) -> str:
    """CTEs ``<tree>1`` and so on over ``<tree>0(g, idx, h)``: a level's nodes, and the runs ``<tree>_runs0`` and so on below them."""
    parts = []
    for k in range(MERKLE_LEVELS):
        counted = f"(SELECT *, count(*) OVER (PARTITION BY g) > 1 AS several FROM {tree}{k})"
        parts.append(f"{tree}_runs{k} AS (SELECT g, idx // 16 AS idx, list(h ORDER BY idx) AS hs, any_value(several) AS several FROM {counted} GROUP BY ALL)")
        parts.append(f"{tree}{k + 1} AS (SELECT g, idx, CASE WHEN several THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {tree}_runs{k})")
    return ",\n".join(parts)


def _merkle_folds_sql(tree: str, fold: str) -> str:
    """CTEs ``<fold>1`` and so on over ``<fold>0(place, g, idx, node, proof)``: a leaf's way up the tree."""
    parts = []
    left, right = "array_to_string(hs[1 : f.idx % 16], '')", "array_to_string(hs[f.idx % 16 + 2 :], '')"
    for k in range(MERKLE_LEVELS):
        node = f"CASE WHEN several THEN sha256({left} || node || {right}) ELSE node END AS node"
        proof = f"CASE WHEN several THEN proof || {left} || {right} ELSE proof END AS proof"
        parts.append(f"{fold}{k + 1} AS (SELECT place, f.g, f.idx // 16 AS idx, {node}, {proof} FROM {fold}{k} f JOIN {tree}_runs{k} r ON r.g = f.g AND r.idx = f.idx // 16)")
    return ",\n".join(parts)


_LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"
_FIELDS_SQL = [_field_sql(name) for name in ("doc_id", "source", "lang", "n_chars")]
OP11_SQL = f"""
WITH read AS (
    SELECT row_number() OVER () AS place, doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS g,
           sha256({" || ".join([*_FIELDS_SQL, _field_sql("text")])}) AS leaf,
           sha256({" || ".join([*_FIELDS_SQL, _field_sql(_LOWERED)])}) AS lowered,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte:
               list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y:
                   CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 5 = 0 AS tampered
    FROM documents
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM read
), source0 AS (SELECT g, idx, leaf AS h FROM ranked),
{_merkle_levels_sql("source")},
top0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, h, g AS source_key FROM source{MERKLE_LEVELS}),
{_merkle_levels_sql("top")},
low0 AS (SELECT place, g, idx, CASE WHEN tampered THEN lowered ELSE leaf END AS node, '' AS proof FROM ranked),
{_merkle_folds_sql("source", "low")},
high0 AS (SELECT place, '' AS g, t.idx, node, proof FROM low{MERKLE_LEVELS} l JOIN top0 t ON t.source_key = l.g),
{_merkle_folds_sql("top", "high")}
SELECT doc_id, leaf, t.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = r.h AS verified
FROM ranked JOIN high{MERKLE_LEVELS} f USING (place) JOIN top0 t ON t.source_key = ranked.g, top{MERKLE_LEVELS} r
"""

ORACLE_SQL: dict[str, str] = {"op10_top_k": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op8_url_rules": OP8_SQL}
