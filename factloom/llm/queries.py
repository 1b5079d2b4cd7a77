"""The queries of the numbered operators, over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import (
    bpe, char_cnn, cover_tree, disclosure, latent, masked_lm, minmax, role_repair,
    rotated_codes, rule_ensemble, token_counts, token_files, url_rules,
)
from factloom.llm.batches import table

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ENGLISH_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
CONTEXT_TOKENS = 1024
URL_RULES = [
    url_rules.Rule("net/", "block"), url_rules.Rule("example.net/en/", "allow"),
    url_rules.Rule("example.com/de/", "block"), url_rules.Rule("org/fr/", "allow"),
]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, public_tokenizers.PATTERN)


def op2_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_wildcard_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


def op5_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.scores(table(spark, sf_dir, "documents"))


def op6_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_codes.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[_count("base", k).alias(f"n_{k}") for k in disclosure.KINDS],
        F.sha2(_spans("base"), 256).alias("base_sha256"), _spans("spans").alias("spans"),
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(table(spark, sf_dir, "documents"), WORD_VOCABULARY, END_ID)
    return token_files.digests(path, spark, "bigint").withColumnRenamed("key", "doc_id")


def op9_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _spans(column: str, kinds: tuple[str, ...] | None = None):
    """kind:start:end of findings in their order, comma-joined; of some kinds, or all."""
    held = F.col(column) if kinds is None else F.filter(column, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(held, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _count(column: str, kind: str):
    return F.size(F.filter(column, lambda x: x["kind"] == kind)).cast("long")


def op10_char_cnn_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = char_cnn.find(docs, char_cnn.learn(docs)).drop("text")
    return found.select(
        "doc_id", *[_count("secrets", k).alias(f"n_{k}") for k in char_cnn.KINDS],
        F.sha2(_spans("secrets", char_cnn.KINDS), 256).alias("base_sha256"), _spans("secrets").alias("spans"),
    )


def op11_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), ENGLISH_VOCABULARY, CONTEXT_TOKENS)


def op12_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.hard_negatives(
        table(spark, sf_dir, "embeddings"), anchor_step=50, positives=5, negatives=3, low_percent=50, high_percent=95, moved=7, classes=10
    )


def op13_glr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.repair(role_repair.damaged(table(spark, sf_dir, "conversations")), there="there")


def queries() -> dict:
    numbered = {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}
    return numbered | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op12_cover_tree_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
          FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
          FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id,
          row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
          vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3""",
        "op3_wildcard_urls": """
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r(rule, verdict, h, p) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
          ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/'))
        SELECT page_id, host, path, arg_max(r.rule, length(r.rule)) AS rule,
          coalesce(arg_max(r.verdict, length(r.rule)), 'allow') AS verdict
        FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
        GROUP BY page_id, host, path"""}
