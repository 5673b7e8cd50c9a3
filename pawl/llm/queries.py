"""The queries opN_<name> over the given tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pawl.llm import decontamination, embedding_dedup, language_id, license_scan, minhash_dedup, toxicity
from pawl.llm.bpe_codec import round_trip
from pawl.llm.common import table
from pawl.llm.sharding import interleave
from pawl.llm.token_counts import count_tokens
from pawl.llm.url_filter import judge, rules_frame

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of the vectors at cosine 0.93; odd vectors link with nothing."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of each whole text; null and empty texts have the score of the bias."""
    held_out = language_id.held_out_id("doc_id", 5, 0)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.rate(docs.select("doc_id", held_out.alias("held_out"), "text"), model, carry=["doc_id", "held_out"])


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of each url; null and odd urls have an empty host and path, so no rule."""
    return judge(table(spark, sf_dir, "pages"), rules_frame(spark, URL_RULES))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named or quoted in each whole text; null and empty texts have none."""
    return license_scan.flat(license_scan.scan(table(spark, sf_dir, "documents"), license_scan.all_templates(), carry=["doc_id"], windows=True))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in each whole text; null texts have no words."""
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, carry=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of each whole text; a null text is an empty one."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, limit=1024)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies at similarity 0.85 of three-word sets; texts without words are alone."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's place in 24 shards of equal row counts; null ids, texts and sources are dealt too."""
    return interleave(table(spark, sf_dir, "documents"), n_shards=24)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each whole text; `und` for a null text and one without letters."""
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.held_out_id("doc_id", 3, 1)
    models = language_id.fit(docs, ~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    found = language_id.identify(rows, models, carry=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected", F.round("bits_per_char", 6).alias("bits_per_char"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each whole text and what they decode to, as digests; a null text is an empty one."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


OP3_SQL = """
WITH rules(verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS tail
  FROM pages),
raw AS (SELECT page_id, tail, regexp_extract(tail, '^[^/?#]*') AS raw_host FROM cut),
parsed AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(tail, length(raw_host) + 1), '^[^?#]*') AS path
  FROM raw),
fits AS (
  SELECT u.host, u.path, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.host, u.path
                            ORDER BY length(r.rule_host) + length(r.rule_path) DESC, length(r.rule_host) DESC) AS nth
  FROM (SELECT DISTINCT host, path FROM parsed) u JOIN rules r
    ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN (SELECT * FROM fits WHERE nth = 1) f ON p.host = f.host AND p.path = f.path
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op3_url_filter": OP3_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
