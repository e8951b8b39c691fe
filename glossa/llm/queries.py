"""The registered queries of this subpackage and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocknames, chat, decontam, fptree, html, oracle, packing, parttrie, pii, quality, secrets, simhash, toxicity, urls
from .common import table

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = urls.host_and_path(F.col("url"))
    labelled = pages.select("url", (urls.matching_rule(host, path, URL_RULES)[1] == "allow").alias("allowed"))
    return urls.judge_urls(pages, labelled, URL_RULES).drop("score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocknames.deduplicate(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parttrie.compress(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fptree.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules, "op2_url_filter": op2_url_filter, "op3_pii": op3_pii, "op4_html_text": op4_html_text, "op5_chat_format": op5_chat_format,
    "op6_packing": op6_packing, "op7_toxicity": op7_toxicity, "op8_decontaminate": op8_decontaminate, "op9_secrets": op9_secrets, "op10_simhash": op10_simhash,
    "op11_exact_dedup": op11_exact_dedup, "op12_vector_codes": op12_vector_codes, "op13_lexical_search": op13_lexical_search,
}

_CONTROL = r"(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\\)"

#: DuckDB texts of the queries that SQL can express: no trained model, tokenizer, graph cut, simhash or match positions.
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": oracle.quality_sql(),
    "op11_exact_dedup": oracle.DEDUP_SQL,
    "op12_vector_codes": oracle.codes_sql(),
    "op13_lexical_search": oracle.SEARCH_SQL,
    "op5_chat_format": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(lag(role) OVER w, 'start') AS before, lead(role) OVER w AS after FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, NOT ((role = 'user' AND before IN ('start', 'system', 'assistant')) OR (role = 'system' AND before = 'start') OR (role = 'assistant' AND before = 'user')) AS bad FROM o)
SELECT conv_id, NOT bool_or(bad) AND bool_or(after IS NULL AND role = 'assistant') AS valid, CAST(min(i) FILTER (WHERE bad) AS BIGINT) AS first_violation, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('[INST]') + length('[/INST]') + length('</s>') + length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}'))) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""",
}
