"""The registered queries opN_<name>: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import chat_format, decontaminate, exact_dedup, html_text, license_scan, mix_sources, near_dedup, ppm, secret_scan, source_divergence, substring_dedup, toxicity, vector_codes


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", "source")
    return mix_sources.mix(docs)


def op2_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, d, "documents").select("doc_id", "text"), _read(spark, d, "benchmark"))


def op3_chat_format(spark: SparkSession, d: str) -> DataFrame:
    messages = _read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat_format.PLANTED).alias("text"))
    events = chat_format.as_events(messages.unionByName(planted))
    return chat_format.digest(chat_format.render(chat_format.reconstruct(events)))


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", "text")
    out = toxicity.held_out()
    model = toxicity.train(docs, _read(spark, d, "labels").filter(~out))
    scored = toxicity.score(docs.select("doc_id", out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    got = exact_dedup.exact_groups(_read(spark, d, "documents"), keep="max")
    return got.select("doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), "kept", "text_sha256")


def op6_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, d, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size", "n_texts")


def op7_html_text(spark: SparkSession, d: str) -> DataFrame:
    got = html_text.extract(_read(spark, d, "pages").select("page_id", "url", "html"), out_col="text")
    return got.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op8_ppm(spark: SparkSession, d: str) -> DataFrame:
    return ppm.score(_read(spark, d, "documents").select("doc_id", "text"))


def op9_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_read(spark, d, "documents")))


def op10_license_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", "text")
    return license_scan.report(license_scan.scan(docs))


def op11_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    got = substring_dedup.remove_repeats(_read(spark, d, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, d: str) -> DataFrame:
    got, books = vector_codes.compress(_read(spark, d, "embeddings"))
    sha = F.sha2(F.lit(vector_codes.codebooks_text(books)), 256)
    return got.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", sha.alias("codebooks_sha256"))


def op13_source_divergence(spark: SparkSession, d: str) -> DataFrame:
    return source_divergence.audit(_read(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_decontaminate, op3_chat_format, op4_toxicity, op5_exact_dedup, op6_near_dedup, op7_html_text, op8_ppm, op9_secret_scan, op10_license_scan, op11_substring_dedup, op12_vector_codes, op13_source_divergence)}


OP5_SQL = """WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mix_sources.oracle(), "op3_chat_format": chat_format.oracle(), "op5_exact_dedup": OP5_SQL, "op9_secret_scan": secret_scan.oracle(), "op10_license_scan": license_scan.oracle(), "op12_vector_codes": vector_codes.oracle(), "op13_source_divergence": source_divergence.oracle()}
