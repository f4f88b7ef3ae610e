"""The registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.llm import conversations, decontaminate, exact, licenses, lines, mixing, neardup, phrases, pii, quality, sql, tokens, urls, warc
from meterflow.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql_text: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql_text is not None:
            ORACLES[name] = sql_text
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_exact_dedup", sql.EXACT_DEDUP)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest").withColumnRenamed("id", "doc_id")


def _joined(spans: Column) -> Column:
    part = lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, part), ",")


@query("op6_personal_data", sql.PERSONAL_DATA)
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [k.name for k in pii.KINDS]
    spans = found.select("doc_id", *[f"{k}_spans" for k in kinds])
    return spans.select(
        "doc_id",
        *[F.size(f"{k}_spans").cast("long").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(_joined(F.flatten(F.array(*[f"{k}_spans" for k in pii.BASE]))), 256).alias("base_sha256"),
        _joined(F.flatten(F.array(*[f"{k}_spans" for k in kinds]))).alias("spans"),
    )


@query("op7_mix_sources", sql.MIX_SOURCES)
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op8_url_filter")
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@query("op9_license_scan", sql.LICENSE_SCAN)
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.document_licences(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op5_decontaminate", sql.DECONTAMINATE)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_hits(documents, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), prefixes=True, keep=["doc_id"])
    return counted.select(
        "doc_id",
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"),
        F.size("prefix_tokens").cast("long").alias("n_prefixes"),
        F.sha2(F.array_join(F.col("prefix_tokens").cast("array<string>"), ","), 256).alias("prefixes_sha256"),
        F.coalesce(F.get("prefix_ends", tokens.fitting_words(2048) - 1), F.lit(0)).cast("long").alias("bytes_within_limit"),
    )


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(documents, table(spark, sf_dir, "labels"))


@query("op1_line_dedup", sql.LINE_DEDUP)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op1_repeated_runs")
def op1_repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), run_words=lines.RUN_WORDS)
    return left.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op2_near_dedup", sql.NEAR_DEDUP)
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumnRenamed("id", "doc_id")


@query("op11_conversation_repair", sql.CONVERSATION_REPAIR)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.repaired_digests(turns, there=F.col("there"))


@query("op12_warc", sql.WARC)
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    records = warc.read_warc(spark, path)
    page = lambda c: F.regexp_extract(c, "^urn:row:(.+)$", 1).try_cast("long")
    held = F.col("payload").isNotNull()
    return records.select(
        page("record_id").alias("page_id"),
        F.when(held, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(held, warc.base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


@query("op13_phrases", sql.PHRASES)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))
