"""Queries of this subpackage over the synthetic tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import jaccard, sql
from wordloom.llm.common import table
from wordloom.llm.chat import digest, format_turns
from wordloom.llm.hamming import top_k
from wordloom.llm.hard_negatives import mine
from wordloom.llm.language_id import identify
from wordloom.llm.mixing import mix_sizes
from wordloom.llm.packing import pack
from wordloom.llm.periodic_runs import find_runs, longest, planted
from wordloom.llm.quality import quality_rules
from wordloom.llm.secrets import BASE, listed, scan
from wordloom.llm.sharding import place
from wordloom.llm.token_counts import count_tokens
from wordloom.llm.url_graph import filter_urls


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns, slots: the passes and shards in which the mix has the document."""
    slots = F.array_join(F.transform("slots", lambda x: F.concat_ws(":", x["pass"], x["shard"])), ",")
    return mix_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", slots.alias("slots"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(spans, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(sql.CONTROL_TEXT))
    return digest(format_turns(turns.union(more)))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the contract's texts, every tenth of which has a repeated tail."""
    found = find_runs(planted(table(spark, sf_dir, "documents"))).withColumn("best", longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.expr("1000 * best.length DIV best.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, exponent, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"), 8)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's labels: every seventh row has the next one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_source_mix": op2_source_mix,
        "op3_quality_rules": op3_quality_rules,
        "op4_hamming_topk": op4_hamming_topk,
        "op5_ngram_join": op5_ngram_join,
        "op6_packing": op6_packing,
        "op7_token_counts": op7_token_counts,
        "op8_secret_scan": op8_secret_scan,
        "op9_chat_format": op9_chat_format,
        "op10_url_filter": op10_url_filter,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_sharding": op12_sharding,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": sql.op3(),
        "op4_hamming_topk": sql.op4(),
        "op5_ngram_join": sql.op5(),
        "op9_chat_format": sql.op9(),
        "op10_url_filter": sql.op10(),
        "op11_periodic_runs": sql.op11(),
        "op12_sharding": sql.op12(),
        "op13_hard_negatives": sql.op13(),
    }
