"""The numbered queries over the corpus tables; the SQL that some of them can be held against is in sql.py."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from estatelens.llm import conversations, decontam, encoding, flatids, licenses, linededup, media, pii, quality, runs, simhash, tokencounts, toxicity
from estatelens.llm.common import table
from estatelens.llm.sql import ORACLES
from estatelens.storage import scratch


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op4_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "matches")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencounts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_flat_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "flat-ids")
    docs = table(spark, sf_dir, "documents")
    flatids.write_ids(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return flatids.read_ids(spark, folder)


def op11_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.fit(docs)).drop("text")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(table(spark, sf_dir, "documents"), changed=True)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(conversations.damage(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe_round_trip, op2_media_columns, op3_decontamination, op4_license_templates, op5_toxicity, op6_line_dedup, op7_token_counts, op8_personal_data, op9_simhash, op10_flat_ids, op11_weak_supervision, op12_periodic_runs, op13_conversation_repair)
}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in ORACLES.items() if name in QUERIES}
