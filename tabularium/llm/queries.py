"""The thin query of each corpus operator: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabularium.llm.common import table


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabularium.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabularium.llm.secretscan import query

    return query(table(spark, sf_dir, "documents"))


def suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: how many words stand in passages met earlier, the ids at which these stand first, and a digest of the rest."""
    from pyspark.sql import functions as F

    from tabularium.llm.suffixes import find_repeats

    return find_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.array_join("first_docs", ",").alias("first_docs"), "kept_sha256")


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabularium.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabularium.llm.rules import judge

    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabularium.llm.urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabularium.llm.periodic import ORACLE_SQL as runs_sql
    from tabularium.llm.resampling import ORACLE_SQL as resampling_sql
    from tabularium.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabularium.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabularium.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabularium.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabularium.llm.periodic import find_runs

    return find_runs(table(spark, sf_dir, "documents"), remodel=True).drop("n_words")


def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabularium.llm.pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabularium.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity,
    "op2_secrets": secrets,
    "op3_suffixes": suffixes,
    "op4_warc": warc,
    "op5_substrings": substrings,
    "op6_decontaminate": decontaminate,
    "op7_packing": packing,
    "op8_rules": rules,
    "op9_urls": urls,
    "op10_jaccard": jaccard,
    "op11_runs": runs,
    "op12_sentencepiece": sentencepiece,
    "op13_resampling": resampling,
}


def oracle_sql() -> dict[str, str]:
    from tabularium.llm.jaccard import ORACLE_SQL as jaccard_sql
    from tabularium.llm.periodic import ORACLE_SQL as runs_sql
    from tabularium.llm.resampling import ORACLE_SQL as resampling_sql
    from tabularium.llm.substrings import ORACLE_SQL as substrings_sql
    from tabularium.llm.suffixes import ORACLE_SQL as suffixes_sql
    from tabularium.llm.urls import oracle_sql as urls_sql
    from tabularium.llm.warc import ORACLE_SQL as warc_sql

    return {"op3_suffixes": suffixes_sql, "op4_warc": warc_sql, "op5_substrings": substrings_sql, "op9_urls": urls_sql(), "op10_jaccard": jaccard_sql, "op11_runs": runs_sql, "op13_resampling": resampling_sql}
