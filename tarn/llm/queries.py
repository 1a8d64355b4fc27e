"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import alignment, byte_pairs, decontaminate, fill_middle, language, mixing, ngram_join, pii, secrets, substrings, token_counts, toxicity, winnowing
from tarn.llm._spark import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    def of(f, *more: str) -> Query:
        return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"), *(table(spark, sf_dir, t) for t in more))

    return {
        "op1_winnowing": of(winnowing.digest),
        "op2_ngram_join": of(ngram_join.digest),
        "op3_secret_scan": of(secrets.digest),
        "op4_mixing": of(mixing.digest),
        "op5_token_counts": of(token_counts.digest),
        "op6_pii": of(pii.digest),
        "op7_toxicity": of(toxicity.digest, "labels"),
        "op8_substring_dedup": of(substrings.digest),
        "op9_decontamination": of(lambda docs, bench: decontaminate.digest(decontaminate.decontaminate(docs, bench, ["doc_id"])), "benchmark"),
        "op10_language": of(language.digest),
        "op11_byte_pairs": of(byte_pairs.digest),
        "op12_fill_middle": of(fill_middle.digest),
        "op13_alignment": of(alignment.digest),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": mixing.ORACLE_SQL,
        "op5_token_counts": token_counts.ORACLE_SQL,
        "op8_substring_dedup": substrings.ORACLE_SQL,
        "op9_decontamination": decontaminate.ORACLE_SQL,
        "op12_fill_middle": fill_middle.ORACLE_SQL,
    }
