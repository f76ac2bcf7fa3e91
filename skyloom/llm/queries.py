"""The corpus queries, by name, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import chat_format, decontaminate, html_text, ngram_join, packing, quality_classifier, quality_rules, secret_scan, sharding, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": chat_format.query,
        "op2_packing": packing.query,
        "op3_html_text": html_text.query,
        "op4_url_filter": url_filter.query,
        "op5_ngram_join": ngram_join.query,
        "op6_sharding": sharding.query,
        "op7_decontaminate": decontaminate.query,
        "op8_secret_scan": secret_scan.query,
        "op9_quality_classifier": quality_classifier.query,
        "op10_quality_rules": quality_rules.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat_format.SQL}
