"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from branchwise.llm import chat, decontaminate, fim, html_text, langid, mixing, ngram_join, quality, secret_scan, simhash, spelling, token_counts, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_html_text": html_text.op2_html_text,
        "op3_simhash": simhash.op3_simhash,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_chat_format": chat.op5_chat_format,
        "op6_secret_scan": secret_scan.op6_secret_scan,
        "op7_mixing": mixing.op7_mixing,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_quality": quality.op9_quality,
        "op10_language_id": langid.op10_language_id,
        "op11_fill_in_middle": fim.op11_fill_in_middle,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_ngram_join": ngram_join.op13_ngram_join,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chat_format": chat.ORACLE,
        "op7_mixing": mixing.ORACLE,
        "op8_url_filter": url_filter.ORACLE,
        "op11_fill_in_middle": fim.ORACLE,
    }
