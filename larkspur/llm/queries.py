"""Registered queries of the subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import alignment, chat, decontaminate, interactions, language, line_dedup, minhash, packing, pages, pii, quality, sentence_dedup, substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontaminate.query,
    "op2_language": language.query,
    "op3_line_dedup": line_dedup.query,
    "op4_quality": quality.query,
    "op5_chat": chat.query,
    "op6_minhash": minhash.query,
    "op7_pii": pii.query,
    "op8_sentence_dedup": sentence_dedup.query,
    "op9_packing": packing.query,
    "op10_substring_dedup": substring_dedup.query,
    "op11_filter_audit": interactions.query,
    "op12_alignment": alignment.query,
    "op13_html_extraction": pages.query,
}
ORACLES: dict[str, str] = {
    "op1_decontamination": decontaminate.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op5_chat": chat.ORACLE,
    "op11_filter_audit": interactions.ORACLE,
}
