"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from evalloom.llm import (
    contamination,
    exact_dedup,
    filter_audit,
    language,
    line_dedup,
    mixing,
    quality,
    simhash,
    substring,
    topk,
    toxicity,
    warc,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_language": language.op5_language,
    "op6_top_products": topk.op6_top_products,
    "op7_quality": quality.op7_quality,
    "op8_simhash": simhash.op8_simhash,
    "op9_decontaminate": contamination.op9_decontaminate,
    "op10_substring_dedup": substring.op10_substring_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_whitening": whitening.op12_whitening,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op1_warc": warc.SQL,
    "op2_mix_sources": mixing.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op6_top_products": topk.SQL,
    "op9_decontaminate": contamination.SQL,
    "op10_substring_dedup": substring.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op13_exact_dedup": exact_dedup.SQL,
}
