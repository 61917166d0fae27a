"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shardloom.llm import decontamination, near_dups, secrets
from shardloom.llm.html_text import op4_html_extraction
from shardloom.llm.licenses import op2_license_scans
from shardloom.llm.media import op9_media_columns
from shardloom.llm.packing import op7_packing
from shardloom.llm.quality import op5_quality_classifier
from shardloom.llm.token_counts import op1_token_counts
from shardloom.llm.toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scans": op2_license_scans,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_minhash_near_dups": near_dups.op6_minhash_near_dups,
    "op7_packing": op7_packing,
    "op10_benchmark_decontamination": decontamination.op10_benchmark_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_media_columns": op9_media_columns,
}
ORACLES: dict[str, str] = {
    "op3_secret_scans": secrets.sql(),
    "op6_minhash_near_dups": near_dups.sql(),
    "op10_benchmark_decontamination": decontamination.sql(),
}
