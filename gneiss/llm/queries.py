"""The corpus queries, by name, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm.toxicity import op1_toxicity
from gneiss.llm.substring import op2_substring
from gneiss.llm.simhash import op3_simhash
from gneiss.llm.warc import op4_warc
from gneiss.llm.winnow import op5_fingerprints
from gneiss.llm.quality import op6_quality
from gneiss.llm.bpe import op7_byte_bpe
from gneiss.llm.decontaminate import op8_decontamination
from gneiss.llm.licenses import op10_licenses
from gneiss.llm.sharding import op9_sharding
from gneiss.llm.lines import op11_line_dedup
from gneiss.llm.middle import op12_fill_in_middle
from gneiss.llm.audit import op13_filter_audit
from gneiss.llm.sql import ORACLE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_substring": op2_substring,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_fingerprints": op5_fingerprints,
    "op6_quality": op6_quality,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_decontamination": op8_decontamination,
    "op9_sharding": op9_sharding,
    "op10_licenses": op10_licenses,
    "op11_line_dedup": op11_line_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_filter_audit": op13_filter_audit,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
