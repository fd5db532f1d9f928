"""Queries of this subpackage, by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basalt.llm import codes, filters, language, lmscore, maintext, media, neardup, packing, repeats, subword, toxicity, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op8_lm_score": lmscore.query,
    "op9_media": media.query,
    "op10_language": language.query,
    "op1_near_duplicates": neardup.query,
    "op2_main_text": maintext.query,
    "op3_warc": warc.query,
    "op4_packing": packing.query,
    "op5_vectors": vectors.query,
    "op6_toxicity": toxicity.query,
    "op7_sentencepiece": subword.query,
    "op11_filters": filters.query,
    "op12_repeats": repeats.query,
    "op13_codes": codes.query,
}

ORACLES: dict[str, str] = {
    "op1_near_duplicates": neardup.ORACLE,
    "op3_warc": warc.ORACLE,
    "op5_vectors": vectors.ORACLE,
    "op11_filters": filters.ORACLE,
    "op13_codes": codes.ORACLE,
}
