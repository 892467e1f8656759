"""The registered queries of this subpackage and their SQL, by name.

Where SQL cannot express a result (hashing, tokenisation, training, parsing), tests/llm
holds brute force, round trips and held-out accuracy instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helmwind.llm import (
    bpe,
    embed_dedup,
    fill_middle,
    fingerprints,
    html_extract,
    langid,
    mixing,
    quality_cnn,
    quality_rules,
    simhash,
    substring_dedup,
    token_alignment,
    toxicity,
)
from helmwind.llm.oracles import ORACLE_SQL  # noqa: F401  read by the driver's entry module

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_quality_classifier": quality_cnn.op4_quality_classifier,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_html_extraction": html_extract.op7_html_extraction,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_language_id": langid.op9_language_id,
    "op10_embedding_near_dedup": embed_dedup.op10_embedding_near_dedup,
    "op11_fill_in_middle": fill_middle.op11_fill_in_middle,
    "op12_document_fingerprints": fingerprints.op12_document_fingerprints,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
