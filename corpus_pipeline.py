"""A corpus pipeline over ``documents``: each stage is written as Parquet and read again by the next.

1. language ID drops documents whose language is not accepted;
2. near-dedup keeps one document of each group of texts whose SimHash fingerprints are within op8's radius or which have
   four fifths of their five-word shingles in common (which that radius does not see; see the README);
3. substring dedup cuts passages of 35 words and more that repeat;
4. mixing takes documents to the target weights of their sources, some of them more than once;
5. byte-level BPE turns the texts into token ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from helmwind.llm import bpe, langid, mixing, simhash, substring_dedup
from helmwind.llm.common import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Whole texts go to Python in batches of this size, not of ten thousand rows: an executor holds several on both sides.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def bounded(stage: Stage) -> Stage:
    """The stage with ``BATCH`` set for the session, unless the session has a value; it stays set, as the stage's table is written later."""

    @wraps(stage)
    def run_bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH, None) is None:
            spark.conf.set(BATCH, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run_bounded


STAGES = [
    ("language_id", bounded(langid.language_stage)),
    ("simhash_near_dedup", bounded(simhash.near_dedup_stage)),
    ("substring_dedup", bounded(substring_dedup.substring_stage)),
    ("mixing", bounded(mixing.mixing_stage)),
    ("byte_bpe", bounded(bpe.tokens_stage)),
]

#: Trained models and graph closure have no SQL; tests/llm runs the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
