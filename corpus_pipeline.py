"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pairloom.llm import decontamination, language, neardup, packing, suffixes
from pairloom.llm.columns import hand_back
from pairloom.session import materialize


def _after_others(stage):
    """The stage, begun when the workers have returned what the stage before it left them."""
    def run(spark, docs, sf_dir):
        hand_back(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", language.stage),
    ("near_duplicates", _after_others(neardup.stage)),
    ("repeated_strings", _after_others(suffixes.stage)),
    ("decontamination", _after_others(decontamination.stage)),
    ("packing", _after_others(packing.stage)),
]

# SQL can neither train the language model nor pack; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
