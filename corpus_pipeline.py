"""The corpus pipeline: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringlet.llm import byte_bpe, exact_dedup, mixing, near_dedup, toxicity
from ringlet.llm.common import Scratch, table


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document left: token count and digests.  Null text has no tokens; an empty table stays empty."""
    return byte_bpe.digests(docs, *byte_bpe.tokenizer_file())


STAGES = [
    ("toxicity", toxicity.toxic_stage),
    ("exact dedup", exact_dedup.dedup_stage),
    ("near dedup", near_dedup.near_stage),
    ("mixing", mixing.mix_stage),
    ("encoding", encode_stage),
]

#: SQL expresses neither the field, nor the signatures' draws, nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and reread, and what a stage needed besides is deleted then.

    Null, blank and very long texts, repeated rows, null ids and further columns, whatever their names, are defined by the stages:
    null and blank texts pass the first three (equal ones leave one) and are not in the mix, which has no words to take of them.  An empty table gives an empty result."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = len(Scratch.made)
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, f"stage-{k}")
            Scratch.drop_since(before)
    return docs
