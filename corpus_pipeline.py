"""From documents to training sequences: every stage takes (spark, docs, sf_dir), where docs is what the stage before wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dipfleet.llm.common import remove_folder, shared_folder, table
from dipfleet.llm.stages import cut_repeats, drop_near_copies, drop_toxic, mix_sources, pack_sequences

STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffixes", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the learned scores nor the merges of the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each result is written as Parquet in the shared folder and read again, and deleted
    once the next one is written."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
