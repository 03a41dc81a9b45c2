"""The corpus pipeline: each stage works on all that the stage before it kept, written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trialmill.llm import decontam, exact, pieces, simhash, toxicity
from trialmill.shared import folder

#: (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("toxicity", toxicity.reject),
    ("exact_dedup", exact.keep_one),
    ("simhash_near_dedup", simhash.keep_one),
    ("decontamination", decontam.drop_leaks),
    ("sentencepiece", pieces.encode_stage),
]

#: Not expressible in SQL: fingerprints, a trained model and a piece lattice; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each returns lies in the shared folder that the cluster names."""
    root = f"{folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}-{name}")
        docs = spark.read.parquet(f"{root}/{i}-{name}")
    return docs
