"""Tables that outlive their lineage: checkpoints and Parquet in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or one that was set on the context; on a local master, as in tests, a temporary one if there is none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="spark-ckpt-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint."""
    folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of a bulky table: compressed Parquet beside the checkpoints."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
