"""The shared folder and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder in that of spark.checkpoint.dir. Where it is unset, a local session takes one of its own, and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def written(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").partitionBy(*keys).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
