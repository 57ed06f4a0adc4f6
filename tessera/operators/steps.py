"""Steps of iterative operators, kept where executors can't lose them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, written in the folder that spark.checkpoint.dir names and read back, so its lineage ends there; where that is unset and all runs on one
    machine (tests), in a temporary one. The files go as the application ends."""
    spark = df.sparkSession
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if top is None:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(top)
    folder = f"{top}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)
