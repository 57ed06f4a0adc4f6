"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset and
    all run on one machine (tests), a temporary folder; elsewhere an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: How many steps of each session are being written, and what CLEANUP was before the first of them.
_writing, _before, _lock = Counter(), {}, threading.Lock()


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """CLEANUP is on while any step of the session is written, whichever thread's step ends first."""
    key = id(spark._jsparkSession)
    with _lock:
        if not _writing[key]:
            _before[key] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _writing[key] += 1
    try:
        yield
    finally:
        with _lock:
            _writing[key] -= 1
            if not _writing[key]:
                spark.conf.set(CLEANUP, _before.pop(key))


def hadoop_path(spark: SparkSession, folder: str):
    """A folder's file system and path, as Hadoop knows them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def cut(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: this cuts its lineage, and lost
    executors lose nothing of it. The shuffle files that the step took are removed as it ends, its
    own files by drop() or as the application ends (the result may be read until then)."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with tidy_shuffles(spark):
        df.write.parquet(folder)
    files, path = hadoop_path(spark, folder)
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(folder)
    out.step_folder = folder
    return out


def drop(*steps: DataFrame) -> None:
    """Remove the files of steps that cut() wrote and nothing reads any more."""
    for step in steps:
        files, path = hadoop_path(step.sparkSession, step.step_folder)
        files.delete(path, True)


def keep_docs(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (null: empty); other columns can't clash afterwards."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def batches(it: Iterator[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes, so that Python holds few texts at once."""
    for b in it:
        step = max(1, int(b.num_rows * most / max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
