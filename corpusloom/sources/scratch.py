"""Tables that a job writes down for itself, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, deleted at exit; a local session may go without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-loom-"))
            atexit.register(shutil.rmtree, _own[0], True)
        root = "file://" + _own[0]
    if not _made:
        atexit.register(release, spark)
    _made.append(f"{root.rstrip('/')}/jobs/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete what this process wrote; results that still read it end with it."""
    while _made and spark.sparkContext._jsc is not None:
        delete(spark, _made.pop())


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, for results that several branches use."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
