"""Helpers shared by the training-data operators: scratch tables, inputs, names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, the only separators of words in the contracts.
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, as in tests, may go
    without: it gets a temporary folder that goes at exit.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "root" not in _own:
        _own["root"] = tempfile.mkdtemp(prefix="spark-loom-")
        atexit.register(shutil.rmtree, _own["root"], True)
    return "file://" + _own["root"]


#: Scratch folders that this process has made and not removed, by the scopes that are open.
_made: list[list[str]] = [[]]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's place under the shared one; it goes with its ``scratch`` scope, or at exit."""
    path = f"{shared_root(spark)}/loom/{name}-{uuid.uuid4().hex}"
    if "exit" not in _own:
        _own["exit"] = "release"
        atexit.register(release, spark)
    _made[-1].append(path)
    return path


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders on whatever file system they lie."""
    jvm = spark.sparkContext._jvm
    if jvm is None:  # the session has ended
        return
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete all scratch folders. Results that still read them, as those of operators do, end with it."""
    paths = [p for scope in _made for p in scope]
    _made[:] = [[]]
    if spark.sparkContext._jsc is not None:
        remove(spark, paths)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are removed at the end, whether or not it ends well.

    What is to outlast it must have been written elsewhere, or by a ``materialise`` before it.
    """
    _made.append([])
    try:
        yield
    finally:
        remove(spark, _made.pop())


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage where every executor can read it again, and gives Spark the table's real
    size, so that it can choose between broadcast and shuffle by that.
    """
    path = path or scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): the file that a row is read from (its path's hash) with its place there, and the row.

    Neither depends on how Spark splits the files, so every scan gives a row the same number, on
    whatever cores there are. ``docs`` is a table as read from Parquet files; any other has no such
    places, and is written down once with numbers.
    """
    whole = F.struct("*").alias("doc")
    try:
        meta = docs.metadataColumn("_metadata")
        return docs.select(F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("place")).alias("row"), whole)
    except AnalysisException:
        once = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("place"))
        return materialise(docs.select(once.alias("row"), whole), "numbered")


#: About so many rows are numbered by one task.
ROWS_PER_GROUP = 250_000


def gapless(rows: DataFrame, by: str, uid: str, name: str, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Number the rows of each value of ``by`` from 0, without gaps, by many tasks.

    ``rows`` is a written table and ``uid`` a number of its own for each row, so that equal rows
    too are dealt over all groups; a table of how many rows come before each group is joined on.
    """
    groups = max(32, -(-rows.count() // rows_per_group))
    dealt = rows.withColumn("loom_group", F.pmod(F.xxhash64(uid), F.lit(groups)).cast("int"))
    earlier = Window.partitionBy(by).orderBy("loom_group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(by, "loom_group").agg(F.count(F.lit(1)).alias("loom_n"))
    bases = sizes.select(by, "loom_group", F.coalesce(F.sum("loom_n").over(earlier), F.lit(0)).alias("loom_base"))
    place = F.row_number().over(Window.partitionBy(by, "loom_group").orderBy(uid)) - 1
    numbered = dealt.join(bases.hint("merge"), [by, "loom_group"])
    return numbered.select(*rows.columns, (F.col("loom_base") + place).cast("long").alias(name))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """Cuts ``batch`` so that each part has at most so many bytes of ``column`` and rows, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = int(np.searchsorted(ends, before + most_bytes, "right"))
        stop = min(max(stop, at + 1), at + most_rows)
        yield batch.slice(at, stop - at)
        at = stop


#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes for this session, so that a task's memory doesn't grow with the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Words as runs of anything but ASCII white space; null counts as none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


#: Bits of a prefilter: at most this many, so at most 8 MB, however large the tables.
FILTER_BITS = 1 << 26
_PER_MAP = 32_768


def possibly(df: DataFrame, members: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split ``df`` into rows whose key may be among those of ``members``, and rows whose key is not.

    One bit per key, by hash, in bitmaps of a bounded total size that every task gets. It keeps
    rows that can't match, and their texts, out of the shuffle of the join that follows.
    """
    slot = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    bucket, place = F.floor(slot / _PER_MAP).cast("int"), (slot % _PER_MAP).cast("int")
    maps = members.select(bucket.alias("loom_bucket"), place.cast("long").alias("place")).groupBy("loom_bucket").agg(F.bitmap_construct_agg("place").alias("loom_bits"))
    marked = df.withColumns({"loom_bucket": bucket, "loom_place": place}).join(F.broadcast(materialise(maps, "filter")), "loom_bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(loom_bits, loom_place div 8 + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce((byte.bitwiseAND(F.expr("shiftleft(1, loom_place % 8)")) != 0), F.lit(False))
    return marked.where(hit).select(*df.columns), marked.where(~hit).select(*df.columns)
