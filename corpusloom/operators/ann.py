"""Approximate nearest neighbours by cosine: a kept index of cells.

Vectors are scaled to unit length and dealt to the nearest of a bounded number of centroids, which
k-means fits on a bounded sample. A cell keeps its vectors as residuals from its centroid, a byte
a component, in packed rows, and whole, in another table; both are partitioned by cell. A query
goes to its nearest cells, reads their codes, and only the best candidates' whole vectors.

How many cells a query needs for a given recall is measured when the index is built, on a sample
of its own vectors: for each of a vector's true neighbours, how near its cell is in the vector's
order of cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .dense import dense_search
from .lexical import top_k

#: Most centroids, sampled vectors for each of them, and vectors that the recall is measured on.
MAX_CELLS, TRAIN_PER_CELL, TRIALS = 4_096, 64, 256
#: Vectors of a packed row, and queries of one; vectors of a cell that one task packs.
PACK, ASKED, ROWS_PER_TASK = 1_024, 256, 262_144
#: Candidates kept by code for each neighbour asked for.
RESCORE = 4
RECALL = 0.95


@dataclass(frozen=True)
class CellIndex:
    """``centroids`` (cell, centroid); ``codes``: packed rows by cell; ``vectors`` (keys, vector) by cell; ``probes`` cells give ``recall``."""

    keys: list[str]
    dimensions: int
    probes: int
    centroids: DataFrame
    codes: DataFrame
    vectors: DataFrame
    sizes: DataFrame


def _unit(vector: Column, dimensions: int | None = None) -> Column:
    """Of unit length; null for a null, a zero vector, an unknown or non-finite component, another length."""
    d = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    good = (norm > 0) & (norm < float("inf"))
    if dimensions is not None:
        good = good & (F.size(vector) == dimensions)
    return F.when(F.coalesce(good, F.lit(False)), F.transform(d, lambda x: x / norm))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _nearest(centroids, dimensions: int, count: int):
    """Adds ``near``: the cells nearest to ``unit``, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        half = (c * c).sum(1) / 2
        for batch in batches:
            away = half[None, :] - _matrix(batch.column("unit"), dimensions) @ c.T
            near = np.argsort(away, axis=1, kind="stable")[:, :count].astype(np.int32) if count > 1 else away.argmin(1).astype(np.int32)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "near"])

    return run


def _with_near(df: DataFrame, centroids: np.ndarray, count: int) -> DataFrame:
    """``df`` (..., unit) with the nearest cells; the centroids are broadcast, at most MAX_CELLS of them."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "near array<int>"])
    return df.mapInArrow(_nearest(df.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1], count), schema)


def _packed(dimensions: int, centroids):
    """Runs of rows of one cell as one row: keys, residuals in a byte a component, their scales."""

    def row(cell: int, keys: pa.Array, unit: np.ndarray) -> pa.RecordBatch:
        residual = unit - centroids.value[cell]
        scale = np.maximum(np.abs(residual).max(1) / 127, 1e-12)
        code = np.round(residual / scale[:, None]).astype(np.int8)
        listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), listed, pa.array([code.tobytes()]), pa.array([scale.astype(np.float32).tobytes()])], ["cell", "keys", "code", "scale"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            unit = _matrix(batch.column("unit"), dimensions)
            edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(edges, edges[1:]):
                for k in range(a, b, PACK):
                    yield row(int(cells[k]), batch.column("keys").slice(k, min(PACK, b - k)), unit[k:min(k + PACK, b)])

    return run


def _fit(units: DataFrame, n: int, cells: int, seed: int) -> np.ndarray:
    """Centroids by Spark's k-means, on at most TRAIN_PER_CELL vectors for each."""
    if cells == 1:
        return np.zeros((1, len(units.first()["unit"])))
    share = min(1.0, cells * TRAIN_PER_CELL / n)
    sample = units.where(F.pmod(F.xxhash64("unit"), F.lit(1_000_000)) < share * 1_000_000) if share < 1 else units
    model = KMeans(k=cells, seed=seed, maxIter=8, initSteps=2, featuresCol="f").fit(kept(sample.select(array_to_vector("unit").alias("f")), "ann-sample"))
    return np.array(model.clusterCenters())


def build(vectors: DataFrame, keys: list[str], folder: str, vector: str = "embedding", cells: int | None = None, recall: float = RECALL, k: int = 20, seed: int = 7) -> CellIndex:
    """Index the vectors of ``vectors`` and write it to ``folder``, in place of what is there.

    Every row with a vector of the most common length is indexed; a null, a zero vector, one with
    an unknown or non-finite component or of another length has no cosine and is left out. Rows
    with equal or null keys are rows of their own. ``cells``: by default the root of the number of
    vectors, at most MAX_CELLS. An empty table gives an index that finds nothing.
    """
    spark = vectors.sparkSession
    lengths = vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dimensions = lengths[0]["d"] if lengths else 1
    units = vectors.select(F.struct(*keys).alias("keys"), F.col(vector).alias("vector"), _unit(F.col(vector), dimensions).alias("unit")).where("unit is not null")
    units = kept(units, "ann-units")
    n = units.count()
    cells = max(1, min(MAX_CELLS, n, cells or math.isqrt(n)))
    centroids = _fit(units.select("unit"), n, cells, seed) if n else np.zeros((1, dimensions))
    cells = len(centroids)
    dealt = _with_near(units, centroids, 1).withColumn("cell", F.element_at("near", 1)).drop("near")
    dealt = kept(dealt, "ann-dealt")
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    # a large cell is packed by many tasks
    salted = dealt.join(sizes, "cell").withColumn("salt", F.floor(F.rand(seed) * F.ceil(F.col("n") / ROWS_PER_TASK)).cast("int"))
    schema = f"cell int, keys array<{units.schema['keys'].dataType.simpleString()}>, code binary, scale binary"
    shuffled = kept(salted.select("cell", "salt", "keys", "unit").repartition("cell", "salt").sortWithinPartitions("cell"), "ann-sorted")
    packed = shuffled.select("cell", "keys", "unit").mapInArrow(_packed(dimensions, spark.sparkContext.broadcast(centroids)), schema)
    packed.write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/codes")
    salted.select("cell", "keys", F.col("vector").cast("array<float>").alias("vector"), "salt").repartition("cell", "salt").drop("salt").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{folder}/centroids")
    sizes.write.mode("overwrite").parquet(f"{folder}/sizes")
    probes, found = _probes(dealt, n, centroids, recall, k) if n else (1, 1.0)
    about = [(dimensions, probes, found, n, keys)]
    spark.createDataFrame(about, "dimensions int, probes int, recall double, vectors long, keys array<string>").coalesce(1).write.mode("overwrite").json(f"{folder}/about")
    return open_index(spark, folder)


def _probes(dealt: DataFrame, n: int, centroids: np.ndarray, recall: float, k: int) -> tuple[int, float]:
    """The fewest cells for the recall on TRIALS sampled vectors, with half of what is missing from 1 to spare, and that recall."""
    trials = dealt.where(F.pmod(F.xxhash64("unit", F.lit("trial")), F.lit(1 << 20)) < max(1, math.ceil(2 * TRIALS / n * (1 << 20)))).limit(TRIALS)
    trials = kept(trials.select(F.monotonically_increasing_id().alias("query_id"), F.col("unit").alias("q"), "unit"), "ann-trials")
    true = dense_search(dealt.select("cell", F.monotonically_increasing_id().alias("row"), "unit"), trials.select("query_id", "q"), ["row", "cell"], k, "unit")
    place = _with_near(trials.select("query_id", "unit"), centroids, len(centroids)).select("query_id", "near")
    ranks = true.join(place, "query_id").groupBy(F.array_position("near", F.col("cell")).alias("place")).count().collect()  # at most the cells
    have = np.zeros(len(centroids) + 1)
    for r in ranks:
        have[int(r["place"])] += r["count"]
    share = np.cumsum(have) / max(have.sum(), 1)
    probes = int(np.searchsorted(share, min(1.0, recall + (1 - recall) / 2)))
    probes = max(1, min(probes, len(centroids)))
    return probes, float(share[probes])


def open_index(spark: SparkSession, folder: str) -> CellIndex:
    about = spark.read.schema("dimensions int, probes int, recall double, vectors long, keys array<string>").json(f"{folder}/about").first()
    centroids = spark.read.parquet(f"{folder}/centroids")
    read = lambda name: spark.read.parquet(f"{folder}/{name}") if about["vectors"] else None
    return CellIndex(about["keys"], about["dimensions"], about["probes"], centroids, read("codes"), read("vectors"), spark.read.parquet(f"{folder}/sizes"))


def _scored(dimensions: int, centroids, k: int):
    """Packed codes of a cell and packed queries that go there -> each query's best of these codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q = batch.column("qs").slice(r, 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
                code = np.frombuffer(batch.column("code")[r].as_py(), np.int8).reshape(-1, dimensions).astype(np.float32)
                scale = np.frombuffer(batch.column("scale")[r].as_py(), np.float32)
                own = centroids.value[batch.column("cell")[r].as_py()]
                rebuilt = code * scale[:, None] + own.astype(np.float32)
                score = q.astype(np.float32) @ rebuilt.T / np.maximum(np.sqrt((rebuilt * rebuilt).sum(1)), 1e-9)[None, :]
                most = min(k, score.shape[1])
                best = np.argpartition(-score, most - 1, axis=1)[:, :most]
                ids = batch.column("ids").slice(r, 1).flatten()
                keys = batch.column("keys").slice(r, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.repeat(np.arange(len(q)), most))), keys.take(pa.array(best.ravel())), pa.array(np.full(best.size, batch.column("cell")[r].as_py(), np.int32)), pa.array(np.take_along_axis(score, best, 1).ravel().astype(np.float64))],
                    ["query_id", "keys", "cell", "near"])

    return run


def _asked(index: CellIndex, queries: DataFrame, probes: int | None) -> tuple[DataFrame, np.ndarray]:
    """(query_id, q, unit, cells) of the queries that have a cosine with the index's vectors."""
    rows = index.centroids.orderBy("cell").collect()  # at most MAX_CELLS
    centroids = np.array([r["centroid"] for r in rows])
    units = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), _unit(F.col("q"), index.dimensions).alias("unit")).where("unit is not null")
    return _with_near(units, centroids, min(probes or index.probes, len(centroids))).withColumnRenamed("near", "cells"), centroids


def search(index: CellIndex, queries: DataFrame, k: int, probes: int | None = None, rescore: int = RESCORE) -> DataFrame:
    """(query_id, *keys, score, rank): ``k`` rows of each query (query_id, q) from its nearest cells, by exact cosine.

    Only partitions of cells that some query goes to are read. Scores and ties are those of the
    exact search; a query that is null, zero or of another length finds nothing.
    """
    asked, centroids = _asked(index, queries, probes)
    asked = kept(asked, "ann-asked")
    kind = queries.schema["query_id"].dataType.simpleString()
    if index.codes is None:
        schema = ", ".join([f"query_id {kind}", *(f"`{c}` string" for c in index.keys), "score double, rank int"])
        return queries.sparkSession.createDataFrame([], schema)
    goes = asked.select("query_id", "unit", F.explode("cells").alias("cell"))
    used = [r["cell"] for r in goes.select("cell").distinct().collect()]  # at most MAX_CELLS
    # queries of a cell in packed rows, so that a cell's codes are read once for many of them
    salt = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() // ASKED))))
    packs = goes.groupBy("cell", salt.alias("salt")).agg(F.collect_list("query_id").alias("ids"), F.flatten(F.collect_list("unit")).alias("qs")).drop("salt")
    key = index.vectors.schema["keys"].dataType.simpleString()
    pairs = index.codes.where(F.col("cell").isin(used)).join(packs, "cell").select("cell", "keys", "code", "scale", "ids", "qs")
    found = pairs.mapInArrow(_scored(index.dimensions, queries.sparkSession.sparkContext.broadcast(centroids), k * rescore), f"query_id {kind}, keys {key}, cell int, near double")
    near = top_k(found, ["keys"], k * rescore, "near", 9).select("query_id", "keys", "cell").distinct()
    # whole vectors of the candidates alone; rows with equal keys in a cell are all compared
    whole = index.vectors.where(F.col("cell").isin(used)).withColumnRenamed("keys", "own")
    both = near.join(whole, (near["cell"] == whole["cell"]) & near["keys"].eqNullSafe(whole["own"])).select("query_id", "own", "vector")
    exact = both.join(asked.select("query_id", "q"), "query_id").select("query_id", F.col("own").alias("keys"), _cosine(F.col("vector"), F.col("q")).alias("score"))
    return top_k(exact.select("query_id", "keys.*", "score"), index.keys, k)


def _cosine(a: Column, b: Column) -> Column:
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    norm = lambda x: F.sqrt(total(F.transform(d(x), lambda v: v * v)))
    return total(F.zip_with(d(a), d(b), lambda x, y: x * y)) / (norm(a) * norm(b))


def reads(index: CellIndex, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """(query_id, read, vectors): how many vectors' codes a query reads, of how many."""
    asked, _ = _asked(index, queries, probes)
    total = index.sizes.agg(F.sum("n").alias("vectors"))  # one row
    read = asked.select("query_id", F.explode("cells").alias("cell")).join(index.sizes, "cell", "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("read"))
    return read.crossJoin(F.broadcast(total))
