"""Exact top-k inner products by block-at-a-time pruning.

Vectors are dealt to their nearest of a bounded number of pivots and ordered by their distance
from it, so that similar ones lie together, and packed into shards of small blocks. Two bounds hold
for every score in a block: each component's largest and smallest value, weighed by the query and
summed; and the product with the block's centre plus the query's length times the block's radius.
Each query is first scored in its own shard, which gives a lower bound of its k-th score. Then it
meets the blocks' summaries alone, which are as many times fewer as a block has vectors, and only
goes on to shards that have a block whose bound comes up to it. There it takes blocks in the order
of their bounds, scores their vectors from the block's forward index, and stops as soon as the
next bound falls below its k-th score. Queries meet shards in packed groups, never row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

K = 10
SCALE = 1024
BLOCK = 64
SHARD = 2048
#: Vectors to a partition of shards, shards to a row of summaries, and queries to a row of queries, about.
PER_PART, SUMMARIES, ASKED = 8192, 64, 2048
#: Vectors that others are dealt to, at most; the first ones by a hash of their id.
PIVOTS = 256


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of vectors whose components are all known and finite."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    known = F.col(vector_col).isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.select(F.col(id_col).alias("id"), F.col(vector_col), x.alias("x")).where(F.coalesce(known, F.lit(False))).select("id", F.transform("x", lambda c: F.floor(c * float(scale)).cast("long")).alias("v"))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b: in floating point while every sum is below 2 ** 53."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[-1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a @ b
    raise OverflowError("inner products don't fit in 64 bits")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores), axis=-1)[..., :k]


_SHARD = "part int, seq int, ids binary, rows binary, top binary, low binary, centre binary, radius binary, q_at binary, q_rows binary, q_floor binary"
_SUMMARY = ("top", "low", "centre", "radius")
_ASK = "part int, seq int, q_home binary, q_at binary, q_rows binary, q_floor binary"
_LOW = -np.iinfo(np.int64).max  # its negative fits too
_FAR = float(1 << 62)


def _near(dim: int, pivots: np.ndarray):
    """Each vector's nearest pivot and its squared distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.zeros((batch.num_rows, dim))
            for i, v in enumerate(batch.column("v").to_pylist()):
                m[i, :len(v)] = v
            away = (m * m).sum(1)[:, None] - 2 * m @ pivots.T + (pivots * pivots).sum(1)[None, :]
            at = away.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(np.maximum(away[np.arange(len(at)), at], 0.0))], [*batch.schema.names, "a", "b"])

    return run


def bounds(q: np.ndarray, top: np.ndarray, low: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """(queries, blocks): no integer product of a query with a vector of the block is larger."""
    by_component = _product(np.maximum(q, 0), top.T) + _product(np.minimum(q, 0), low.T)
    length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    middle = q.astype(np.float64) @ centre.T
    by_radius = middle + length[:, None] * radius[None, :]
    # beyond what rounding can have taken away
    by_radius = np.ceil(by_radius + 1 + 1e-9 * (np.abs(by_radius) + length[:, None] * (np.sqrt((centre ** 2).sum(1)) + radius)[None, :]))
    return np.minimum(by_component, np.minimum(by_radius, _FAR).astype(np.int64))


def _survivors(dim: int):
    """Of a row of queries (from many shards) and one of summaries (of many), for each shard the queries that some block of it may still serve."""
    names = [x.split()[0] for x in _ASK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                asked, offered = batch.column("asked")[k].as_py(), batch.column("offered")[k].as_py()
                home = np.concatenate([np.full(len(a["q_floor"]) // 8, a["home"]) for a in asked])
                at, floor = (np.frombuffer(b"".join(a[c] for a in asked), np.int64) for c in ("q_at", "q_floor"))
                q = np.frombuffer(b"".join(a["q_rows"] for a in asked), np.int64).reshape(-1, dim)
                for r in offered:
                    go = (_bounds_of(r, q, dim) >= floor[:, None]).any(1)
                    if go.any():
                        cut = [r["part"], r["seq"], home[go].tobytes(), at[go].tobytes(), q[go].tobytes(), floor[go].tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if isinstance(x, int) else pa.binary()) for x in cut], names)

    return run


def _bounds_of(r: dict, q: np.ndarray, dim: int) -> np.ndarray:
    top, low = (np.frombuffer(r[c], np.int64).reshape(-1, dim) for c in ("top", "low"))
    return bounds(q, top, low, np.frombuffer(r["centre"], np.float64).reshape(-1, dim), np.frombuffer(r["radius"], np.float64))


def _pack(dim: int, k: int):
    def shard(part: int, seq: int, ids: list, vecs: list, ask: list) -> pa.RecordBatch:
        m = np.zeros((len(vecs), dim), np.int64)
        for i, v in enumerate(vecs):
            m[i, :len(v)] = v
        cuts = range(0, len(m), BLOCK)
        top = np.stack([m[a:a + BLOCK].max(0) for a in cuts])
        low = np.stack([m[a:a + BLOCK].min(0) for a in cuts])
        centre = np.stack([m[a:a + BLOCK].mean(0) for a in cuts])
        radius = np.array([np.sqrt(((m[a:a + BLOCK] - c) ** 2).sum(1)).max() for a, c in zip(cuts, centre)])
        at = np.flatnonzero(np.array(ask, bool))
        floor = np.full(len(at), _LOW)
        if len(at) and len(m) > k:
            s = _product(m[at], m.T)
            s[np.arange(len(at)), at] = _LOW
            floor = np.partition(s, len(m) - k, axis=1)[:, len(m) - k]
        values = [part, seq, np.array(ids, np.int64), m, top, low, centre, radius, at.astype(np.int64), m[at], floor]
        names = [x.split()[0] for x in _SHARD.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) if isinstance(x, int) else pa.array([x.tobytes()], pa.binary()) for x in values], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]
        part = seq = 0
        for batch in batches:
            part = batch.column("part")[0].as_py()
            for c, name in zip(held, ("id", "v", "ask")):
                c += batch.column(name).to_pylist()
            while len(held[0]) >= SHARD:
                yield shard(part, seq, *(c[:SHARD] for c in held))
                held = [c[SHARD:] for c in held]
                seq += 1
        if held[0]:
            yield shard(part, seq, *held)

    return run


def _shard_number(part, seq):
    return part * (1 << 31) + seq


def _score(dim: int, k: int):
    names, kinds = ["home", "at", "vec_id", "score"], [pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def one(r: dict) -> pa.RecordBatch:
        get = lambda c, *shape: np.frombuffer(r[c], np.int64).reshape(*shape)
        ids, m = get("ids", -1), get("rows", -1, dim)
        home, at, q, floor = get("q_home", -1), get("q_at", -1), get("q_rows", -1, dim), get("q_floor", -1).copy()
        own = home == _shard_number(r["part"], r["seq"])
        bound = _bounds_of(r, q, dim)
        order = np.argsort(-bound, axis=1, kind="stable")
        pad = -len(m) % BLOCK
        blocks = np.pad(m, ((0, pad), (0, 0))).reshape(-1, BLOCK, dim)
        block_ids = np.pad(ids, (0, pad)).reshape(-1, BLOCK)
        real = np.pad(np.ones(len(m), bool), (0, pad)).reshape(-1, BLOCK)
        best = np.full((len(q), k), _LOW)
        best_ids = np.full((len(q), k), np.iinfo(np.int64).max)
        live = np.arange(len(q))
        for step in range(order.shape[1]):
            b = order[live, step]
            go = bound[live, b] >= floor[live]
            live, b = live[go], b[go]
            if not len(live):
                break
            s = _product(blocks[b], q[live][:, :, None])[:, :, 0]
            usable = real[b]
            usable &= ~own[live][:, None] | (b[:, None] * BLOCK + np.arange(BLOCK) != at[live][:, None])
            s = np.where(usable & (s >= floor[live][:, None]), s, _LOW)
            all_s, all_i = np.concatenate([best[live], s], 1), np.concatenate([best_ids[live], np.where(s > _LOW, block_ids[b], np.iinfo(np.int64).max)], 1)
            pick = _best(all_s, all_i, k) if (s > _LOW).any() else np.broadcast_to(np.arange(k), (len(live), k))
            best[live], best_ids[live] = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_i, pick, 1)
            floor[live] = np.maximum(floor[live], best[live][:, -1])
        i, j = np.nonzero(best > _LOW)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((home[i], at[i], best_ids[i, j], best[i, j]), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield one({c: batch.column(c)[k].as_py() for c in batch.schema.names})

    return run


def top_k(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """The k highest inner products of each query with every row but its own.

    ``is_query`` is a condition on the id column (null: no query). Returns ``query_id``, ``rank`` (from 1), the id
    column and ``score``; equal scores go to the smaller id, and equal ids to either. Vectors that
    are null or hold a null or non-finite component take no part; shorter vectors count as padded
    with zeros. Rows that share an id are rows of their own. Products beyond 64 bits raise an
    error. An empty table gives an empty result; other columns play no part. Ids are integers.
    """
    spark = df.sparkSession
    rows = quantised(df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")), "id", "vec", scale).where("id is not null")
    rows = rows.withColumn("ask", F.coalesce(is_query(F.col("id")), F.lit(False)))
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    dim = max(dim or 1, 1)
    parts = max(1, -(-n // PER_PART))
    if not n:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    some = rows.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, -(-n // BLOCK))).select("v").collect()  # bounded by PIVOTS
    pivots = np.zeros((len(some), dim))
    for i, x in enumerate(some):
        pivots[i, :len(x["v"])] = x["v"]
    near = rows.mapInArrow(_near(dim, pivots), "id long, v array<long>, ask boolean, a int, b double")
    near = near.repartitionByRange(parts, "a", "b", "id").sortWithinPartitions("a", "b", "id")
    shards = materialise(near.select(F.spark_partition_id().alias("part"), "id", "v", "ask").mapInArrow(_pack(dim, k), _SHARD), "shards")
    number = _shard_number(F.col("part").cast("long"), F.col("seq"))
    # queries meet summaries first, both in packed rows: so few that each row of one can meet each row of the other
    rows_of = lambda df, n, name, *columns: df.groupBy(F.pmod(F.xxhash64("part", "seq"), F.lit(n)).cast("long").alias(name)).agg(F.collect_list(F.struct(*columns)).alias(f"{name}s"))
    groups = -(-n // (SHARD * SUMMARIES))
    asking = shards.where(F.octet_length("q_at") > 0)
    total = rows.where("ask").count()
    asked = rows_of(asking, max(1, -(-total // ASKED)), "ask", number.alias("home"), "q_at", "q_rows", "q_floor").select(F.col("asks").alias("asked"))
    offered = rows_of(shards, groups, "offer", "part", "seq", *_SUMMARY).withColumnsRenamed({"offer": "grp", "offers": "offered"})
    everywhere = asked.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    left = materialise(offered.join(everywhere, "grp").select("asked", "offered").mapInArrow(_survivors(dim), _ASK), "survivors")
    pairs = shards.drop("q_at", "q_rows", "q_floor").join(left, ["part", "seq"])
    found = pairs.mapInArrow(_score(dim, k), "home long, at long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("home", "at").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    name = asking.select(number.alias("home"), "q_at", "ids").mapInArrow(_names, "home long, at long, query_id long")
    return best.join(name, ["home", "at"]).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            at = np.frombuffer(r["q_at"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["home"])), pa.array(at), pa.array(np.frombuffer(r["ids"], np.int64)[at])], ["home", "at", "query_id"])
