"""Embedding in batches, and exact nearest neighbours by cosine."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import strip_u
from .lexical import top_k

#: Queries that are broadcast at once; more go in several rounds. Rows and queries of a block.
QUERIES_AT_ONCE, BLOCK = 5_000, 1_024
Embedder = Callable[[list[str]], list[list[float]]]


@lru_cache(maxsize=50_000)
def _number(word: str) -> int:
    """Of a word; most come again."""
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


def hashed_embedder(dimensions: int) -> Embedder:
    """Offline stand-in: hashed bag of words, of unit length. No measure of any model's quality."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dimensions)
            for word, times in Counter(text.lower().split()).items():
                v[_number(word) % dimensions] += times
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).tolist())
        return out

    return embed


def embed(chunks: DataFrame, embedder: Embedder, text: str = "content", batch: int = 64) -> DataFrame:
    """``chunks`` with ``embedding``; blank texts are dropped, and the embedder sees full batches."""
    rows = chunks.where(F.length(strip_u(F.col(text))) > 0)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "embedding array<float>"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            vectors: list[list[float]] = []
            for k in range(0, len(pdf), batch):
                vectors += embedder(pdf[text].iloc[k:k + batch].tolist())
            yield pdf.assign(embedding=vectors)

    return rows.mapInPandas(run, schema)


def dimension_check(vectors: DataFrame, dimensions: int, vector: str = "embedding") -> DataFrame:
    """How many vectors there are, and how many have another length; no row is dropped."""
    return vectors.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.coalesce(F.size(vector), F.lit(-1)) != dimensions).alias("other_length"))


def observe_dimension(vectors: DataFrame, dimensions: int, observed: Observation, vector: str = "embedding") -> DataFrame:
    """``vectors`` as they are; ``observed`` gets what ``dimension_check`` counts from whatever job reads them."""
    return vectors.observe(observed, F.count(F.lit(1)).alias("vectors"), F.count_if(F.coalesce(F.size(vector), F.lit(-1)) != dimensions).alias("other_length"))


def _best_of_block(rows: pd.DataFrame, keys: list[str], vector: str, ids: list, q: np.ndarray, norms: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of one block for each query: by cosine of 6 digits, then by key, unknown ones last."""
    rows = rows.sort_values(keys, kind="stable", na_position="first").reset_index(drop=True)
    fits = np.array([v is not None and len(v) == q.shape[1] for v in rows[vector]], bool)
    m = np.zeros((len(rows), q.shape[1]))
    if fits.any():
        m[fits] = np.stack([np.asarray(v, dtype=np.float64) for v in rows[vector][fits]])
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.round((m @ q.T) / (np.sqrt((m * m).sum(1))[:, None] * norms[None, :]), 6)
    score[~fits] = np.nan
    order = np.where(np.isnan(score), -np.inf, score)
    out, most = [], min(k, len(rows))
    edge = np.partition(order, len(rows) - most, axis=0)[len(rows) - most]
    for j, name in enumerate(ids):
        at = np.flatnonzero(order[:, j] >= edge[j])
        at = at[np.argsort(-order[at, j], kind="stable")][:k]
        found = rows.loc[at, keys]
        found.insert(0, "query_id", name)
        found["score"] = score[at, j]
        out.append(found)
    return pd.concat(out, ignore_index=True)


def dense_search(vectors: DataFrame, queries: DataFrame, keys: list[str], k: int, vector: str = "embedding") -> DataFrame:
    """(query_id, *keys, score, rank) by cosine; ``queries`` has query_id and ``q``.

    Blocks of vectors are multiplied with blocks of queries, and each block hands on its own k best
    of every query. At most ``QUERIES_AT_ONCE`` queries are collected and broadcast at once, each
    round keeping its own k best; queries of each length go apart, since a vector of another
    length has no cosine with them (null, ranked last).
    """
    spark = vectors.sparkSession
    sized = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where("q is not null").withColumn("d", F.size("q"))
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = ", ".join([f"query_id {kind}", *(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keys), "score double"])
    out = None
    for d, n in ((r["d"], r["count"]) for r in sized.groupBy("d").count().collect()):
        rounds = -(-n // QUERIES_AT_ONCE)
        for r in range(rounds):
            some = sized.where((F.col("d") == d) & (F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r)).collect()  # bounded by the round
            if some:
                best = top_k(vectors.select(*keys, vector).mapInPandas(_blocks(spark.sparkContext.broadcast([(x["query_id"], x["q"]) for x in some]), keys, vector, k), schema), keys, k)
                out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], schema + ", rank int")


def _blocks(asked, keys: list[str], vector: str, k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = [i for i, _ in asked.value]
        q = np.array([[np.nan if x is None else x for x in v] for _, v in asked.value], np.float64)
        norms = np.sqrt((q * q).sum(1))
        for pdf in frames:
            for at in range(0, len(pdf), BLOCK):
                for lo in range(0, len(ids), BLOCK):
                    yield _best_of_block(pdf.iloc[at:at + BLOCK], keys, vector, ids[lo:lo + BLOCK], q[lo:lo + BLOCK], norms[lo:lo + BLOCK], k)

    return run


def loaded_embedder(load: Callable[[], Embedder]) -> Embedder:
    """An embedder whose model each worker loads once, when it first embeds."""
    held: list[Embedder] = []

    def embed_texts(texts: list[str]) -> list[list[float]]:
        if not held:
            held.append(load())
        return held[0](texts)

    return embed_texts


def build_embedder(provider: str, dimensions: int, models: dict[str, Callable[[], Embedder]] | None = None) -> Embedder:
    """The embedder of a provider: ``hashed`` (offline), or one whose loader is in ``models``."""
    if provider == "hashed":
        return hashed_embedder(dimensions)
    if provider not in (models or {}):
        raise ValueError(f"unsupported embedding provider: {provider!r}")
    return loaded_embedder(models[provider])


def bag_cosine(a: str, b: str):
    """Cosine of the counts in two columns of tokens, as an expression; 0 if either has none."""
    x, y = F.col(a), F.col(b)
    count = lambda xs, t: F.size(F.filter(xs, lambda v: v == t))
    dot = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda acc, t: acc + count(x, t) * count(y, t))
    norm = lambda xs: F.sqrt(F.aggregate(F.array_distinct(xs), F.lit(0.0), lambda acc, t: acc + count(xs, t) * count(xs, t)))
    return F.coalesce(F.try_divide(dot, norm(x) * norm(y)), F.lit(0.0))
