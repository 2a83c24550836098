"""Weighted reciprocal rank fusion and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import tokenize


def fuse(dense: DataFrame, lexical: DataFrame, keys: list[str], settings: Settings = Settings(), k: int | None = None) -> DataFrame:
    """(query_id, *keys, score, dense_score, lexical_score, rank) from two ranked lists.

    A row counts at each rank where it stands, also twice in one list; null keys are one identity.
    Ties go to what was seen first, dense before lexical.
    """
    part = lambda df, no, w: df.select("query_id", *keys, F.lit(no).alias("list"), "rank", (F.lit(w) / (settings.rrf_k + F.col("rank"))).alias("part"))
    both = part(dense, 0, settings.dense_weight).unionByName(part(lexical, 1, settings.lexical_weight))
    of = lambda no: F.round(F.sum(F.when(F.col("list") == no, F.col("part")).otherwise(0.0)), 9)
    found = both.groupBy("query_id", *keys).agg(F.round(F.sum("part"), 9).alias("score"), of(0).alias("dense_score"), of(1).alias("lexical_score"), F.min(F.struct("list", "rank")).alias("seen"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")))
    return ranked.where(F.col("rank") <= (k or settings.fusion_top_k)).drop("seen")


def overlap(query: Column, content: Column) -> Column:
    """Stand-in scorer: the share of the query's distinct tokens that the text has."""
    q = F.array_distinct(tokenize(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, tokenize(content))), F.size(q)), F.lit(0.0)).cast("double")


def rerank(rows: DataFrame, k: int, scorer: Callable | None = overlap, query: str = "query", content: str = "content") -> DataFrame:
    """The k best of each query by ``rerank_score``; without a scorer, the k first as they stand.

    A scorer is a column function of (query, content); ties keep the order before.
    """
    if scorer is None:
        return rows.where(F.col("rank") <= k)
    scored = rows.withColumn("rerank_score", scorer(F.col(query), F.col(content)))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("new", F.row_number().over(order)).where(F.col("new") <= k).drop("rank").withColumnRenamed("new", "rank")


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A scorer from a model that each worker loads once."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, c in batches:
            yield pd.Series(model(q.tolist(), c.tolist()), dtype="float64")

    return score
