"""Sentence compression under a token budget, prompts and sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, or_none, sentences, strip_u, tokenize
from ..sources.scratch import kept
from .dense import Embedder, bag_cosine, embed

KEEP = 0.6


def sentence_relevance(rows: DataFrame, query: str = "query", content: str = "content", ratio: float = KEEP, similarity: Callable[[str, str], Column] = bag_cosine,
                       embedder: Embedder | None = None, batch: int = 64) -> DataFrame:
    """(query_id, rank, pos, sentence, sim, best, kept) for each sentence of each ranked chunk.

    ``similarity`` is an expression over two columns of tokens; with an ``embedder`` it is the
    cosine of its vectors instead, 0 where there is none. A sentence is kept if it comes to
    ``ratio`` of the chunk's best; chunks without any are dropped.
    """
    split = rows.select("query_id", "rank", F.col(query).alias("query"), F.posexplode(sentences(F.col(content))).alias("pos", "sentence"))
    if embedder is None:
        told = split.withColumns({"query_tokens": tokenize(F.col("query")), "sentence_tokens": tokenize(F.col("sentence"))})
        scored = told.withColumn("sim", F.round(similarity("query_tokens", "sentence_tokens"), 9))
    else:
        scored = _embedded(split, embedder, batch)
    best = F.max("sim").over(Window.partitionBy("query_id", "rank"))
    scored = scored.withColumn("best", best)
    return scored.select("query_id", "rank", "pos", "sentence", "sim", "best", (F.col("sim") >= F.col("best") * ratio).alias("kept"))


def _embedded(split: DataFrame, embedder: Embedder, batch: int) -> DataFrame:
    """``split`` with ``sim``. Each different sentence and query is embedded once, in full batches, however many chunks repeat it."""
    split = kept(split, "sentences")
    texts = split.select(F.col("sentence").alias("content")).unionByName(split.select(F.col("query").alias("content"))).distinct()
    vectors = kept(embed(texts, embedder, batch=batch), "sentence-vectors")
    one = lambda text, vector: vectors.select(F.col("content").alias(text), F.col("embedding").alias(vector))
    joined = split.join(one("sentence", "s"), "sentence", "left").join(one("query", "q"), "query", "left")
    return joined.withColumn("sim", F.round(F.coalesce(cosine(F.col("q"), F.col("s")), F.lit(0.0)), 9)).drop("s", "q")


def count_words(text: str) -> int:
    return len(text.split())


def fold(chunks: list[dict], budget: int, count: Callable[[str], int] = count_words) -> list[tuple[int, str]]:
    """(rank, text) of the chunks, in order, that the budget lets through.

    ``chunks``: rank, and sentences as (text, sim, kept). A chunk that doesn't fit is cut after the
    last sentence that does, or else to characters of its best sentence.
    """
    out, used = [], 0
    for chunk in chunks:
        kept = [s for s, _, k in chunk["sentences"] if k]
        best = max(chunk["sentences"], key=lambda s: s[1])[0]
        text = " ".join(kept) or best
        room = budget - used
        if count(text) > room:
            fits, total = [], 0
            for s in kept:
                total += count(s)
                if total > room:
                    break
                fits.append(s)
            text = " ".join(fits) or best[:max(room * 4, 8)]
        used += count(text)
        out.append((chunk["rank"], text))
        if used >= budget:
            break
    return out


def compress(rows: DataFrame, budget: int, query: str = "query", content: str = "content", ratio: float = KEEP, count: Callable[[str], int] = count_words,
             similarity: Callable[[str, str], Column] = bag_cosine, embedder: Embedder | None = None, observed: Observation | None = None) -> DataFrame:
    """``rows`` with ``content`` cut to relevant sentences and ``compressed``; at most k rows a query meet.

    ``observed`` is filled by whatever job uses the result, without another scan: the tokens of all
    chunks before and after, the chunks, and those that are left.
    """
    told = sentence_relevance(rows, query, content, ratio, similarity, embedder)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "pos"])
        chunks = [{"rank": r, "sentences": list(zip(g["sentence"], g["sim"], g["kept"]))} for r, g in pdf.groupby("rank", sort=True)]
        done = fold(chunks, budget, count)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "rank": [r for r, _ in done], "trimmed": [t for _, t in done]})

    kind = rows.schema["query_id"].dataType.simpleString()
    cut = told.groupBy("query_id").applyInPandas(run, f"query_id {kind}, rank int, trimmed string")
    if observed is None:
        joined = rows.join(cut, ["query_id", "rank"])
    else:
        counted = _counter(count)
        joined = rows.join(cut, ["query_id", "rank"], "left").withColumns({"tokens_before": counted(content), "tokens_after": counted("trimmed")})
        joined = joined.observe(observed, F.coalesce(F.sum("tokens_before"), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("tokens_after"), F.lit(0)).alias("tokens_after"),
                                F.count(F.lit(1)).alias("chunks"), F.count("trimmed").alias("chunks_after"))
        joined = joined.where("trimmed is not null").drop("tokens_before", "tokens_after")
    return joined.withColumn("compressed", F.col("trimmed") != F.col(content)).withColumn(content, F.col("trimmed")).drop("trimmed")


_META = ("ticker", "filing_type", "fiscal_period", "section")


def context(rows: DataFrame, content: str = "content") -> DataFrame:
    """(query_id, context): numbered chunks in rank order with where they come from."""
    source = F.concat(F.lit("(source: "), F.concat_ws(", ", *(or_none(F.col(c)) for c in _META)), F.lit(")"))
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", source.alias("source"), strip_u(F.col(content)).alias("text")))).alias("items"))
    block = F.transform("items", lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["source"], F.lit("\n"), c["text"]))
    return listed.select("query_id", F.array_join(block, "\n\n").alias("context"))


def prompt(context_: Column, query: Column) -> Column:
    return F.concat(
        F.lit("Use nothing but the numbered passages to answer, and name the passages you rely on as [n]. If they do not hold the answer, say that it is missing.\n\n# Passages\n"),
        F.coalesce(context_, F.lit("")), F.lit("\n\n# Question\n"), query, F.lit("\n\n# Answer\n"))


def sources(rows: DataFrame) -> DataFrame:
    """(query_id, sources): distinct and sorted."""
    t, f, p, s = (or_none(F.col(c)) for c in _META)
    label = F.concat(F.concat_ws(" ", t, f, p), F.lit(" | "), s)
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_set(label)).alias("sources"))


def bpe_counter(vocabulary: str, pattern: str) -> Callable[[str], int]:
    """Counts tokens by a byte-pair vocabulary in tiktoken's format; each worker loads it once."""

    def count(text: str) -> int:
        return len(_encoding(vocabulary, pattern).encode_ordinary(text)) if text else 0

    return count


@lru_cache(maxsize=2)
def _encoding(vocabulary: str, pattern: str):
    import base64

    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("loom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _counter(count: Callable[[str], int]):
    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count(t) if t else 0).astype("int64")

    return counted


def compression_totals(before: DataFrame, after: DataFrame, count: Callable[[str], int] = count_words, content: str = "content") -> DataFrame:
    """(query_id, tokens_before, tokens_after, chunks) of each query's ranked chunks."""
    counted = _counter(count)
    own = before.groupBy("query_id").agg(F.sum(counted(content)).alias("tokens_before"))
    left = after.groupBy("query_id").agg(F.sum(counted(content)).alias("tokens_after"), F.count(F.lit(1)).alias("chunks"))
    return own.join(left, "query_id", "left").select("query_id", "tokens_before", F.coalesce("tokens_after", F.lit(0)).alias("tokens_after"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
