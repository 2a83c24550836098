"""Whole jobs: filings to chunks, and questions to answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import complexity
from ..operators.answering import Provider, ask_providers
from ..operators.chunking import chunk_sections
from ..operators.context import compress, context, count_words, prompt, sources
from ..operators.dense import Embedder, dense_search, embed
from ..operators.filings import parse
from ..operators.fusion import fuse, overlap, rerank
from ..operators.lexical import Index, build_index, search
from ..sources.scratch import kept, new_folder
from ..sources.store import init_store, read_chunk_json, seed, store_rows


def chunk_filings(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``files`` (source_file, html) -> chunks with their metadata."""
    meta = ["source_file", "ticker", "filing_type", "fiscal_period", "filename"]
    docs = parse(files).select(*meta, F.posexplode("sections").alias("section_no", "s"))
    return chunk_sections(docs.select(*meta, "section_no", F.col("s.section").alias("section"), F.col("s.text").alias("text")), settings.chunk_size, settings.chunk_overlap)


def seed_store(spark: SparkSession, chunk_folder: str, store: str, embedder: Embedder, settings: Settings = Settings(), one_per_document: bool = False) -> None:
    """Embed all chunks of a folder of chunk JSON and put them in the store, created if need be."""
    init_store(spark, store, settings.embedding_dimensions)
    chunks = read_chunk_json(spark, chunk_folder, one_per_document)
    seed(store_rows(embed(chunks, embedder, batch=settings.embedding_batch_size)), store, chunks.select(F.col("source_file").alias("source_doc")))


def retrieve(chunks: DataFrame, queries: DataFrame, keys: list[str], settings: Settings = Settings(), k: int | None = None, index: Index | None = None) -> DataFrame:
    """Hybrid candidates: dense and lexical lists, fused. ``queries``: query_id, query, q (vector).

    ``index``: that of the chunks, if there is one; else one is built for these queries.
    """
    index = index or build_index(chunks, keys, new_folder(chunks.sparkSession, "bm25"))
    dense = dense_search(chunks, queries.where("q is not null"), keys, settings.dense_top_k)
    lexical = search(index, queries, settings.bm25_top_k)
    return fuse(dense, lexical, keys, settings, k)


def with_chunks(found: DataFrame, chunks: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with their texts. They are written first: Spark then knows how few they are, and need not send all texts about to meet them."""
    found = kept(found, "candidates")
    # the semi-join goes down to the texts where ``chunks`` is itself a join
    texts = chunks.join(found.select(*keys).distinct(), keys, "left_semi")
    return found.join(texts, keys).join(queries.select("query_id", "query"), "query_id")


def reranked(candidates: DataFrame, k: int, scorer: Callable | None = overlap) -> DataFrame:
    """The k best of each query, written once and dealt to all tasks by query and rank."""
    best = kept(rerank(candidates, k, scorer), "reranked")
    return best.repartition(int(best.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id", "rank")


def ask(chunks: DataFrame, queries: DataFrame, keys: list[str], providers: Callable[[], dict[str, Provider]], settings: Settings = Settings(), k: int | None = None,
        scorer: Callable | None = overlap, index: Index | None = None, embedder: Embedder | None = None, count: Callable[[str], int] = count_words, ledger: str | None = None) -> DataFrame:
    """Answer every query: route, retrieve, rerank, compress, ask the providers, list the sources.

    ``embedder`` compresses by its vectors, ``count`` is what a token is, for the budget and for
    ``tokens_in``, and ``ledger`` keeps the answers, so that asking again asks nobody.

    Returns query_id, tier, answer, provider, tokens_in, failures, sources. Queries without any chunk are
    still asked, with an empty context.
    """
    routed = queries.withColumn("tier", complexity(F.col("query")))
    found = with_chunks(retrieve(chunks, queries, keys, settings, None, index).select("query_id", "rank", *keys), chunks.drop("embedding"), queries, keys)
    # at most k rows a query, which several branches below use
    best = kept(compress(reranked(found, k or settings.rerank_top_k, scorer), settings.context_token_budget, count=count, embedder=embedder), "compressed")
    asked = routed.join(context(best), "query_id", "left").select("query_id", "tier", prompt(F.col("context"), F.col("query")).alias("prompt"))
    answers = ask_providers(asked, providers, settings, count, ledger)
    return routed.select("query_id").join(answers, "query_id").join(sources(best), "query_id", "left").select("query_id", "tier", "answer", "provider", "tokens_in", "failures", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
