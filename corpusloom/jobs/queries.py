"""Registered queries of the retrieval library, over the driver's tables, and their DuckDB SQL.

Documents stand in for chunks (one chunk each), benchmark texts for queries, and the vector with a
query's number for its embedding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..operators import ann, answering, chunking, context, dense, filings, fusion, lexical
from ..sources import store
from ..sources.scratch import kept, new_folder
from ..sources.snapshots import fingerprint
from . import pipeline

KEYS = ["doc_id"]
S = Settings()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("text").alias("content"), F.col("source").alias("ticker"), F.col("lang").alias("filing_type"), F.lit(None).cast("string").alias("fiscal_period"), F.lit("body").alias("section"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir).join(_vectors(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q")), "query_id").select("query_id", "q")


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokenize(F.col("content"))
    return _chunks(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_stats(_chunks(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


_indexes: dict[tuple[str, str], lexical.Index] = {}


def _index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """The documents' index: built once for a session, as a user keeps one, and anew where the table's files have changed."""
    name = (spark.sparkContext.applicationId, fingerprint(spark, f"{sf_dir}/documents.parquet"))
    if name not in _indexes:
        _indexes[name] = lexical.build_index(_chunks(spark, sf_dir), KEYS, new_folder(spark, "bm25"))
    return _indexes[name]


def bm25_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_index(spark, sf_dir), _queries(spark, sf_dir), S.bm25_top_k).select("query_id", "rank", "doc_id", "score")


def dense_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dense_search(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), KEYS, S.dense_top_k).select("query_id", "rank", "doc_id", "score")


def bm25_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that has changed: half of the documents first under other texts, then all replaced and added in two writes, a tenth dropped, and searched."""
    folder, chunks = new_folder(spark, "bm25-updated"), _chunks(spark, sf_dir).select("doc_id", "content")
    lexical.build_index(chunks.where("doc_id % 2 = 0").withColumn("content", F.concat(F.lit("stale words "), "content")), KEYS, folder)
    for part in (0, 1):
        lexical.put(spark, folder, chunks.where(F.col("doc_id") % 4 < 2 if part == 0 else F.col("doc_id") % 4 >= 2))
    index = lexical.put(spark, folder, None, chunks.where("doc_id % 10 = 3").select("doc_id"))
    return lexical.search(index, _queries(spark, sf_dir), S.bm25_top_k).select("query_id", "rank", "doc_id", "score")


def _ann(spark: SparkSession, sf_dir: str) -> ann.CellIndex:
    return ann.build(_vectors(spark, sf_dir), KEYS, new_folder(spark, "ann"), k=S.dense_top_k)


def ann_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours, with how many of the index's vectors the query read."""
    index, asked = _ann(spark, sf_dir), kept(_vector_queries(spark, sf_dir), "ann-queries")
    return ann.search(index, asked, S.dense_top_k).join(ann.reads(index, asked), "query_id").select("query_id", "rank", "doc_id", "score", "read", "vectors")


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: queries, neighbours found, those of a score that isn't their cosine, and whether they have 95 % of the true ones."""
    asked, vectors = kept(_vector_queries(spark, sf_dir), "ann-queries"), _vectors(spark, sf_dir)
    got = kept(ann.search(_ann(spark, sf_dir), asked, S.dense_top_k), "ann-found")
    true = dense.dense_search(vectors, asked, KEYS, S.dense_top_k).select("query_id", "doc_id", F.lit(True).alias("true"))
    cosine = F.round(T.cosine(F.col("embedding"), F.col("q")), 6)
    checked = got.join(vectors, "doc_id").join(asked, "query_id").withColumn("wrong", F.abs(cosine - F.col("score")) > 1.5e-6).join(true, ["query_id", "doc_id"], "left")
    return checked.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("found"), F.count_if("wrong").alias("wrong_scores"), (F.count("true") >= 0.95 * F.count(F.lit(1))).alias("recall_reached"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(dense_topk_batch(spark, sf_dir), bm25_topk_batch(spark, sf_dir), KEYS, S).select("query_id", "rank", "doc_id", "score", "dense_score", "lexical_score")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.with_chunks(rrf_fusion(spark, sf_dir).select("query_id", "rank", *KEYS), _chunks(spark, sf_dir), _queries(spark, sf_dir), KEYS)


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, since it is used more than once and what follows is dealt anew: a few chunks a query, of any length."""
    return pipeline.reranked(_candidates(spark, sf_dir), S.rerank_top_k)


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("query_id", "rank", "doc_id", F.round("rerank_score", 6).alias("rerank_score"))


def route_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.complexity(F.coalesce("text", F.lit(""))).alias("tier"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.sentences(F.col("content"))
    return _chunks(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.coalesce(F.length(F.array_join(s, "")), F.lit(0)).cast("long").alias("chars"))


def sentence_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.sentence_relevance(_reranked(spark, sf_dir)).select("query_id", F.col("rank").alias("chunk_rank"), F.col("pos").cast("long").alias("pos"), F.round("sim", 6).alias("sim"), "kept")


def sentence_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance by embeddings: each different sentence and query embedded once."""
    found = context.sentence_relevance(_reranked(spark, sf_dir), embedder=dense.hashed_embedder(64))
    return found.select("query_id", F.col("rank").alias("chunk_rank"), F.col("pos").cast("long").alias("pos"), F.round("sim", 6).alias("sim"), "kept")


def observed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens before and after compression, and the vectors' lengths, as observed by the jobs that write them."""
    tokens, lengths = Observation("compression"), Observation("lengths")
    kept(context.compress(_reranked(spark, sf_dir), 600, observed=tokens), "compressed")
    kept(dense.observe_dimension(_vectors(spark, sf_dir), 64, lengths), "vectors")
    names = ["tokens_before", "tokens_after", "chunks", "chunks_after", "vectors", "other_length"]
    found = tokens.get | lengths.get
    return spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} long" for n in names))


def budget_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.compress(_reranked(spark, sf_dir), 600).select("query_id", "rank", "doc_id", "content", "compressed")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select(F.col("doc_id").alias("source_file"), F.lit(0).alias("section_no"), F.posexplode(F.split("content", "\n")).alias("pos", "content"))


def line_chunks_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.number_chunks(_lines(spark, sf_dir), S.chunk_overlap).select("source_file", "chunk_index", "char_offset", F.length("content").alias("chars"))


def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _chunks(spark, sf_dir).select(F.col("doc_id").alias("source_file"), F.lit(0).alias("section_no"), F.col("content").alias("text"))
    return chunking.chunk_sections(docs, S.chunk_size, S.chunk_overlap).select("source_file", "chunk_index", "char_offset", "content")


def last_marker_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = filings.section_slice(F.col("html"), "<h1", "</article>")
    return _table(spark, sf_dir, "pages").select("page_id", s.alias("s")).where("s is not null").select("page_id", F.col("s.char_offset").cast("long").alias("char_offset"), F.length("s.raw").cast("long").alias("chars"), F.md5("s.raw").alias("digest"))


def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", filings.clean_text(F.col("html")).alias("text"))


def filing_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of pages written as filings: header lines from the URL and page number, then parsed back."""
    p = _table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    form = F.element_at(F.array(*(F.lit(x) for x in ("10-K", "10Q", "8-K", "10K"))), (F.col("page_id") % 4 + 1).cast("int"))
    year = (F.lit(2000) + F.col("page_id") % 25).cast("string")
    said = [("<p>For the fiscal year ended June 30, ", "</p>"), ("Fiscal Year Ended&nbsp;\nSeptember 27, ", ""), ("<ix:nonNumeric name='dei:DocumentFiscalYearFocus' id='f'> ", " </ix:nonNumeric>"), ("<dei:documentfiscalyearfocus>", "</dei:documentfiscalyearfocus>"), ("fiscal year ended in ", ""), ("DocumentFiscalYearFocus ", "<p>fiscal year ended May 1, 1999")]
    worded = F.element_at(F.array(*(F.concat(F.lit(a), year, F.lit(b)) for a, b in said)), (F.floor(F.col("page_id") / 4) % len(said) + 1).cast("int"))
    head = F.concat(F.lit("<TYPE>"), form, F.lit("\n<FILENAME> "), host, F.lit("-"), F.lower(form), F.lit(".htm \n"), worded)
    files = p.select("page_id", F.concat(head, "html").alias("html"))
    html = F.col("html")
    name = filings.matched(html, filings.FILENAME)
    return files.select("page_id", filings.matched(html, filings.TYPE).alias("filing_type"), name.alias("filename"), filings.ticker(name).alias("ticker"), filings.form_of_name(name).alias("form_of_name"), filings.fiscal_period(html).alias("fiscal_period"))


def parse_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its article wrapped in a risk section, through the whole parser."""
    p = _table(spark, sf_dir, "pages")
    html = F.concat(F.lit("<TYPE>10-K\n<p>Item 1A. Risk Factors</p>"), "html", F.lit("<p>Item 1B. Unresolved</p>"))
    found = filings.parse(p.select(F.concat(F.lit("p-"), F.col("page_id").cast("string"), F.lit(".html")).alias("source_file"), html.alias("html")))
    return found.select("source_file", "ticker", "filing_type", F.size("sections").alias("n_sections"), F.col("sections")[0]["word_count"].alias("word_count"), F.array_join("warnings", ";").alias("warnings"))


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", T.words(F.col("content")).cast("long").alias("words"))


def strip_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    said = F.concat(F.lit("<think>"), "role", F.lit("\n</thinking> "), F.coalesce("text", F.lit("")), F.lit("< thinking >x</ think ><think>open"))
    return c.select("conv_id", "turn", T.strip_think(said).alias("answer"))


def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.context(_reranked(spark, sf_dir))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.sources(_reranked(spark, sf_dir)).select("query_id", F.array_join("sources", ";").alias("sources"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each provider of the chain did for each turn: by its number, an answer, a blank or an error."""
    c = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    rows = c.withColumn("p", F.explode(F.array(*(F.lit(k) for k in range(4)))))
    luck = (F.col("query_id") + 3 * F.col("p")) % 5
    name = F.element_at(F.array(*(F.lit(x) for x in S.fallback_chain)), F.col("p") + 1)
    said = F.when(luck == 0, F.concat(F.lit("<think>hm</think> "), "text")).when(luck == 1, F.lit("<think>only</think> "))
    return rows.where(luck != 4).select("query_id", name.alias("provider"), said.alias("answer"), F.when(luck > 1, F.lit("RateLimitError")).alias("error"))


def fallback_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.resolve(_outcomes(spark, sf_dir), list(S.fallback_chain)).select("query_id", "provider", F.md5("answer").alias("answer_md5"), "n_failures", "error")


def dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dimension_check(_vectors(spark, sf_dir), 64)


def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed embeddings of all documents; a row per document with its vector's length, norm, filled bins and largest bin."""
    found = dense.embed(_chunks(spark, sf_dir).select("doc_id", "content"), dense.hashed_embedder(64))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return found.select("doc_id", F.size("embedding").alias("dimensions"), F.round(norm, 4).alias("norm"),
                        F.size(F.filter("embedding", lambda x: x > 0)).alias("filled"), F.array_position("embedding", F.array_max("embedding")).alias("largest"))


def chunk_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents as chunks: to JSON, back, embedded, appended once and seeded twice, and reread."""
    meta = [F.lit("T").alias("ticker"), F.lit("10-K").alias("filing_type"), F.lit(None).cast("string").alias("fiscal_period"), F.lit("body").alias("section")]
    # named before they are numbered: lines that lie by document are then put together where they are
    named = _lines(spark, sf_dir).withColumn("source_file", F.concat(F.lit("d-"), F.col("source_file").cast("string")))
    lines = chunking.number_chunks(named, S.chunk_overlap)
    root = new_folder(spark, "roundtrip")
    store.write_chunk_json(lines.select("source_file", "chunk_index", "char_offset", "content", *meta), root + "/json")
    settings = Settings(embedding_dimensions=16)
    embedder = dense.build_embedder("hashed", 16)
    store.init_store(spark, root + "/store", 16)
    store.append(store.store_rows(dense.embed(store.read_chunk_json(spark, root + "/json"), embedder)), root + "/store")
    for _ in range(2):
        pipeline.seed_store(spark, root + "/json", root + "/store", embedder, settings)
    return store.read_store(spark, root + "/store").select("source_doc", "chunk_index", "char_offset", "section", "fiscal_period", F.md5("content").alias("digest"), F.size("embedding").alias("dimensions"))


def _echo() -> dict:
    """Offline providers: the first is always overloaded, the second quotes the prompt's end."""

    def busy(prompt: str) -> str:
        raise TimeoutError("busy")

    return {"openai": busy, "groq": lambda prompt: "<think>.</think>" + prompt[-200:]}


def ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every benchmark text answered from all documents."""
    chunks = _chunks(spark, sf_dir).join(_vectors(spark, sf_dir), "doc_id", "left")
    queries = _queries(spark, sf_dir).join(_vector_queries(spark, sf_dir), "query_id", "left")
    found = pipeline.ask(chunks, queries, KEYS, _echo, S, index=_index(spark, sf_dir))
    return found.select("query_id", "tier", "tokens_in", "answer", "provider", F.size("failures").alias("n_failures"), F.array_join("sources", ";").alias("sources"))


def ask_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns asked through a ledger: first every other one, then all, by providers that quote the prompt's end; how often each was asked."""
    turns = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.lit("normal").alias("tier"), F.coalesce("text", F.lit("")).alias("prompt"))
    ledger = new_folder(spark, "ledger")
    kept(answering.ask_providers(turns.where("query_id % 2 = 0"), _echo, S, ledger=ledger), "first")
    found = kept(answering.ask_providers(turns, _echo, S, ledger=ledger), "second")
    times = answering.read_ledger(spark, ledger).groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    said = turns.select("query_id", F.sha2("prompt", 256).alias("key")).join(times, "key", "left")
    return found.join(said, "query_id").select("query_id", F.md5("answer").alias("answer_md5"), "provider", "tokens_in", F.coalesce("times", F.lit(0)).alias("times"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        tokenize_counts, term_stats, bm25_topk_batch, bm25_updated, dense_topk_batch, ann_topk_batch, ann_recall, rrf_fusion, rerank_topk, route_complexity, sentence_split, sentence_relevance, sentence_similarity, budget_fold, observed_metrics,
        line_chunks_offsets, recursive_chunks, last_marker_slice, html_clean, filing_meta, parse_filings, word_count, strip_think, context_block, sources,
        fallback_resolution, dim_check, embed_batches, chunk_store_roundtrip, ask, ask_again,
    ]
    return {f.__name__: f for f in found}


# --- the same in DuckDB -----------------------------------------------------------------------

_TOKENS = r"regexp_extract_all(lower({}), '\$?\d+(?:[.,]\d+)*%?|[A-Za-z]+')"
_DOCS = _TOKENS.format("text")
_STATS = f"""
    toks AS (SELECT doc_id, {_DOCS} AS ts FROM documents),
    n AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks),
    post AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM toks),
    tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM post GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, n),
    idf AS (SELECT term, df, CASE WHEN raw >= 0 THEN raw ELSE (SELECT avg(raw) * 0.25 FROM raw) END AS idf FROM raw)"""
_BM25 = f"""{_STATS},
    qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_DOCS}) AS term FROM benchmark) GROUP BY ALL),
    sc AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
           FROM tf JOIN qt USING (term) JOIN idf USING (term), n GROUP BY ALL),
    bm AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM sc WHERE s > 0 QUALIFY rank <= 20)"""
_DENSE = """
    dn AS (SELECT q.vec_id AS query_id, (row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC NULLS LAST, v.vec_id))::INT AS rank,
                  v.vec_id AS doc_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
           FROM embeddings v, embeddings q SEMI JOIN benchmark b ON q.vec_id = b.item_id QUALIFY rank <= 20)"""
_FUSED = f"""{_BM25}, {_DENSE},
    both_ AS (SELECT query_id, doc_id, 0 AS l, rank, 0.6::DOUBLE / (60 + rank) AS part FROM dn UNION ALL SELECT query_id, doc_id, 1, rank, 0.4::DOUBLE / (60 + rank) FROM bm),
    fu AS (SELECT query_id, doc_id, round(sum(part), 9) AS score, round(sum(CASE WHEN l = 0 THEN part ELSE 0 END), 9) AS dense_score, round(sum(CASE WHEN l = 1 THEN part ELSE 0 END), 9) AS lexical_score,
                  min(l * 1000 + rank) AS seen FROM both_ GROUP BY ALL),
    fr AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen))::INT AS rank, doc_id, score, dense_score, lexical_score FROM fu QUALIFY rank <= 20)"""
_RERANKED = f"""{_FUSED},
    ca AS (SELECT fr.query_id, fr.rank AS old, doc_id, d.text, d.source, d.lang, b.text AS query FROM fr JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = fr.query_id),
    ov AS (SELECT *, list_distinct({_TOKENS.format('query')}) AS qd FROM ca),
    re AS (SELECT query_id, doc_id, text, source, lang, query, CASE WHEN len(qd) = 0 THEN 0 ELSE len(list_intersect(qd, {_DOCS})) / len(qd) END AS rerank_score, old FROM ov),
    rr AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old))::INT AS rank FROM re QUALIFY rank <= 8)"""
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: len(x) > 0)"


def _any(phrases: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(q, '{p}')" for p in phrases)


_TIER = f"CASE WHEN {_any(T.COMPLEX)} THEN 'complex' WHEN {_any(T.SIMPLE)} THEN 'simple' ELSE 'normal' END"
_LABEL = "coalesce(source, 'None') || ' ' || coalesce(lang, 'None') || ' None | body'"
#: What stands before, between and after the passages and the question.
_PROMPT = (
    "Use nothing but the numbered passages to answer, and name the passages you rely on as [n]. If they do not hold the answer, say that it is missing.\n\n# Passages\n",
    "\n\n# Question\n", "\n\n# Answer\n",
)
_RELEVANT = f"""{_RERANKED},
    se AS (SELECT query_id, rank AS chunk_rank, query, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT query_id, rank, query, {_SENTENCES.format('text')} AS s FROM rr)),
    tk AS (SELECT *, {_TOKENS.format('query')} AS a, {_TOKENS.format('sentence')} AS b FROM se),
    cs AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda t: len(list_filter(a, lambda u: u = t)) * len(list_filter(b, lambda u: u = t)))) AS dot,
                     sqrt(list_sum(list_transform(list_distinct(a), lambda t: len(list_filter(a, lambda u: u = t)) ** 2))) * sqrt(list_sum(list_transform(list_distinct(b), lambda t: len(list_filter(b, lambda u: u = t)) ** 2))) AS nn FROM tk),
    si AS (SELECT query_id, chunk_rank, pos, sentence, round(coalesce(CASE WHEN nn > 0 THEN dot / nn END, 0), 9) AS sim FROM cs),
    rl AS (SELECT *, sim >= max(sim) OVER (PARTITION BY query_id, chunk_rank) * 0.6::DOUBLE AS kept FROM si)"""


def _folded(budget: int) -> str:
    """``fo``: each query's chunks in rank order, cut to what is left of the budget, as far as it goes."""
    return rf"""
    nw AS (SELECT *, len(regexp_extract_all(sentence, '\S+')) AS n FROM rl),
    ac AS (SELECT *, sum(n) FILTER (kept) OVER (PARTITION BY query_id, chunk_rank ORDER BY pos) AS upto FROM nw),
    ck AS (SELECT query_id, chunk_rank AS rank, list(sentence ORDER BY pos) FILTER (kept) AS said, list(upto ORDER BY pos) FILTER (kept) AS upto, first(sentence ORDER BY sim DESC, pos) AS best,
                  row_number() OVER (PARTITION BY query_id ORDER BY chunk_rank) AS o FROM ac GROUP BY query_id, chunk_rank),
    st AS (SELECT query_id, 0::BIGINT AS o, 0::BIGINT AS used, 0::INT AS rank, ''::VARCHAR AS cut FROM ck WHERE o = 1
           UNION ALL
           SELECT query_id, o, (used + len(regexp_extract_all(cut, '\S+')))::BIGINT, rank, cut FROM (
               SELECT query_id, o, used, rank, CASE WHEN fits = 0 THEN substring(best, 1, greatest(({budget} - used) * 4, 8)) ELSE array_to_string(said[1:fits], ' ') END AS cut
               FROM (SELECT st.query_id, ck.o, used, ck.rank, said, best, len(list_filter(upto, lambda u: u <= {budget} - used)) AS fits FROM st JOIN ck ON ck.query_id = st.query_id AND ck.o = st.o + 1 WHERE used < {budget}))),
    fo AS (SELECT query_id, rank, cut FROM st WHERE o > 0)"""


#: Markup nodes: scripts, styles and comments whole, tags, runs of text. The pages hold four named references.
_NODES = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|</?[a-z][^>]*>|<![^>]*>|[^<]+|<"


def _cleaned(html: str) -> str:
    """The list of paragraphs of a piece of HTML."""
    return rf"""list_filter(list_transform(string_split(array_to_string(list_transform(regexp_extract_all({html}, '{_NODES}'), lambda x: CASE
        WHEN regexp_matches(x, '(?i)^<(?:script|style)') THEN regexp_extract(x, '(?s)^<[^>]*>(.*)<', 1) WHEN starts_with(x, '<!--') THEN x[5:-4]
        WHEN regexp_matches(x, '(?i)^</?(?:p|div|li|h[1-6]|tr|br)[\s/>]') THEN chr(1) WHEN regexp_matches(x, '(?is)^<[/a-z!]') THEN ''
        ELSE regexp_replace(replace(regexp_replace(regexp_replace(x, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;', '"'), '&amp;?', '&', 'g') END), ' '), chr(1)),
        lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"""


def _separator(text: str, least: int | str) -> str:
    """Number of the first separator, from a given one on, that a text has."""
    return "CASE " + " ".join(f"WHEN {least} <= {k} AND contains({text}, '{s}') THEN {k}" for k, s in enumerate((r"\n\n", r"\n", ". ", " "))).replace(r"'\n\n'", "chr(10) || chr(10)").replace(r"'\n'", "chr(10)") + " ELSE 4 END"


#: The pieces of a text by its separator, which stays at the head of the next piece; the last one cuts everywhere.
_PIECES = """list_filter(CASE WHEN sep = 4 THEN list_transform(range(1, length(text) + 1), lambda i: substring(text, i, 1))
    ELSE list_transform(string_split(text, [chr(10) || chr(10), chr(10), '. ', ' '][sep + 1]), lambda x, i: CASE WHEN i = 1 THEN x ELSE [chr(10) || chr(10), chr(10), '. ', ' '][sep + 1] || x END) END, lambda x: x <> '')"""


def oracle_sql() -> dict[str, str]:
    think = r"'<\s*think(?:ing)?\s*>.*?<\s*/\s*think(?:ing)?\s*>', '', 'gs'"
    strip = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    chain = ", ".join(f"'{p}'" for p in S.fallback_chain)
    return {
        "tokenize_counts": f"SELECT doc_id, len({_DOCS})::BIGINT AS n_tokens, len(list_distinct({_DOCS}))::BIGINT AS n_distinct FROM documents",
        "term_stats": f"WITH {_STATS} SELECT term, df, round(idf, 6) AS idf FROM idf",
        "bm25_topk_batch": f"WITH {_BM25} SELECT * FROM bm",
        "bm25_updated": f"WITH {_BM25.replace('FROM documents', 'FROM (SELECT * FROM documents WHERE doc_id % 10 <> 3)')} SELECT * FROM bm",
        "dense_topk_batch": f"WITH {_DENSE} SELECT * FROM dn",
        "ann_recall": f"WITH {_DENSE} SELECT count(DISTINCT query_id) AS queries, count(*) AS found, 0::BIGINT AS wrong_scores, true AS recall_reached FROM dn",
        "rrf_fusion": f"WITH {_FUSED} SELECT * FROM fr",
        "rerank_topk": f"WITH {_RERANKED} SELECT query_id, rank, doc_id, round(rerank_score, 6) AS rerank_score FROM rr",
        "route_complexity": f"SELECT conv_id, turn, {_TIER} AS tier FROM (SELECT *, {strip('lower(coalesce(text, chr(32)))')} AS q FROM conversations)",
        "sentence_split": f"SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(length(array_to_string(s, '')), 0)::BIGINT AS chars FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents)",
        "sentence_relevance": f"WITH {_RELEVANT} SELECT query_id, chunk_rank, pos::BIGINT AS pos, round(sim, 6) AS sim, kept FROM rl",
        "sentence_similarity": rf"""WITH {_RERANKED},
            se AS MATERIALIZED (SELECT query_id, rank AS chunk_rank, query, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT query_id, rank, query, {_SENTENCES.format('text')} AS s FROM rr)),
            tx AS MATERIALIZED (SELECT DISTINCT sentence AS text FROM se UNION SELECT DISTINCT query FROM se),
            bn AS (SELECT text, ('0x' || substring(md5(word), 1, 8))::BIGINT % 64 AS bin, count(*) AS n FROM (SELECT text, unnest(regexp_extract_all(lower(text), '\S+')) AS word FROM tx) GROUP BY ALL),
            nm AS (SELECT text, sqrt(sum(n * n)) AS norm FROM bn GROUP BY text),
            ve AS MATERIALIZED (SELECT text, list(v ORDER BY bin) AS v FROM (SELECT text, bin, max(v) AS v FROM (SELECT text, bin, (n / norm)::FLOAT::DOUBLE AS v FROM bn JOIN nm USING (text) UNION ALL SELECT text, b, 0 FROM nm, range(64) r(b)) GROUP BY ALL) GROUP BY text),
            cn AS (SELECT query_id, chunk_rank, pos, round(list_cosine_similarity(x.v, y.v), 9) AS sim FROM se JOIN ve x ON x.text = query JOIN ve y ON y.text = sentence)
            SELECT query_id, chunk_rank, pos::BIGINT AS pos, round(sim, 6) AS sim, sim >= max(sim) OVER (PARTITION BY query_id, chunk_rank) * 0.6::DOUBLE AS kept FROM cn""",
        "observed_metrics": rf"""WITH RECURSIVE {_RELEVANT}, {_folded(600)},
            wb AS (SELECT sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS tokens_before, count(*) AS chunks FROM rr),
            wa AS (SELECT sum(len(regexp_extract_all(cut, '\S+')))::BIGINT AS tokens_after, count(*) AS chunks_after FROM fo)
            SELECT tokens_before, tokens_after, chunks, chunks_after, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FILTER (coalesce(len(embedding), -1) <> 64) FROM embeddings) AS other_length FROM wb, wa""",
        "budget_fold": f"WITH RECURSIVE {_RELEVANT}, {_folded(600)} SELECT query_id, rank, doc_id, cut AS content, cut <> text AS compressed FROM fo JOIN rr USING (query_id, rank)",
        "ask": f"""WITH RECURSIVE held AS (SELECT * FROM embeddings SEMI JOIN documents ON vec_id = doc_id), {_RELEVANT.replace('embeddings v', 'held v')}, {_folded(S.context_token_budget)},
            be AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, {_LABEL} AS label FROM fo JOIN rr USING (query_id, rank)),
            co AS (SELECT query_id, string_agg('[' || place || '] (source: ' || coalesce(source, 'None') || ', ' || coalesce(lang, 'None') || ', None, body)' || chr(10) || {strip('cut')}, chr(10) || chr(10) ORDER BY rank) AS context,
                          string_agg(DISTINCT label, ';' ORDER BY label) AS sources FROM be GROUP BY query_id),
            pr AS (SELECT item_id AS query_id, text AS query, '{_PROMPT[0]}' || coalesce(context, '') || '{_PROMPT[1]}' || text || '{_PROMPT[2]}' AS prompt, coalesce(sources, '') AS sources FROM benchmark LEFT JOIN co ON query_id = item_id)
            SELECT query_id, {_TIER} AS tier, len(regexp_extract_all(prompt, '\\S+'))::BIGINT AS tokens_in, {strip('right(prompt, 200)')} AS answer, 'groq' AS provider, 1 AS n_failures, sources
            FROM (SELECT *, {strip('lower(query)')} AS q FROM pr)""",
        "line_chunks_offsets": """WITH l AS (SELECT doc_id AS source_file, unnest(s) AS c, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))
            SELECT source_file, pos::INT AS chunk_index, coalesce(sum(greatest(length(c) - 150, 0)) OVER (PARTITION BY source_file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS char_offset, length(c)::INT AS chars FROM l""",
        "recursive_chunks": rf"""WITH RECURSIVE w AS (
                SELECT doc_id, []::INT[] AS path, text, {_separator('text', 0)} AS sep FROM documents WHERE text <> ''
                UNION ALL
                SELECT doc_id, list_append(path, k::INT), piece, {_separator('piece', 'sep + 1')} FROM (SELECT doc_id, path, sep, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM (SELECT *, {_PIECES} AS ps FROM w)) WHERE length(piece) >= {S.chunk_size} AND sep < 4),
            p AS (SELECT doc_id, path, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM (SELECT *, {_PIECES} AS ps FROM w)),
            g AS (SELECT *, count(*) FILTER (length(piece) >= {S.chunk_size}) OVER (PARTITION BY doc_id, path ORDER BY k) AS run FROM p),
            r AS MATERIALIZED (SELECT doc_id, path, run, list(piece ORDER BY k) AS ps, list(k ORDER BY k) AS ks, list(upto ORDER BY k) AS cs, [0::HUGEINT] || list(upto ORDER BY k) AS c0
                FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, path, run ORDER BY k) AS upto FROM g WHERE length(piece) < {S.chunk_size}) GROUP BY ALL),
            f AS (SELECT doc_id, path, run, 1::BIGINT AS a, len(list_filter(cs, lambda x: x <= {S.chunk_size}))::BIGINT AS b FROM r
                UNION ALL
                SELECT doc_id, path, run, a2, len(list_filter(cs, lambda x: x - c0[a2] <= {S.chunk_size}))::BIGINT FROM (
                    SELECT r.doc_id, r.path, r.run, cs, c0, greatest(a, 1 + len(list_filter(c0[1:b], lambda x: cs[b] - x > least({S.chunk_overlap}, {S.chunk_size} - (cs[b + 1] - cs[b])))))::BIGINT AS a2
                    FROM f JOIN r ON f.doc_id = r.doc_id AND f.path = r.path AND f.run = r.run WHERE b < len(cs))),
            c AS (SELECT r.doc_id, list_append(r.path, ks[b]::INT) AS place, {strip("array_to_string(ps[a:b], '')")} AS content FROM f JOIN r ON f.doc_id = r.doc_id AND f.path = r.path AND f.run = r.run),
            o AS (SELECT doc_id AS source_file, content, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS i FROM c WHERE content <> '')
            SELECT source_file, i::INT AS chunk_index, coalesce(sum(greatest(length(content) - {S.chunk_overlap}, 0)) OVER (PARTITION BY source_file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS char_offset, content FROM o""",
        "last_marker_slice": """WITH m AS (SELECT page_id, html, regexp_matches(html, '(?is)<h1') AS has, length(regexp_extract(html, '(?is)^(.*)<h1', 1)) AS a,
                CASE WHEN regexp_matches(html, '(?is)</article>') THEN length(regexp_extract(html, '(?is)^(.*)</article>', 1)) ELSE length(html) END AS b FROM pages)
            SELECT page_id, a::BIGINT AS char_offset, (b - a)::BIGINT AS chars, md5(substring(html, a + 1, b - a)) AS digest FROM m WHERE has AND b > a""",
        "chunk_store_roundtrip": r"""WITH l AS (SELECT doc_id, unnest(s) AS c, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
            o AS (SELECT *, coalesce(sum(greatest(length(c) - 150, 0)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS char_offset FROM l)
            SELECT 'd-' || doc_id AS source_doc, pos::INT AS chunk_index, char_offset, 'body' AS section, NULL::VARCHAR AS fiscal_period, md5(c) AS digest, 16 AS dimensions FROM o WHERE regexp_matches(c, '\S')""",
        "html_clean": f"SELECT page_id, CASE WHEN html IS NOT NULL THEN coalesce(array_to_string({_cleaned('html')}, chr(10) || chr(10)), '') END AS text FROM pages",
        "parse_filings": rf"""SELECT 'p-' || page_id || '.html' AS source_file, 'p' AS ticker, '10-K' AS filing_type, 1 AS n_sections, len(regexp_extract_all(array_to_string(ps, ' '), '\S+'))::INT AS word_count,
                'Section ''Item 7 MD&A'' could not be extracted' AS warnings FROM (SELECT page_id, {_cleaned("('Item 1A. Risk Factors</p>' || html || '<p>')")} AS ps FROM pages)""",
        "filing_meta": r"""WITH f AS (SELECT page_id, ['10-K', '10Q', '8-K', '10K'][page_id % 4 + 1] AS form, regexp_extract(url, '://([^/?#]*)', 1) AS host,
                ['<p>For the fiscal year ended June 30, ' || (2000 + page_id % 25) || '</p>', 'Fiscal Year Ended&nbsp;' || chr(10) || 'September 27, ' || (2000 + page_id % 25),
                 '<ix:nonNumeric name=''dei:DocumentFiscalYearFocus'' id=''f''> ' || (2000 + page_id % 25) || ' </ix:nonNumeric>', '<dei:documentfiscalyearfocus>' || (2000 + page_id % 25) || '</dei:documentfiscalyearfocus>',
                 'fiscal year ended in ' || (2000 + page_id % 25), 'DocumentFiscalYearFocus ' || (2000 + page_id % 25) || '<p>fiscal year ended May 1, 1999'][((page_id // 4) % 6 + 1)::INT] || html AS t FROM pages)
            SELECT page_id, form AS filing_type, host || '-' || lower(form) || '.htm' AS filename, coalesce(nullif(string_split(host, '-')[1], ''), 'unknown') AS ticker,
                   CASE form WHEN '10K' THEN '10-K' ELSE form END AS form_of_name,
                   'FY' || coalesce(nullif(regexp_extract(t, 'DocumentFiscalYearFocus[^>]*>\s*(\d{4})\s*<', 1, 'i'), ''), nullif(regexp_extract(t, 'fiscal year ended(?:&nbsp;|\s)*[A-Za-z]+(?:&nbsp;|\s)*\d{1,2},(?:&nbsp;|\s)*(\d{4})', 1, 'i'), '')) AS fiscal_period FROM f""",
        "word_count": r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS words FROM documents",
        "strip_think": f"""SELECT conv_id, turn, {strip(f"regexp_replace('<think>' || role || chr(10) || '</thinking> ' || coalesce(text, '') || '< thinking >x</ think ><think>open', {think})")} AS answer FROM conversations""",
        "context_block": f"""WITH {_RERANKED} SELECT query_id, string_agg('[' || rank || '] (source: ' || coalesce(source, 'None') || ', ' || coalesce(lang, 'None') || ', None, body)' || chr(10) || {strip('text')}, chr(10) || chr(10) ORDER BY rank) AS context
            FROM rr GROUP BY query_id""",
        "sources": f"WITH {_RERANKED} SELECT query_id, string_agg(DISTINCT coalesce(source, 'None') || ' ' || coalesce(lang, 'None') || ' None | body', ';' ORDER BY coalesce(source, 'None') || ' ' || coalesce(lang, 'None') || ' None | body') AS sources FROM rr GROUP BY query_id",
        "fallback_resolution": f"""WITH o AS (SELECT conv_id * 1000 + turn AS query_id, text, p, (conv_id * 1000 + turn + 3 * p) % 5 AS luck FROM conversations, range(4) r(p)),
            g AS (SELECT query_id, min(CASE WHEN luck = 0 AND length({strip("text")}) > 0 THEN p END) AS won, any_value(text) AS text FROM o WHERE luck <> 4 GROUP BY query_id)
            SELECT query_id, [{chain}][won + 1] AS provider, CASE WHEN won IS NOT NULL THEN md5({strip('text')}) END AS answer_md5, coalesce(won, {len(S.fallback_chain)})::INT AS n_failures,
                   CASE WHEN won IS NULL THEN 'all providers failed' END AS error FROM g""",
        "ask_again": f"""WITH p AS (SELECT conv_id * 1000 + turn AS query_id, coalesce(text, '') AS prompt, {strip("right(coalesce(text, ''), 200)")} AS said FROM conversations)
            SELECT query_id, CASE WHEN said <> '' THEN md5(said) END AS answer_md5, CASE WHEN said <> '' THEN 'groq' END AS provider, len(regexp_extract_all(prompt, '\\S+'))::BIGINT AS tokens_in,
                   CASE WHEN said <> '' THEN 1 ELSE 0 END::BIGINT AS times FROM p""",
        "dim_check": "SELECT count(*) AS vectors, count(*) FILTER (coalesce(len(embedding), -1) <> 64) AS other_length FROM embeddings",
        "embed_batches": r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\S+')) AS word FROM documents),
            c AS (SELECT doc_id, ('0x' || substring(md5(word), 1, 8))::BIGINT % 64 + 1 AS bin, count(*) AS n FROM w GROUP BY ALL)
            SELECT doc_id, 64 AS dimensions, 1.0::DOUBLE AS norm, count(*)::INT AS filled, first(bin ORDER BY n DESC, bin) AS largest FROM c GROUP BY doc_id""",
    }
