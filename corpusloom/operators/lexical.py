"""BM25 over a corpus of any size: statistics as aggregations, scoring as joins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokenize
from ..sources.scratch import kept, new_folder
from ..sources.snapshots import Conflict, Snapshots

K1, B, EPSILON = 1.5, 0.75, 0.25


def corpus_stats(chunks: DataFrame, text: str = "content") -> DataFrame:
    """One row: chunks, and their average number of tokens, empty ones included."""
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokenize(F.coalesce(F.col(text), F.lit(""))))).alias("avgdl"))


def posting_list(chunks: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """(term, *keys, dl, tf): how often each chunk has each of its terms, and its length."""
    split = chunks.select(*keys, tokenize(F.col(text)).alias("tokens")).withColumn("dl", F.size("tokens"))
    return split.select(*keys, "dl", F.explode("tokens").alias("term")).groupBy("term", *keys, "dl").agg(F.count(F.lit(1)).alias("tf"))


def term_weights(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``df`` (term, df) -> (term, df, idf): rare terms by log odds; terms in over half the chunks get a share of the mean."""
    raw = F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    known = df.crossJoin(F.broadcast(stats)).select("term", "df", raw.alias("raw"))  # one row
    mean = known.agg((F.avg("raw") * EPSILON).alias("floor"))  # one row
    return known.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") >= 0, F.col("raw")).otherwise(F.col("floor")).alias("idf"))


def term_stats(chunks: DataFrame, text: str = "content") -> DataFrame:
    """(term, df, idf) of a corpus without an index."""
    df = chunks.select(F.explode(F.array_distinct(tokenize(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return term_weights(df, corpus_stats(chunks, text))


@dataclass(frozen=True)
class Index:
    """An index at a snapshot: ``blocks`` of postings, ``frequencies`` of terms, ``gone`` (range, key: what segments have lost); ``unique``: no two chunks share their keys."""

    keys: list[str]
    chunks: int
    avgdl: float | None
    floor: float | None
    buckets: int
    blocks: DataFrame
    frequencies: DataFrame
    gone: DataFrame | None
    unique: bool = False


# A block holds the postings of one term in one range of chunks: RANGE that stand together in the
# input. Most and fewest are of those postings, so that no chunk's share of a score exceeds what
# they give. Blocks of a term lie in one bucket, which is a folder, and in several files of it.
# The block of the term EVERY, which no text has, lists a range's chunks.
RANGE, BUCKETS, SPREAD, EVERY = 64, 32, 4, ""
#: Written in each snapshot; an index of another layout has to be built anew.
LAYOUT = 2
#: Distinct terms of a batch that the scan is narrowed to, by bucket and name; a larger batch reads all.
NAMED_TERMS = 500
#: Ranges of the best bounds that give a query's first k-th score.
FIRST = 4
#: Queries that are searched for at once, their weights sent to all tasks; more go in several rounds.
QUERIES_AT_ONCE = 1_000


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _tasks(spark: SparkSession) -> int:
    """By number, since Spark puts partitions together by their bytes, and texts of few bytes are much work."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _write_segment(chunks: DataFrame, keys: list[str], folder: str, name: str, text: str, buckets: int) -> None:
    """Blocks, frequencies and keys of ``chunks``: texts are dealt by range once, and all counting is done there."""
    number = F.xxhash64(F.lit(name), F.floor(F.monotonically_increasing_id() / RANGE))
    chunks.select(F.struct(*keys).alias("key")).write.parquet(f"{folder}/{name}/keys")
    tasks = _tasks(chunks.sparkSession)
    dealt = chunks.select(F.struct(*keys).alias("key"), F.col(text).alias("text"), number.alias("range")).where("text is not null").repartition(tasks, "range")
    split = dealt.select("range", "key", tokenize(F.col("text")).alias("tokens"))
    counted = split.select("range", "key", F.size("tokens").alias("dl"), F.explode(F.concat("tokens", F.array(F.lit(EVERY)))).alias("term")).groupBy("range", "term", "key", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    blocks = counted.groupBy("range", "term").agg(F.max("tf").alias("most"), F.min("dl").alias("fewest"), F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tokens"), F.collect_list(F.struct("key", "dl", "tf")).alias("postings"))
    placed = blocks.withColumn("bucket", _bucket(F.col("term"), buckets)).repartition(tasks, "bucket", F.pmod("range", F.lit(SPREAD)))
    placed.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/{name}/blocks")


def _write_frequencies(counts: DataFrame, path: str) -> None:
    counts.select("term", F.col("df").cast("long").alias("df"), F.col("tokens").cast("long").alias("tokens")).sortWithinPartitions("term").write.parquet(path)


def _floor(frequencies: DataFrame, n: int) -> float | None:
    """The share of the mean weight that terms in over half the chunks get."""
    raw = F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    return frequencies.agg(F.avg(raw) * EPSILON).first()[0]


def _read(spark: SparkSession, folder: str, content: dict, name: str, segments: list[dict] | None = None) -> DataFrame:
    """A table of all segments, with the segment's number; what a segment has lost is in its counts already."""
    key = content["key"]
    schema = {
        "keys": f"key {key}", "gone": f"key {key}", "lost": f"range long, key {key}", "frequencies": "term string, df long, tokens long",
        "blocks": f"range long, term string, most int, fewest int, df long, tokens long, postings array<struct<key:{key},dl:int,tf:int>>, bucket int",
    }[name]
    at = lambda s: s.get("counts", s["data"]) if name in ("frequencies", "lost") else s["data"]
    parts = [spark.read.schema(schema).parquet(f"{folder}/{at(s)}/{name}").withColumn("seq", F.lit(s["seq"])) for s in (content["segments"] if segments is None else segments)]
    return reduce(DataFrame.unionByName, parts)


def _merged(spark: SparkSession, folder: str, content: dict) -> DataFrame:
    """(term, df, tokens) of all segments, less what they have lost."""
    found = _read(spark, folder, content, "frequencies").drop("seq")
    if len(content["segments"]) == 1:
        return found
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens")).where("df > 0")


def _open(spark: SparkSession, folder: str, content: dict) -> Index:
    if content.get("layout") != LAYOUT:
        raise ValueError(f"the index in {folder} has another layout; build it anew")
    lost = [s for s in content["segments"] if s["loses"]]
    gone = _read(spark, folder, content, "lost", lost).drop("seq") if lost else None
    avgdl = content["tokens"] / content["n"] if content["n"] else None
    return Index(content["keys"], content["n"], avgdl, content["floor"], content["buckets"], _read(spark, folder, content, "blocks"), _merged(spark, folder, content), gone, all(s["unique"] for s in content["segments"]))


def build_index(chunks: DataFrame, keys: list[str], folder: str, text: str = "content", buckets: int = BUCKETS) -> Index:
    """Index a corpus and publish it in ``folder``, in place of what is there.

    Chunks without a token, or null, count in the statistics alone. Chunks that share their keys
    count one by one, and their scores are added up. Whoever has the index open goes on with the
    snapshot that it opened.
    """
    table, key = Snapshots(chunks.sparkSession, folder), chunks.select(F.struct(*keys).alias("key")).schema["key"].dataType.simpleString()
    segment = _segment(table, chunks, keys, text, buckets)
    content = {"layout": LAYOUT, "keys": keys, "key": key, "buckets": buckets, "segments": [segment | {"seq": 1}], "next": 2, "n": segment["n"], "tokens": segment["tokens"]}
    content["floor"] = _floor(_merged(table.spark, table.folder, content), content["n"])
    table.update(lambda old: content)
    return _open(table.spark, table.folder, content)


def _segment(table: Snapshots, chunks: DataFrame, keys: list[str], text: str, buckets: int) -> dict:
    name, spark = table.new_data(), table.spark
    at = f"{table.folder}/{name}"
    _write_segment(chunks, keys, table.folder, name, text, buckets)
    counts = spark.read.schema("term string, df long, tokens long").parquet(f"{at}/blocks").where(F.col("term") != EVERY).groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))
    _write_frequencies(counts, f"{at}/frequencies")
    tokens = spark.read.schema("tokens long").parquet(f"{at}/frequencies").agg(F.sum("tokens")).first()[0] or 0
    n, different = spark.read.parquet(f"{at}/keys").groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    return {"data": name, "n": n, "unique": n == different, "tokens": tokens, "loses": False}


def put(spark: SparkSession, folder: str, chunks: DataFrame | None, removed: DataFrame | None = None, text: str = "content") -> Index:
    """Add chunks to an index, in place of those with the same keys, and drop those of ``removed`` (keys); one commit.

    The new chunks are a segment of their own. What older segments lose is named beside it, with
    its counts to be taken off the statistics, for which the lost chunks are looked up in the lists
    of their ranges, and their postings by range. If another writer publishes first, they are counted again on what it left.
    """
    table = Snapshots(spark, folder)
    version, content = table.read()
    key = T.StructType.fromDDL(f"key {content['key']}")
    if chunks is None:
        chunks = spark.createDataFrame([], key).select("key.*").withColumn(text, F.lit(None).cast("string"))
    segment = _segment(table, chunks.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in key["key"].dataType), text), content["keys"], text, content["buckets"])
    at = f"{folder}/{segment['data']}"
    gone = spark.read.schema(key).parquet(f"{at}/keys")
    if removed is not None:
        gone = gone.unionByName(removed.select(F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in key["key"].dataType)).alias("key")))
    gone.distinct().write.parquet(f"{at}/gone")
    while True:
        lost = spark.read.schema(key).parquet(f"{at}/gone").withColumnRenamed("key", "lost")
        own = F.col("key").eqNullSafe(F.col("lost"))
        n = _live_keys(spark, folder, content).join(lost, own, "left_semi").count()
        counts = table.new_data()  # of this attempt alone
        index = _open(spark, folder, content)
        _listed(index).join(lost, own, "left_semi").write.parquet(f"{folder}/{counts}/lost")
        old = _by_range(spark.read.schema(f"range long, key {content['key']}").parquet(f"{folder}/{counts}/lost"), "lost")
        tfs = F.transform(F.filter("postings", lambda p: F.array_contains("lost", p["key"])), lambda p: p["tf"])
        taken = index.blocks.where(F.col("term") != EVERY).select("range", "term", "postings").join(old, "range").select("term", tfs.alias("tfs"))
        minus = taken.groupBy("term").agg((-F.sum(F.size("tfs"))).alias("df"), (-F.sum(_total("tfs"))).alias("tokens"))
        fresh = spark.read.schema("term string, df long, tokens long").parquet(f"{at}/frequencies")
        _write_frequencies(fresh.unionByName(minus).groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens")), f"{folder}/{counts}/frequencies")
        tokens = spark.read.schema("tokens long").parquet(f"{folder}/{counts}/frequencies").agg(F.sum("tokens")).first()[0] or 0
        added = segment | {"seq": content["next"], "loses": True, "counts": counts}
        now = {**content, "segments": [*content["segments"], added], "next": content["next"] + 1, "n": content["n"] - n + segment["n"], "tokens": content["tokens"] + tokens}
        now["floor"] = _floor(_merged(spark, folder, now), now["n"])
        try:
            table.publish(version + 1, now)
            return _open(spark, folder, now)
        except Conflict:
            version, content = table.read()


def _live_keys(spark: SparkSession, folder: str, content: dict) -> DataFrame:
    """(key, seq) of all chunks, null ones too, that no later segment has replaced or dropped."""
    rows, lost = _read(spark, folder, content, "keys"), [s for s in content["segments"] if s["loses"]]
    if not lost:
        return rows
    last = _read(spark, folder, content, "gone", lost).groupBy("key").agg(F.max("seq").alias("last")).withColumnRenamed("key", "replaced")
    return rows.join(last, F.col("key").eqNullSafe(F.col("replaced")), "left").where(F.col("last").isNull() | (F.col("seq") >= F.col("last"))).select(*rows.columns)


def _listed(index: Index) -> DataFrame:
    """(range, key) of the chunks that have a text and are not lost."""
    rows = index.blocks.where((F.col("bucket") == _bucket(F.lit(EVERY), index.buckets)) & (F.col("term") == EVERY)).select("range", F.inline("postings")).select("range", "key")
    if index.gone is None:
        return rows
    gone = index.gone.select(F.col("range").alias("of"), F.col("key").alias("lost"))
    return rows.join(gone, (F.col("range") == F.col("of")) & F.col("key").eqNullSafe(F.col("lost")), "left_anti")


def _by_range(lost: DataFrame, name: str) -> DataFrame:
    """(range, its lost keys); a range has no more than RANGE."""
    return lost.groupBy("range").agg(F.collect_set("key").alias(name))


def _total(numbers: str) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def compact(spark: SparkSession, folder: str) -> Index:
    """Merge an index's segments into one without what they have lost, from the postings; nothing if another writer came first."""
    table = Snapshots(spark, folder)
    version, content = table.read()
    index, name = _open(spark, folder, content), table.new_data()
    if len(content["segments"]) > 1:
        _live_keys(spark, folder, content).select("key").write.parquet(f"{folder}/{name}/keys")
        rows = _live(index).drop("seq")
        rows.repartition(_tasks(spark), "bucket", F.pmod("range", F.lit(SPREAD))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/{name}/blocks")
        _write_frequencies(index.frequencies, f"{folder}/{name}/frequencies")
        segment = {"data": name, "n": content["n"], "unique": all(s["unique"] for s in content["segments"]), "tokens": content["tokens"], "loses": False, "seq": content["next"] - 1}
        try:
            table.publish(version + 1, {**content, "segments": [segment]})
        except Conflict:
            pass  # what it wrote isn't named anywhere
    return open_index(spark, folder)


def vacuum(spark: SparkSession, folder: str, keep: int = 2, older_than: float = 86_400.0) -> list[str]:
    """Delete what the last ``keep`` snapshots don't name, once it is ``older_than`` seconds old."""
    return Snapshots(spark, folder).vacuum(lambda c: [s[n] for s in c["segments"] for n in ("data", "counts") if n in s], keep, older_than)


def open_index(spark: SparkSession, folder: str, keys: list[str] | None = None, version: int | None = None) -> Index:
    """The index at a snapshot, by default the last one; ``keys`` are those it was built with."""
    return _open(spark, folder, Snapshots(spark, folder).read(version)[1])


def _live(index: Index) -> DataFrame:
    """Blocks without the postings that later segments have replaced or dropped; what a range has lost comes to its blocks."""
    if index.gone is None:
        return index.blocks
    left = F.filter("postings", lambda p: ~F.array_contains("dead", p["key"]))
    rows = index.blocks.join(_by_range(index.gone, "dead"), "range", "left").withColumn("postings", F.when(F.col("dead").isNull(), F.col("postings")).otherwise(left)).where(F.size("postings") > 0)
    rows = rows.withColumns({"tfs": F.transform("postings", lambda p: p["tf"]), "dls": F.transform("postings", lambda p: p["dl"])})
    return rows.select("range", "term", F.array_max("tfs").alias("most"), F.array_min("dls").alias("fewest"), F.size("tfs").cast("long").alias("df"), _total("tfs").alias("tokens"), "postings", "bucket", "seq")


@dataclass(frozen=True)
class _Asked:
    weights: DataFrame
    blocks: DataFrame
    bounds: DataFrame


def _weights(index: Index, queries: DataFrame, query: str) -> DataFrame:
    """(query_id, term, weight, in), written: weights of the queries' terms that the index has, and their buckets."""
    asked = queries.select("query_id", F.explode(tokenize(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    n = F.lit(index.chunks)
    raw = F.ln(n - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    idf = F.when(raw >= 0, raw).otherwise(F.lit(index.floor).cast("double"))
    return kept(asked.join(index.frequencies, "term").select("query_id", "term", (F.col("times") * idf).alias("weight"), _bucket(F.col("term"), index.buckets).alias("in")), "bm25-terms")


def _rounds(index: Index, queries: DataFrame, query: str) -> list[_Asked]:
    """What is asked, by rounds of about ``QUERIES_AT_ONCE`` queries."""
    weights = _weights(index, queries, query)
    n = -(-weights.select("query_id").distinct().count() // QUERIES_AT_ONCE)
    return [_ask(index, weights if n <= 1 else weights.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == r)) for r in range(max(n, 1))]


def _ask(index: Index, weights: DataFrame) -> _Asked:
    """The part of the index that has the queries' terms, and by query and range the most that a chunk there can score.

    Blocks come together by range, before they meet the queries: what is added up for a range and a
    query, or a chunk and a query, is then added up where it is.
    """
    named, blocks = weights.select("in", "term").distinct().limit(NAMED_TERMS + 1).collect(), index.blocks
    if len(named) <= NAMED_TERMS:  # more terms are in every bucket
        blocks = blocks.where(F.col("bucket").isin(sorted({r["in"] for r in named})) & F.col("term").isin([r["term"] for r in named]))
    else:
        blocks = blocks.join(F.broadcast(weights.select("term").distinct()), "term", "left_semi")
    weights = weights.drop("in")
    most = F.greatest(_part(index, F.col("weight"), F.col("most"), F.col("fewest")), F.lit(0.0))  # a chunk may lack a term that weighs less than nothing
    dealt = blocks.select("term", "range", "most", "fewest").repartition(_tasks(weights.sparkSession), "range")
    bounds = dealt.join(F.broadcast(weights), "term").groupBy("range", "query_id").agg(F.sum(most).alias("bound")).select("query_id", "range", "bound")
    return _Asked(weights, blocks, kept(bounds, "bm25-bounds"))


def _part(index: Index, weight: Column, tf: Column, dl: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(index.avgdl)))


def _scored(index: Index, asked: _Asked, ranges: DataFrame) -> DataFrame:
    """(query_id, *keys, score) of all live chunks of the ranges (query_id, range) that share a term with the query."""
    tasks = _tasks(asked.weights.sparkSession)
    wanted = ranges.groupBy("range").agg(F.collect_set("query_id").alias("asking"))  # no longer than a round
    if index.gone is not None:
        wanted = wanted.join(_by_range(index.gone, "dead"), "range", "left")
    blocks = asked.blocks.select("term", "range", "postings").repartition(tasks, "range").join(wanted.repartition(tasks, "range").hint("shuffle_hash"), "range")
    if index.gone is not None:
        blocks = blocks.withColumn("postings", F.when(F.col("dead").isNull(), F.col("postings")).otherwise(F.filter("postings", lambda p: ~F.array_contains("dead", p["key"]))))
    hits = blocks.join(F.broadcast(asked.weights), "term").where(F.array_contains("asking", F.col("query_id")))
    rows = hits.select("range", "query_id", "weight", F.inline("postings"))
    # chunks that share their keys may lie in several ranges
    return rows.groupBy(*(["range"] if index.unique else []), "query_id", "key").agg(F.sum(_part(index, F.col("weight"), F.col("tf"), F.col("dl"))).alias("score")).select("query_id", "key.*", "score")


def _summed(asks: Broadcast, avgdl: float, queries: int, k: int):
    """Rows (range, term, postings), a range's rows one after another: each range's scores are added up, and those that can be among a query's k best go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((k, queries))  # of the task so far

        def scored(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal best
            postings, asked = rows.column("postings"), [asks.value[t] for t in rows.column("term").to_pylist()]
            flat, of, weights = postings.flatten(), np.concatenate([x[0] for x in asked]), np.concatenate([x[1] for x in asked])
            key = flat.field("key")
            tf, dl = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("tf", "dl"))
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
            # a chunk's number in the range, by its key's fields
            slot = np.zeros(len(flat), np.int64)
            for c in key.flatten():
                code = c.dictionary_encode("encode")
                slot = slot * len(code.dictionary) + code.indices.to_numpy()
                slot = np.unique(slot, return_inverse=True)[1].ravel()
            first = np.unique(slot, return_index=True)[1]
            # every posting meets every query that asks for its term
            size, many = postings.value_lengths().to_numpy(zero_copy_only=False), np.array([len(x[0]) for x in asked])
            many, start = np.repeat(many, size), np.repeat(np.cumsum(many) - many, size)
            place = np.repeat(np.arange(len(flat)), many)
            at = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + start[place]
            score = np.bincount(slot[place] * queries + of[at], weights[at] * part[place], len(first) * queries).reshape(-1, queries)
            best = np.partition(np.concatenate([best, score]), len(score), axis=0)[len(score):]
            # scores are compared by six digits
            who, q = np.nonzero((score > 0) & (score >= best[0] - 2e-6))
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), key.take(pa.array(first[who])), pa.array(score[who, q])], ["q", "key", "score"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            number = batch.column("range").to_numpy()
            edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for lo, hi in zip(edges, edges[1:]):
                if held and held[-1].column("range")[0].as_py() != number[lo]:
                    yield scored(pa.concat_batches(held))
                    held = []
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield scored(pa.concat_batches(held))

    return run


def _best(index: Index, asked: _Asked, ranges: DataFrame, k: int, few: bool) -> DataFrame:
    """(query_id, *keys, score, rank): the k best of each query in the ranges (range, ...), for chunks that don't share keys.

    A range's postings come to its scores, which a task adds up range by range: rows of a posting
    and a query are many times the index. ``few``: the ranges are few enough to be sent to all tasks.
    """
    spark = asked.weights.sparkSession
    wanted = ranges.select("range").distinct()
    ids = asked.weights.select("query_id").distinct()  # of one round
    ids = kept(ids.select("query_id", (F.row_number().over(Window.orderBy("query_id")) - 1).alias("q")), "bm25-queries")
    asks: dict[str, list] = {}
    for r in asked.weights.join(F.broadcast(ids), "query_id").select("term", "q", "weight").collect():
        asks.setdefault(r["term"], []).append((r["q"], r["weight"]))
    sent = spark.sparkContext.broadcast({t: tuple(np.array(x) for x in zip(*v)) for t, v in asks.items()})
    blocks = asked.blocks.select("term", "range", "postings").join(F.broadcast(wanted) if few else wanted, "range", "left_semi")
    blocks = blocks.repartition(_tasks(spark), "range")
    if index.gone is not None:
        left = F.filter("postings", lambda p: ~F.array_contains("dead", p["key"]))
        blocks = blocks.join(_by_range(index.gone, "dead"), "range", "left").withColumn("postings", F.when(F.col("dead").isNull(), F.col("postings")).otherwise(left)).where(F.size("postings") > 0)
    rows = blocks.select("range", "term", "postings").sortWithinPartitions("range")
    key = index.blocks.schema["postings"].dataType.elementType["key"].dataType.simpleString()
    found = rows.mapInArrow(_summed(sent, index.avgdl or 0.0, max(ids.count(), 1), k), f"q int, key {key}, score double")
    return top_k(found.join(F.broadcast(ids), "q").select("query_id", "key.*", "score"), index.keys, k)


def _chosen(index: Index, asked: _Asked, k: int) -> DataFrame:
    """(query_id, range) of the ranges that may hold one of a query's k best: those whose bound comes up to the k-th score of its FIRST best ones.

    Bounds are those of one chunk, so where chunks share their keys it is every range.
    """
    if not index.unique:
        return asked.bounds.select("query_id", "range")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
    first = asked.bounds.withColumn("place", place).where(F.col("place") <= FIRST).select("query_id", "range")
    best = _best(index, asked, first, k, True)
    kth = kept(best.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth")), "bm25-kth")
    # scores are compared by six digits; what rounding can have moved stays in
    good = F.col("kth").isNull() | (F.col("bound") * (1 + 1e-9) + 2e-6 >= F.col("kth"))
    # written, since it is used apart from what it is made of
    return kept(asked.bounds.join(kth, "query_id", "left").where(good).select("query_id", "range"), "bm25-chosen")


def scores(index: Index, queries: DataFrame, query: str = "query") -> DataFrame:
    """(query_id, *keys, score) of every chunk that shares a term with a query; the corpus isn't read."""
    if not index.chunks:
        return _nothing(index, queries)
    return reduce(DataFrame.unionByName, (_scored(index, asked, asked.bounds.select("query_id", "range")) for asked in _rounds(index, queries, query)))


def _nothing(index: Index, queries: DataFrame) -> DataFrame:
    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.sparkSession.createDataFrame([], ", ".join([f"query_id {kind}", *(f"`{f.name}` {f.dataType.simpleString()}" for f in index.blocks.select(F.inline("postings")).select("key.*").schema), "score double"]))


def search(index: Index, queries: DataFrame, k: int, query: str = "query") -> DataFrame:
    """Chunks with a positive score, best first, as by scoring all: ranges that can't hold one of the k best are passed over."""
    if not index.chunks:
        return top_k(_nothing(index, queries), index.keys, k)
    if index.unique:
        return reduce(DataFrame.unionByName, (_best(index, asked, _chosen(index, asked, k), k, False) for asked in _rounds(index, queries, query)))
    return reduce(DataFrame.unionByName, (top_k(_scored(index, asked, _chosen(index, asked, k)).where("score > 0"), index.keys, k) for asked in _rounds(index, queries, query)))


def passed_over(index: Index, queries: DataFrame, k: int, query: str = "query") -> DataFrame:
    """(query_id, ranges, read): ranges with a term of the query, and how many of them a search for ``k`` scores."""
    asked = _ask(index, _weights(index, queries, query))
    read = _chosen(index, asked, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("read"))
    return asked.bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("ranges")).join(read, "query_id", "left").select("query_id", "ranges", F.coalesce("read", F.lit(0)).alias("read"))


def top_k(scored: DataFrame, keys: list[str], k: int, score: str = "score", digits: int = 6) -> DataFrame:
    """The k best of each query with their ``rank``; ties by key, nulls last."""
    rounded = scored.withColumn(score, F.round(score, digits))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(score), *keys)
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_search(chunks: DataFrame, queries: DataFrame, keys: list[str], k: int, text: str = "content", query: str = "query") -> DataFrame:
    """``search`` through an index that is built for these queries alone."""
    return search(build_index(chunks, keys, new_folder(chunks.sparkSession, "bm25"), text), queries, k, query)
