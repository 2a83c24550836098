"""Token counts of whole texts, with huge documents encoded in overlapping chunks.

A text longer than ``chunk_chars`` is cut into chunks that overlap. Each chunk is a row of its
own, encoded with offsets by any task. A token start right after ASCII white space is a proven
boundary for a tokenizer that drops white space: what stands on either side is encoded alone, so
two chunks that both have that boundary agree on everything beyond it. Neighbours are spliced at
the first such boundary that both have inside their overlap. Where an overlap holds none (one
long run without white space), that document's overlap is doubled, until it covers the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from . import memo
from ._common import column_type, materialise, slices, small_batches, text_or_empty

LIMIT = 2048
CHUNK_CHARS = 65_536
OVERLAP_CHARS = 1_024
_WHITE = " \t\n\r\x0b\x0c"
#: Rows and bytes of text that a task holds as Python words at once.
_BATCH, _BYTES = 512, 1 << 20


def _count_whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = memo.counter(path)
        for batch in batches:
            for part in slices(batch, "text", _BYTES, _BATCH):
                counts = counter.count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def _cut(chunk: int):
    """Overlapping chunks of each text: its start, and where the next chunk starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, overlap, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "overlap", "text"))):
                # a step is never shorter than the overlap, so that all chunks together have at most twice the text
                step = max(chunk, overlap) if overlap < len(text) else len(text)
                for no, a in enumerate(range(0, max(len(text), 1), max(step, 1))):
                    last = a + step >= len(text)
                    b = len(text) if last else min(len(text), a + step + overlap)
                    yield pa.RecordBatch.from_pydict(
                        {"uid": [uid], "no": [no], "start": [a], "next": [None if last else a + step], "overlap": [overlap], "part": [text[a:b]]},
                        schema=pa.schema([("uid", pa.int64()), ("no", pa.int64()), ("start", pa.int64()), ("next", pa.int64()), ("overlap", pa.int64()), ("part", pa.string())]),
                    )

    return run


_CUT = "uid long, no long, start long, next long, overlap long, part string"
_POINTS = T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("before", T.LongType())]))


def _encode_chunks(path: str):
    """Tokens of each chunk, and its proven boundaries in the overlaps at its two ends."""
    point = pa.list_(pa.struct([("pos", pa.int64()), ("before", pa.int64())]))
    names = ["uid", "no", "n", "head", "tail", "last"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), point, point, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = memo.load(path)
        for batch in batches:
            for r in batch.to_pylist():
                part, a = r["part"], r["start"]
                offsets = t.encode(part, add_special_tokens=False).offsets
                points = [(a + o, k) for k, (o, _) in enumerate(offsets) if o and part[o - 1] in _WHITE]
                head = [{"pos": p, "before": k} for p, k in points if p < a + r["overlap"]] if r["no"] else []
                tail = [] if r["next"] is None else [{"pos": p, "before": k} for p, k in points if p >= r["next"]]
                row = [r["uid"], r["no"], len(offsets), head, tail, r["next"] is None]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    return run


def _spliced(chunks: DataFrame) -> DataFrame:
    """Tokens by document: null where two neighbours share no proven boundary."""
    by_doc = Window.partitionBy("uid").orderBy("no")
    shared = F.array_min(F.array_intersect(F.col("tail.pos"), F.lead("head.pos").over(by_doc)))
    cut = chunks.withColumn("to", shared).withColumn("from", F.lag("to").over(by_doc))
    first, last = F.col("no") == 0, F.col("last")
    upper = F.when(last, F.col("n")).otherwise(F.get(F.filter("tail", lambda x: x["pos"] == F.col("to")), F.lit(0))["before"])
    lower = F.when(first, F.lit(0)).otherwise(F.get(F.filter("head", lambda x: x["pos"] == F.col("from")), F.lit(0))["before"])
    own = cut.withColumn("own", upper - lower)
    return own.groupBy("uid").agg(F.when(F.count("own") == F.count(F.lit(1)), F.sum("own")).alias("n_tokens"))


def huge_counts(docs: DataFrame, tokenizer_path: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """``docs`` (uid, text) -> (uid, n_tokens), by chunks; overlaps widen until all align."""
    left, done, overlap = docs.withColumn("overlap", F.lit(overlap_chars).cast("long")), None, overlap_chars
    while True:
        chunks = left.select("uid", "overlap", "text").mapInArrow(_cut(chunk_chars), _CUT)
        schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("no", T.LongType()), T.StructField("n", T.LongType()), T.StructField("head", _POINTS), T.StructField("tail", _POINTS), T.StructField("last", T.BooleanType())])
        found = materialise(_spliced(chunks.repartition("uid", "no").mapInArrow(_encode_chunks(tokenizer_path), schema)), "chunk-counts")
        good = found.where("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        if found.where("n_tokens is null").isEmpty():
            return done
        overlap *= 2
        left = left.join(found.where("n_tokens is null").select("uid"), "uid", "left_semi").withColumn("overlap", F.lit(overlap).cast("long"))


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
                 chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Count the tokens of every whole text, without added special tokens.

    Returns one row per input row: the id column, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``
    (more than ``limit`` tokens). Null and empty texts count 0 and 0. Rows that repeat an id or are
    equal are counted one by one; an id may be null. An empty table gives an empty result. Only the
    two named columns are read; others, whatever their names, play no part. A tokenizer without
    the boundary property counts every text, huge ones too, in one call of the library.
    """
    small_batches(df.sparkSession)
    kind = column_type(df, id_col)
    docs = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    chunked = memo.drops_white_space(tokenizer_path)
    # bytes are never fewer than characters, and need no pass over the text
    small = docs.where(F.col("n_bytes") <= chunk_chars) if chunked else docs
    counted = small.select("id", "n_bytes", "text").mapInArrow(_count_whole(tokenizer_path), f"id {kind}, n_bytes long, n_tokens long")
    if chunked:
        huge = materialise(docs.where(F.col("n_bytes") > chunk_chars), "huge-docs")
        counts = huge_counts(huge.select("uid", "text"), tokenizer_path, chunk_chars, overlap_chars)
        counted = counted.unionByName(huge.join(counts, "uid").select("id", "n_bytes", "n_tokens"))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
