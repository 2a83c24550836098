"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of a byte string is the pair of its values as a polynomial in a fixed base modulo
two primes. Those of neighbouring chunks combine by one multiplication with the base to the power
of the right chunk's length, so the chunks of a huge document are hashed by many tasks and joined
in order. Rows whose lengths and fingerprints are equal are then compared chunk by chunk with one
row of their group; rows that differ after all are grouped anew with their SHA-256 as well, and
compared again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import column_type, materialise, possibly, small_batches, text_or_empty

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
CHUNK_BYTES = 65_536
HUGE_BYTES = 4_194_304
#: Members of a group that one copy of its representative's chunk is compared with.
PER_COPY = 256
#: 128 bits of a row's id and text, by which a second pass over the table finds the row again.
_ROW = ["row1", "row2"]


@lru_cache(maxsize=8)
def _powers(length: int, base: int, prime: int) -> np.ndarray:
    out = np.empty(length, dtype=np.int64)
    x = 1
    for k in range(length - 1, -1, -1):
        out[k] = x
        x = x * base % prime
    return out


def chunk_value(data: bytes, base: int, prime: int) -> int:
    """Value of one chunk; bytes count from 1, so that leading zero bytes matter."""
    if not data:
        return 0
    digits = np.frombuffer(data, dtype=np.uint8).astype(np.int64) + 1
    # 9-bit digits times 31-bit powers: 2 ** 22 terms stay below 2 ** 63
    return int(digits @ _powers(CHUNK_BYTES, base, prime)[CHUNK_BYTES - len(data):]) % prime


def combine(left: int, right: int, right_length: int, base: int, prime: int) -> int:
    return (left * pow(base, right_length, prime) + right) % prime


def fingerprint(data: bytes) -> tuple[int, int]:
    out = []
    for base, prime in zip(BASES, PRIMES):
        value = 0
        for k in range(0, len(data), CHUNK_BYTES):
            chunk = data[k:k + CHUNK_BYTES]
            value = combine(value, chunk_value(chunk, base, prime), len(chunk), base, prime)
        out.append(value)
    return out[0], out[1]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints and SHA-256 of texts, A-Z lower-cased."""
    for batch in batches:
        cols = [[], [], []]
        for text in batch.column("text"):
            data = text.as_buffer().to_pybytes().lower()  # of bytes: A-Z only
            a, b = fingerprint(data)
            for c, v in zip(cols, (a, b, hashlib.sha256(data).hexdigest())):
                c.append(v)
        keep = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], [*keep.schema.names, "fp1", "fp2", "sha"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normalised text in chunks, one row each."""
    for batch in batches:
        keep = batch.drop_columns(["text"])
        for k, text in enumerate(batch.column("text")):
            data = text.as_buffer().to_pybytes().lower()
            cut = [data[a:a + CHUNK_BYTES] for a in range(0, len(data), CHUNK_BYTES)]
            for lo in range(0, len(cut), 64):
                some = cut[lo:lo + 64]
                row = keep.take(pa.array([k] * len(some), pa.int64()))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array(range(lo, lo + len(some)), pa.int64()), pa.array(some, pa.binary())], [*keep.schema.names, "no", "chunk"])


def _chunk_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, data = batch.drop_columns(["chunk"]), batch.column("chunk").to_pylist()
        values = [pa.array([chunk_value(x, b, p) for x in data], pa.int64()) for b, p in zip(BASES, PRIMES)]
        shift = [pa.array([pow(b, len(x), p) for x in data], pa.int64()) for b, p in zip(BASES, PRIMES)]
        yield pa.RecordBatch.from_arrays([*keep.columns, *values, *shift], [*keep.schema.names, "v1", "v2", "s1", "s2"])


def _schema(df: DataFrame, drop: str, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != drop), more])


def _sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = batch.drop_columns(["text"])
        out = []
        for text in batch.column("text"):
            h, data = hashlib.sha256(), text.as_buffer().to_pybytes()
            for k in range(0, len(data), CHUNK_BYTES):
                h.update(data[k:k + CHUNK_BYTES].lower())
            out.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(out, pa.string())], [*keep.schema.names, "sha"])


def fingerprints(docs: DataFrame, huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """``docs`` (..., text) -> (..., bytes, fp1, fp2, sha); huge texts by parallel chunks."""
    docs = docs.withColumn("bytes", F.octet_length("text").cast("long"))
    usual = docs.where(F.col("bytes") <= huge_bytes)
    usual = usual.mapInArrow(_whole, _schema(usual, "text", "fp1 long, fp2 long, sha string"))
    huge = materialise(docs.where(F.col("bytes") > huge_bytes).withColumn("uid", F.monotonically_increasing_id()), "huge-docs")
    cut = huge.select("uid", "text")
    values = cut.mapInArrow(_chunks, "uid long, no long, chunk binary").repartition("uid", "no").mapInArrow(_chunk_values, "uid long, no long, v1 long, v2 long, s1 long, s2 long")
    order = F.array_sort(F.collect_list(F.struct("no", "v1", "v2", "s1", "s2")))
    fold = lambda v, s, p: F.aggregate("all", F.lit(0).cast("long"), lambda acc, x: (acc * x[s] + x[v]) % F.lit(p).cast("long"))
    values = values.groupBy("uid").agg(order.alias("all")).select("uid", fold("v1", "s1", PRIMES[0]).alias("fp1"), fold("v2", "s2", PRIMES[1]).alias("fp2"))
    hashed = huge.mapInArrow(_sha, _schema(huge, "text", "sha string"))
    return usual.unionByName(hashed.join(values, "uid").select(*usual.columns))


def _differing(docs: DataFrame, groups: DataFrame, per_copy: int) -> DataFrame:
    """Rows (by ``_ROW``) that differ from their group's representative in some chunk.

    ``groups``: row key, rep1 and rep2 (the representative's row key), n (members), for groups of
    two or more, each row key once: rows with one key are the same row repeated, and none of them
    meets the others. A representative's chunks are copied once per ``per_copy`` members, so that
    no group meets in one task; only rows of such groups are chunked.
    """
    spread = F.ceil(F.col("n") / per_copy).cast("int")
    maybe, _ = possibly(docs, groups, _ROW)
    key = [*_ROW, "rep1", "rep2", "n"]
    texts = maybe.join(groups.hint("merge"), _ROW).select(*key, "text")
    cut = texts.mapInArrow(_chunks, ", ".join(f"{c} long" for c in key) + ", no long, chunk binary")
    own = (F.col("row1") == F.col("rep1")) & (F.col("row2") == F.col("rep2"))
    members = cut.where(~own).select(*_ROW, "rep1", "rep2", "no", "chunk", F.pmod(F.xxhash64(*_ROW), spread).cast("int").alias("copy"))
    # of a representative that is repeated, any
    reps = cut.where(own).groupBy("rep1", "rep2", "no", "n").agg(F.first("chunk").alias("other"))
    reps = reps.select("rep1", "rep2", "no", "other", F.explode(F.sequence(F.lit(0), spread - 1)).alias("copy"))
    # lengths are equal within a group, so each chunk has its counterpart
    return members.join(reps, ["rep1", "rep2", "no", "copy"]).where("chunk <> other").select(*_ROW).distinct()


def dedup_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge_bytes: int = HUGE_BYTES, per_copy: int = PER_COPY) -> DataFrame:
    """Group rows whose texts are identical after lower-casing A-Z.

    Returns one row per input row: the id column, ``keep_id`` (the largest id of the group),
    ``group_size``, ``kept``, ``text_sha256`` (of the normalised text). Null and empty texts are
    one group. Ids may be null (a null id is kept only in a group without any other, ``keep_id``
    null); of rows that share the largest id, one is kept. An empty table gives an empty result.
    Other columns, whatever their names, play no part.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    docs = docs.withColumns({"row1": F.xxhash64("id", "text"), "row2": F.xxhash64(F.lit(1), "text", "id")})
    prints = materialise(fingerprints(docs, huge_bytes).withColumn("uid", F.monotonically_increasing_id()), "fingerprints")
    key = ["bytes", "fp1", "fp2"]
    top = F.max(F.struct(F.col("id").isNotNull().alias("known"), F.col("id"), F.col("uid"), *_ROW)).alias("top")

    def members(rows: DataFrame, by: list[str]) -> DataFrame:
        many = rows.groupBy(*by).agg(top, F.count(F.lit(1)).alias("n")).where("n > 1")
        many = materialise(many.select(*by, F.col("top.row1").alias("rep1"), F.col("top.row2").alias("rep2"), "n"), "equal-prints")
        found = rows.join(many.hint("merge"), by).select(*_ROW, "rep1", "rep2", "n")
        return materialise(found.groupBy(*_ROW).agg(*(F.first(c).alias(c) for c in ("rep1", "rep2", "n"))), "members")

    different = materialise(_differing(docs, members(prints, key), per_copy), "different")
    collided = prints.join(different, _ROW, "left_semi").select(*key).distinct()
    if collided.isEmpty():
        own = prints.withColumn("tie", F.lit(""))
    else:
        # a collision: the whole group is told apart by SHA-256 too, and compared again
        mixed = prints.join(collided.withColumn("mixed", F.lit(True)), key, "left")
        own = materialise(mixed.withColumn("tie", F.when(F.col("mixed"), F.col("sha")).otherwise("")).drop("mixed"), "retold")
        if not _differing(docs, members(own.where("tie <> ''"), [*key, "tie"]), per_copy).isEmpty():
            raise ValueError("texts that differ share their length, fingerprint and SHA-256")
    final = own.groupBy(*key, "tie").agg(top, F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = own.join(final.hint("merge"), [*key, "tie"], "left")
    return joined.select(
        F.col("id").alias(id_col), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (F.col("n").isNull() | (F.col("top.uid") == F.col("uid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
