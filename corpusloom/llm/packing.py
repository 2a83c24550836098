"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

The number of sequences depends only on how many pieces there are of each length, so the packing
is planned on that histogram, which has one entry per length up to the capacity however many
documents there are. The reduction fixes bins that dominate all others: a piece with which no
other fits, a pair that no third piece can join and whose partner is the largest that fits, or
that fills the bin. Best fit decreasing packs the rest. The plan is a list of patterns (lengths in
order, and how often the pattern occurs). Spark then numbers the pieces of each length and gives
each its slot.
"""

from __future__ import annotations

import gc
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memo
from ._common import ROWS_PER_GROUP, column_type, gapless, materialise, slices, small_batches, text_or_empty

CAPACITY = 1024
END_ID = 2
#: Rows and bytes of text that a task holds as Python words at once.
_BATCH, _BYTES = 256, 1 << 20


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence, in order) and how often each occurs.

    The work depends on the number of distinct lengths, not on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a length lies outside the capacity")
    out, rest = _dominant(left, capacity)
    return out + _best_fit(rest, capacity)


def _dominant(left: dict[int, int], capacity: int) -> tuple[list, dict[int, int]]:
    """Bins that some best packing has, and the pieces that they leave."""
    out, rest, have = [], {}, sorted(left)

    def take(lengths: tuple[int, ...], times: int) -> None:
        out.append((lengths, times))
        for n in lengths:
            left[n] -= times
        for n in set(lengths):
            if not left[n]:
                have.remove(n)

    while have:
        big = have[-1]
        room = capacity - big
        k = bisect_left(have, room + 1) - 1  # the largest length that fits beside it
        while k >= 0 and have[k] == big and left[big] < 2:
            k -= 1
        # pieces passed over are no smaller than this one; the last of them may still fit
        passed = min(rest, default=capacity + 1) <= room
        if k < 0 and not passed:
            take((big,), left[big])
            continue
        if k < 0:
            rest[big] = left.pop(big)
            have.pop()
            continue
        mate = have[k]
        smallest = have[0]
        # the two smallest pieces other than the big one
        other = smallest if left[smallest] - (smallest == big) > 1 else next((n for n in have if n != smallest), None)
        no_third = not passed and (other is None or smallest + other > room)
        if mate == room or no_third:
            times = left[big] // 2 if mate == big else min(left[big], left[mate])
            take((big, mate), times)
            continue
        rest[big] = left.pop(big)
        have.pop()
    return out, rest


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing, for all pieces of a length at once."""
    open_bins: dict[int, list[list]] = {}  # room left -> [pattern, times]
    rooms: list[int] = []
    done = []

    def put(room: int, pattern: tuple, times: int) -> None:
        if not room:
            done.append((pattern, times))
            return
        if room not in open_bins:
            open_bins[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_bins[room].append([pattern, times])

    for n in sorted(counts, reverse=True):
        todo = counts[n]
        while todo:
            k = bisect_left(rooms, n)
            if k == len(rooms):  # new bins, each filled as far as this length goes
                each = capacity // n
                if todo >= each:
                    put(capacity - each * n, (n,) * each, todo // each)
                    todo %= each
                else:
                    put(capacity - todo * n, (n,) * todo, 1)
                    todo = 0
                continue
            room = rooms[k]
            bins = open_bins[room]
            pattern, times = bins.pop()
            if not bins:
                del open_bins[room]
                rooms.pop(k)
            each = room // n
            full = min(times, todo // each)
            if full:
                put(room - each * n, pattern + (n,) * each, full)
                todo -= full * each
            elif todo:
                put(room - todo * n, pattern + (n,) * todo, 1)
                full, todo = 1, 0
            if times > full:
                put(room, pattern, times - full)
    return done + [(p, t) for bins in open_bins.values() for p, t in bins]


class Slots:
    """Where the r-th piece of each length goes; sequences of the same pattern follow one another."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        found: dict[int, list] = {}
        used: dict[int, int] = {}
        first = 0
        for lengths, times in patterns:
            at = 0
            for n in lengths:
                found.setdefault(n, []).append((used.get(n, 0), first, at))
                used[n] = used.get(n, 0) + times
                at += n
            first += times
        self.of = {n: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for n, v in found.items()}

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, first, at = self.of[length]
        k = np.searchsorted(starts, rank, "right") - 1
        return first[k] + rank - starts[k], at[k]


def _pieces(path: str, end_id: int, capacity: int):
    names = ["id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = memo.encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text", _BYTES, _BATCH):
                doc, cols = [], [[], [], [], []]
                gc.disable()  # words make no cycles, and looking for them among so many takes time
                encoded = encoder.encode(part.column("text").to_pylist())
                gc.enable()
                for row, ids in enumerate(encoded):
                    ids = memoryview(ids + end)
                    n = len(ids) // 4
                    first = n - capacity * (-(-n // capacity) - 1)
                    at = 0
                    for no, stop in enumerate(range(first, n + 1, capacity)):
                        for c, v in zip(cols, (no, at, stop - at, zlib.crc32(ids[4 * at:4 * stop]))):
                            c.append(v)
                        doc.append(row)
                        at = stop
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names)

    return run


def pieces(df: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of the capacity; the first may be shorter."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return docs.mapInArrow(_pieces(tokenizer_path, end_id, capacity), f"id {column_type(df, id_col)}, piece int, start long, length long, ids_crc32 long")


def assign(parts: DataFrame, capacity: int = CAPACITY, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Give each row of ``parts`` (length, uid, ...) a sequence and its offset there; ``uid`` goes.

    ``parts`` is a written table and ``uid`` a number of its own for each row: wholly equal rows
    too are numbered by many tasks. The driver sees one count per length.
    """
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    known = parts.sparkSession.sparkContext.broadcast(Slots(plan(counts, capacity)))
    ranked = gapless(parts, "length", "uid", "rank", rows_per_group).drop("uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = known.value
        for batch in batches:
            n, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, at = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for length in np.unique(n):
                own = n == length
                sequence[own], at[own] = slots.place(int(length), r[own])
            keep = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(sequence), pa.array(at)], [*keep.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, _schema_with(parts.drop("uid"), "sequence_id long, offset long"))


def _schema_with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as best fit finds.

    Returns one row per piece: the id column, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``. A null or empty text is its end id alone. Rows that repeat an id
    are documents of their own; an id may be null. An empty table gives an empty result. Other
    columns, whatever their names, play no part.
    """
    cut = pieces(df, tokenizer_path, id_col, text_col, capacity, end_id).withColumn("uid", F.monotonically_increasing_id())
    cut = materialise(cut, "pieces")
    return assign(cut, capacity).withColumnRenamed("id", id_col)
