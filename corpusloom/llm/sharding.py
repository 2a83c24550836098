"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows of equal texts form a group that is never divided. Groups enter, by falling size, the bin
with the tightest room that still holds them; a balanced tree keeps the bins by room. For a given
number of shards the capacity is searched: the smallest, to a ten-thousandth of a shard, for which
best fit needs no more shards than that. A group larger than an even share of what is left gets a
shard of its own first.

The planning doesn't grow with the table. A group of at least 1/``UNITS`` of all bytes is an item
of its own, of which there are at most ``UNITS``; smaller ones are put, whole, into ``UNITS``
bundles by hash, and the bundles are items. On small tables every group is an item of its own.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import gapless, materialise, text_or_empty

#: Most items of either kind (large groups, bundles of small ones) that the plan is made from.
UNITS = 8_192
#: With a given capacity, an item that bundles small groups is about 1/PARTS of a shard at most.
PARTS = 64


class Rooms:
    """Bins by the room they have left: a treap, so that its depth stays logarithmic."""

    def __init__(self):
        self.root, self.random = None, random.Random(0)

    def add(self, room: int, number: int) -> None:
        low, high = self._split(self.root, (room, number))
        self.root = self._join(self._join(low, [(room, number), self.random.random(), None, None]), high)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the bin (room, number) with the least room that holds ``size``."""
        low, high = self._split(self.root, (size, -1))
        found, above = high, None
        while found is not None and found[2] is not None:
            above, found = found, found[2]
        if found is not None:
            if above is None:
                high = found[3]
            else:
                above[2] = found[3]
        self.root = self._join(low, high)
        return found and found[0]

    def _split(self, node, key):
        """Nodes below the key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return high if low is None else low
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each size, which must fall; none if more than ``most`` bins are needed. What exceeds the capacity gets a bin alone."""
    rooms, out, bins = Rooms(), [], 0
    for size in sizes:
        found = rooms.tightest(size) if size <= capacity else None
        if found is None:
            if bins == most:
                return None
            room, number, bins = max(capacity, size), bins, bins + 1
        else:
            room, number = found
        if room > size:
            rooms.add(room - size, number)
        out.append(number)
    return out


def even(sizes: list[int], shards: int) -> list[int]:
    """Shard of each size, which must fall, so that the shards' sums are near equal."""
    rest, alone = sum(sizes), 0
    while alone < min(shards, len(sizes)) and sizes[alone] * (shards - alone) > rest:
        rest -= sizes[alone]
        alone += 1
    own, left, free = list(range(alone)), sizes[alone:], shards - alone
    if not left:
        return own
    # with room for the mean and the largest item, a bin too many would mean that the others exceed the mean
    mean = -(-rest // free)
    low, high = max(mean, left[0]), mean + left[0]
    best = best_fit(left, high, free)
    while high - low > max(mean // 10_000, 0) and low < high:
        middle = (low + high) // 2
        found = best_fit(left, middle, free)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    return own + [alone + b for b in best]


def shard(df: DataFrame, shards: int = 16, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put all rows into shards of near equal bytes, rows of equal texts together.

    Returns one row per input row: the id column, ``size`` (UTF-8 bytes and 1), ``text_crc32``,
    ``law`` (``bytes``), ``shard`` (from 0), ``slot`` (gapless from 0 in each shard),
    ``grown_shard`` (null: more shards move rows between all of them). With ``capacity`` (bytes),
    as few shards as best fit finds, each at most that large, or one group that is larger; the plan
    then has at most 2 * ``PARTS`` items for each shard. Null and empty texts are one group of
    size 1 a row. Repeated rows are rows of their own, an id may be null, a shard may stay empty
    where there are fewer groups. An empty table gives an empty result. Other columns, whatever
    their names, play no part.
    """
    text = text_or_empty(text_col)
    rows = df.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("key"), F.monotonically_increasing_id().alias("uid"),
    )
    rows = materialise(rows, "sized")
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    least = max(1, total // UNITS)
    bundles = UNITS
    if capacity is not None:
        least = max(1, min(least, capacity // PARTS))
        bundles = max(UNITS, -(-total // least))
    tie = Window.partitionBy("bytes").orderBy("key")
    large = groups.where(F.col("bytes") >= least).select("key", "bytes", (F.row_number().over(tie) - 1).cast("long").alias("rank"))
    small = groups.where(F.col("bytes") < least).select("key", "bytes", F.pmod(F.xxhash64("key"), F.lit(bundles)).alias("rank"))

    sizes = [(r["bytes"], k, 0) for r in large.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect() for k in range(r["n"])]
    sizes += [(r["bytes"], r["rank"], 1) for r in small.groupBy("rank").agg(F.sum("bytes").alias("bytes")).collect()]
    sizes.sort(key=lambda x: (-x[0], x[2], x[1]))
    plain = [x[0] for x in sizes]
    placed = even(plain, shards) if capacity is None else best_fit(plain, capacity)

    def known(kind: int) -> DataFrame:
        found = [(b, r, s) for (b, r, k), s in zip(sizes, placed) if k == kind]
        columns = [pa.array([x[c] for x in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
        return F.broadcast(df.sparkSession.createDataFrame(pa.table(columns, ["bytes", "rank", "shard"])))  # an entry for each item of the plan

    own = large.join(known(0), ["bytes", "rank"]).select("key", "shard")
    own = own.unionByName(small.join(known(1).drop("bytes"), "rank").select("key", "shard"))
    dealt = materialise(rows.join(own.hint("merge"), "key").drop("key"), "dealt")
    out = gapless(dealt, "shard", "uid", "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
