"""Best-fit-decreasing sharding against a plain version of it, and its laws on small tables."""

import collections
import random
import zlib

from corpusloom.llm import sharding


def plain_best_fit(sizes, capacity):
    loads, out = [], []
    for size in sizes:
        fits = [(capacity - load - size, k) for k, load in enumerate(loads) if load + size <= capacity]
        k = min(fits)[1] if fits else len(loads)
        if k == len(loads):
            loads.append(0)
        loads[k] += size
        out.append(k)
    return loads


def test_best_fit_is_the_plain_one():
    r = random.Random(4)
    for _ in range(200):
        capacity = r.randint(5, 60)
        sizes = sorted((r.randint(1, capacity + 3) for _ in range(r.randint(0, 80))), reverse=True)
        got = sharding.best_fit(sizes, capacity)
        loads = collections.Counter()
        for s, b in zip(sizes, got):
            loads[b] += s
        assert sorted(loads.values()) == sorted(plain_best_fit(sizes, capacity))
        assert sharding.best_fit(sizes, capacity, max(loads, default=-1)) is None or not sizes


def test_even_shards():
    r = random.Random(5)
    for shards in (1, 3, 16):
        sizes = sorted((r.randint(1, 50) for _ in range(3000)), reverse=True)
        loads = collections.Counter()
        for s, b in zip(sizes, sharding.even(sizes, shards)):
            loads[b] += s
        assert len(loads) == shards and max(loads.values()) - min(loads.values()) <= 4
    # one group of two thirds: the other shards share the rest
    sizes = [2000] + [10] * 100
    loads = collections.Counter()
    for s, b in zip(sizes, sharding.even(sizes, 5)):
        loads[b] += s
    assert sorted(loads.values()) == [250, 250, 250, 250, 2000]
    assert sharding.even([], 4) == [] and sharding.even([3, 2], 4) == [0, 1]


def table(spark):
    r = random.Random(6)
    rows = [(1, None, 1, "x"), (1, "", 2, "y"), (None, "é" * 10, 3, "z"), (None, "é" * 10, 3, "z")]
    rows += [(10 + i, "w" * r.randint(0, 400), 5, None) for i in range(400)] + [(900 + i, "same text", 5, None) for i in range(300)]
    rows += [(5000, "y" * 9000, 0, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, shard int, key string")


def test_shards_of_a_table(spark, monkeypatch):
    rows, df = table(spark)
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for units in (8192, 40):  # 40: small groups go in bundles
        monkeypatch.setattr(sharding, "UNITS", units)
        got = sharding.shard(df, 4).collect()
        assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
        assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 4 for r in got)
        where, slots, loads = collections.defaultdict(set), collections.defaultdict(list), collections.Counter()
        for r in got:
            where[r.size, r.text_crc32].add(r.shard)
            slots[r.shard].append(r.slot)
            loads[r.shard] += r.size
        assert all(len(x) == 1 for x in where.values())
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        mean = sum(loads.values()) / 4
        assert len(loads) == 4 and max(loads.values()) - min(loads.values()) <= mean * (0.01 if units > 40 else 0.2)
    assert sharding.shard(df.limit(0)).count() == 0


def test_shards_of_a_capacity(spark):
    rows, df = table(spark)
    sizes = collections.Counter()
    for _, t, *_ in rows:
        sizes[t or ""] += len((t or "").encode()) + 1
    got = sharding.shard(df, capacity=5000).collect()
    loads = collections.Counter()
    for r in got:
        loads[r.shard] += r.size
    own = sorted((v for v in sizes.values()), reverse=True)
    assert sum(v > 5000 for v in loads.values()) == sum(v > 5000 for v in own) == 1
    assert len(loads) <= -(-sum(v for v in own if v <= 5000) // 5000) + 1 + 1
