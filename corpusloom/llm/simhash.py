"""Near-duplicates by SimHash, with fingerprints compared as vertical bit planes.

Fingerprints come from hashed word shingles. Equal ones collapse into one node. Nodes that share
a key are candidates: for a small radius the keys are the combinations of fingerprint parts of
which one must agree (exact by the pigeonhole principle); for a wide one they are minima of
permuted shingle hashes. Candidates are compared in blocks: bit plane after bit plane goes into
carry-save counters that hold one distance per lane, 64 lanes to a machine word, and what is past
the radius in all lanes is abandoned. A block yields a spanning forest of its links, never all
pairs. Components come from contraction rounds over those links.

A wide radius only estimates similarity. There the components are candidates, and inside each the
sets of shingle hashes are compared exactly before components are built for good.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import column_type, materialise, possibly, slices, small_batches, text_or_empty

SHINGLE = 3
RADIUS = 2
#: Lanes of a block; keys with more members are cut into tiles of about this size.
LANES = 512
#: Texts, and bytes of them, that a task holds as Python strings at once.
_ROWS, _BYTES = 512, 1 << 20
#: Words and hashes of a long text that are worked on at once.
_WORDS, _HASHES = 1 << 16, 255 * 64
#: Bytes of shingle hashes that a block of exact comparisons holds, about.
TILE_BYTES = 4 << 20
#: 128 bits of a text, by which a second pass over the table finds it again.
_TEXT = ["text1", "text2"]
_GOLDEN = 0x9E3779B97F4A7C15


# --- fingerprints -----------------------------------------------------------------------------

def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64, seed 42, of each run of ``shingle`` words; of the whole where there are fewer."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    hash64, out = xxhash.xxh64_intdigest, []
    for lo in range(0, len(words) - shingle + 1, _WORDS):
        some = words[lo:lo + _WORDS + shingle - 1]
        line = b" ".join(some)
        ends = np.cumsum([len(w) + 1 for w in some])
        starts = [0, *ends[:-shingle].tolist()]
        out.append(np.array([hash64(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())], np.uint64))
    return np.concatenate(out)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of a hash (the finaliser of splitmix64)."""
    x = h + np.uint64(_GOLDEN * k & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray, words: int) -> bytes:
    """A bit is 1 if it is set in over half the hashes; no hashes give zero. Big-endian words."""
    if not len(h):
        return bytes(8 * words)
    ones = np.zeros(64 * words, np.int64)
    for lo in range(0, len(h), _HASHES):
        some = h[lo:lo + _HASHES]
        cols = np.empty((len(some), words), ">u8")
        for k in range(words):
            cols[:, k] = _mixed(some, k) if k else some
        rows = cols.view(np.uint8)
        for a in range(0, len(some), 255):
            ones += np.unpackbits(rows[a:a + 255], axis=1).sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h)).tobytes()


def _prints(shingle: int, words: int, minima: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text", _BYTES, _ROWS)):
            fp, same, keys = [], [], []
            for text in batch.column("text").to_pylist():
                h = shingle_hashes(text, shingle)
                if minima:
                    h = np.unique(h)
                fp.append(fingerprint(h, words))
                same.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if minima else None)
                keys.append([int(_mixed(h, 1000 + k).min().view(np.int64)) for k in range(minima)] if len(h) else [0] * minima)
            keep = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(fp, pa.binary()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], [*keep.schema.names, "fp", "same", "minima"])

    return run


def prints(docs: DataFrame, shingle: int, bits: int, minima: int = 0) -> DataFrame:
    """``docs`` (id, ..., text) -> (id, ..., fp, same, minima).

    With minima the distinct shingles vote, and ``same`` is a digest of their set; else it is null.
    """
    rest = "".join(f"`{c}` {column_type(docs, c)}, " for c in docs.columns if c != "text")
    return docs.mapInArrow(_prints(shingle, bits // 64, minima), f"{rest}fp binary, same binary, minima array<long>")


# --- candidates -------------------------------------------------------------------------------

def pigeonhole_keys(fp: Column, radius: int, parts: int) -> Column:
    """Keys of a 64-bit fingerprint: two within the radius agree on all of some ``parts - radius`` parts."""
    number = F.conv(F.hex(fp), 16, -10).cast("long")
    edges = [64 * k // parts for k in range(parts + 1)]
    masks = []
    for some in combinations(range(parts), parts - radius):
        mask = sum(((1 << (edges[p + 1] - edges[p])) - 1) << edges[p] for p in some)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return F.array(*(number.bitwiseAND(F.lit(m)) for m in masks))


def finer_keys(fp: Column, k: Column, radius: int, parts: int) -> Column:
    """Keys of a fingerprint among those that share its ``k``-th key: of the other bits, cut into
    ``radius + 1`` pieces, two within the radius agree on a piece."""
    number = F.conv(F.hex(fp), 16, -10).cast("long")
    edges = [64 * n // parts for n in range(parts + 1)]
    found = None
    for no, some in enumerate(combinations(range(parts), parts - radius)):
        free = [b for p in range(parts) if p not in some for b in range(edges[p], edges[p + 1])]
        cuts = [len(free) * n // (radius + 1) for n in range(radius + 2)]
        masks = [sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]
        keys = F.array(*(number.bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m)) for m in masks))
        found = F.when(k == no, keys) if found is None else found.when(k == no, keys)
    return found


def _links_of(nodes: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the nodes within the radius of each other."""
    near = near_lanes(fps, fps, radius)
    label = np.arange(len(nodes))
    while True:
        new = np.where(near, label[None, :], len(nodes)).min(1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = nodes != nodes[label]
    return nodes[own], nodes[label[own]]


def planes(fps: np.ndarray) -> np.ndarray:
    """(lanes, bytes) -> (bits, words of 64 lanes): one row of words for each bit."""
    bits = np.unpackbits(fps, axis=1).T
    pad = -bits.shape[1] % 64
    return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1)).view(np.uint64)


def near_lanes(queries: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Which lanes lie within the radius of which query, as booleans.

    ``count[k]`` holds bit k of all distances so far, 64 lanes to a word; ``over`` keeps those that
    outgrew the counter. Planes go in by threes through a full adder. Every 16 planes, queries all
    of whose lanes are past the radius are abandoned.
    """
    plane = planes(lanes)
    ask = np.where(np.unpackbits(queries, axis=1).astype(bool), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)).T
    depth = radius.bit_length()
    live = np.arange(len(queries))
    count = [np.zeros((len(queries), plane.shape[1]), np.uint64) for _ in range(depth)]
    over = np.zeros((len(queries), plane.shape[1]), np.uint64)

    def add(x: np.ndarray, at: int) -> None:
        nonlocal over
        for k in range(at, depth):
            count[k], x = count[k] ^ x, count[k] & x
        over = over | x

    bits = len(plane)
    for lo in range(0, bits, 15):
        for j in range(lo, min(lo + 15, bits), 3):
            some = [plane[i][None, :] ^ ask[i][live][:, None] for i in range(j, min(j + 3, bits))]
            if len(some) == 3:
                a, b, c = some
                half = a ^ b
                add(half ^ c, 0)
                add((a & b) | (half & c), 1)
            else:
                for x in some:
                    add(x, 0)
        dead = (past(count, over, radius) == np.uint64(0xFFFFFFFFFFFFFFFF)).all(1)
        if dead.any():
            live = live[~dead]
            count, over = [x[~dead] for x in count], over[~dead]
            if not len(live):
                break
    out = np.zeros((len(queries), len(lanes)), bool)
    if len(live):
        near = ~past(count, over, radius)
        out[live] = np.unpackbits(near.view(np.uint8), axis=1)[:, :len(lanes)].astype(bool)
    return out


def past(count: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius: compared from the highest bit down."""
    more, equal = over, ~over
    for k in range(len(count) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & count[k]
        else:
            more, equal = more | (equal & count[k]), equal & ~count[k]
    return more


def _compare(radius: int, width: int):
    """Rows hold members of one key, or of two tiles; small ones share a block."""

    def links(members: list[np.ndarray], fps: list[np.ndarray]) -> pa.RecordBatch:
        node, at = np.unique(np.concatenate(members), return_index=True)
        a, b = _links_of(node, np.concatenate(fps)[at], radius)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, fps, held = [], [], 0
        for batch in batches:
            for x in batch.column("members"):
                flat = x.values
                n = len(flat)
                if held and held + n > LANES:
                    yield links(members, fps)
                    members, fps, held = [], [], 0
                members.append(flat.field("node").to_numpy(zero_copy_only=False))
                fps.append(np.frombuffer(b"".join(flat.field("fp").to_pylist()), np.uint8).reshape(n, width))
                held += n
        if held:
            yield links(members, fps)

    return run


def links(nodes: DataFrame, radius: int, width: int, lanes: int = LANES, finer=None) -> DataFrame:
    """``nodes`` (node, fp, keys) -> links (a, b) that connect all nodes within the radius.

    Members of a key with more than ``lanes`` of them get the keys that ``finer`` (of fp and k)
    gives, if any, so that all pairs of a frequent key don't meet. Keys that are still as large are
    cut into tiles, and each pair of tiles is a block, so no key meets in one task and none is capped.
    """
    keyed = nodes.select("node", "fp", F.posexplode("keys").alias("k", "v"))

    def counted(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("k", "v").count().where("count > 1")
        return rows.join(counts.hint("merge"), ["k", "v"]).withColumn("tiles", F.ceil(F.col("count") / lanes).cast("int"))

    dealt = counted(keyed)
    if finer is not None:
        dealt = materialise(dealt, "keyed")
        many = dealt.where("tiles > 1").select("node", "fp", "k", "v", F.posexplode(finer(F.col("fp"), F.col("k"))).alias("j", "w"))
        # a key's hash: keys that share it by chance are compared in vain, and nothing else
        many = many.select("node", "fp", (1000 + F.col("k") * (radius + 1) + F.col("j")).alias("k"), F.xxhash64("v", "w").alias("v"))
        dealt = dealt.where("tiles = 1").unionByName(counted(many).select(*dealt.columns))
    member = F.collect_list(F.struct("node", "fp")).alias("members")
    tiled = materialise(dealt.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int")).groupBy("k", "v", "tiles", "tile").agg(member), "tiles")
    alone = tiled.where("tiles = 1").select("members")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    paired = tiled.where("tiles > 1").withColumn("other", other)
    paired = paired.groupBy("k", "v", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u")).agg(F.flatten(F.collect_list("members")).alias("members"))
    compare = _compare(radius, width)
    return alone.mapInArrow(compare, "a long, b long").unionByName(paired.select("members").mapInArrow(compare, "a long, b long"))


# --- components -------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, root) for every node of an edge.

    Each round every node moves to the node that a fresh hash orders first among itself, its
    neighbours and theirs, and edges inside a node vanish. The hash makes the number of rounds grow
    with the logarithm of the nodes, whatever the shape; a star, as links of a block are, is done in
    one, where neighbours alone would halve it.
    """
    steps: list[DataFrame] = []
    left = materialise(edges.where("a <> b").distinct(), "edges")
    while not left.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(order("b")).alias("low")).select(F.col("a").alias("b"), F.least(F.col("low"), order("a")).alias("low"))
        to = both.join(low, "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        to = materialise(to.select("node", F.col("low")["x"].alias("to")), "moves")
        steps.append(to)
        moved = left.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = materialise(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = steps[0].withColumnRenamed("to", "root")
    for step in steps[1:]:
        nxt = step.select(F.col("node").alias("root"), "to")
        labels = labels.join(nxt, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return labels


# --- exact similarity -------------------------------------------------------------------------

def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text", _BYTES, _ROWS)):
            sets = [np.unique(shingle_hashes(text, shingle)).tobytes() for text in batch.column("text").to_pylist()]
            keep = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(sets, pa.binary())], [*keep.schema.names, "hashes"])

    return run


def similar_links(sets: list[np.ndarray], labels: np.ndarray, asks: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (places in ``sets``) of Jaccard ``similarity`` or more that join labels.

    Every asking set is compared with all sets that no link or label joins to it yet, so any two
    that are similar, one of them asking, end up joined. Sets are distinct values, none empty.
    """
    size = np.array([len(x) for x in sets])
    starts = np.cumsum(size) - size
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    label, out = np.array(labels), []
    mark = np.zeros(len(ids), bool)
    for i in np.flatnonzero(asks):
        other = label != label[i]
        if not other.any():
            continue
        own = ids[starts[i]:starts[i] + size[i]]
        mark[own] = True
        shared = np.add.reduceat(mark[ids].astype(np.int64), starts)
        mark[own] = False
        at = np.flatnonzero(other & (shared / (size + size[i] - shared) >= similarity))
        joined, first = np.unique(label[at], return_index=True)
        out += [(int(i), int(j)) for j in at[first]]
        label[np.isin(label, joined)] = label[i]
    return out


def _confirm(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x in batch.column("members"):
                node, label, asks = (x.values.field(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "asks"))
                sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in x.values.field("hashes")]
                for i, j in similar_links(sets, label, asks, similarity):
                    a.append(node[i])
                    b.append(node[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def confirmed(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, shingle: int, similarity: float, lanes: int = LANES) -> DataFrame:
    """Links (a, b) that connect all nodes of a candidate component with Jaccard ``similarity`` or more.

    ``docs``: text1, text2, text; ``nodes``: node, text1, text2 of one of its texts; ``candidates``:
    node, root. A component of up to ``lanes`` nodes is one block, in which every pair is settled.
    A larger one is cut into tiles. Then one node for each group found stands for it, until that
    joins no more; nodes outside the largest group that is left are compared with all others of
    their component. So no similar pair is lost, and copies of one text don't meet all others.
    """
    known = materialise(nodes.select("node", *_TEXT).join(candidates, "node").withColumnRenamed("root", "part"), "candidates")
    maybe, _ = possibly(docs, known, _TEXT)
    texts = maybe.join(known.hint("merge"), _TEXT).select("node", "part", "text")
    sets = texts.mapInArrow(_sets(shingle), "node long, part long, hashes binary").groupBy("node").agg(F.first("part").alias("part"), F.first("hashes").alias("hashes"))
    sets = materialise(sets, "sets")
    cut = lambda rows: F.ceil(F.greatest(F.count(F.lit(1)) / lanes, F.sum(F.octet_length("hashes")) / TILE_BYTES)).cast("int").alias(rows)
    tile = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.coalesce(n, F.lit(1))).cast("int")
    members = F.collect_list(F.struct("node", "label", "asks", "hashes")).alias("members")

    def compare(rows: DataFrame, *key: str) -> DataFrame:
        blocks = rows.groupBy(*key).agg(members).where(F.size("members") > 1).select("members")
        return blocks.mapInArrow(_confirm(similarity), "a long, b long")

    def tiled(rows: DataFrame, large: DataFrame, salt: int) -> DataFrame:
        dealt = rows.join(large, "part", "left").withColumn("tile", tile(salt, F.col("tiles")))
        return materialise(compare(dealt.withColumns({"label": F.col("node"), "asks": F.lit(True)}), "part", "tile"), "confirmed")

    large = materialise(sets.groupBy("part").agg(cut("tiles")).where("tiles > 1"), "large")
    found = tiled(sets, large, 0)
    if large.isEmpty():
        return found
    rows = materialise(sets.join(large.select("part"), "part", "left_semi"), "large-sets")
    left = None
    while True:
        labels = rows.select("node", "part").join(components(found), "node", "left").select("node", "part", F.coalesce("root", "node").alias("label"))
        labels = materialise(labels, "groups")
        groups = materialise(labels.groupBy("part", "label").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")), "pivots")
        apart = materialise(groups.groupBy("part").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("n")).where("n > 1"), "apart")
        now = groups.join(apart.select("part"), "part", "left_semi").count()
        if not now or left is not None and now > 0.9 * left:
            break
        left = now
        pivots = rows.join(groups.join(apart.select("part"), "part", "left_semi").select("node"), "node", "left_semi")
        pivots = materialise(pivots, "pivot-sets")
        found = materialise(found.unionByName(tiled(pivots, pivots.groupBy("part").agg(cut("tiles")), now)), "confirmed")
    if not now:
        return found
    every = materialise(rows.join(labels.drop("part"), "node").join(apart.select("part", "main"), "part"), "labelled")
    strays = every.where("label <> main")
    shape = every.groupBy("part").agg(cut("tiles")).join(strays.groupBy("part").agg(cut("asking")), "part")
    shape = materialise(shape, "shape")
    dealt = lambda rows, salt, n, other: rows.join(shape, "part").withColumns({n[0]: tile(salt, F.col(n[1])), other[0]: F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1))})
    ask = dealt(strays, 1, ("s", "asking"), ("u", "tiles")).withColumn("asks", F.lit(True))
    told = dealt(every, 2, ("u", "tiles"), ("s", "asking")).withColumn("asks", F.lit(False))
    both = ask.select("part", "s", "u", "node", "label", "asks", "hashes").unionByName(told.select("part", "s", "u", "node", "label", "asks", "hashes"))
    return materialise(found.unionByName(compare(both, "part", "s", "u")), "confirmed")


# --- operator ---------------------------------------------------------------------------------

def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = 64, radius: int = RADIUS,
                    parts: int = 5, minima: int = 0, similarity: float = 0.0, lanes: int = LANES) -> DataFrame:
    """Components of documents whose fingerprints link within ``radius`` bits.

    With ``minima`` = 0 fingerprints have 64 bits and no link is lost. Otherwise candidates share
    one of that many minima of permuted shingle hashes, for radii that no exact key covers, and
    documents link only if the sets of their shingle hashes have a Jaccard of ``similarity`` or more.

    Returns one row per input row: the id column, ``fingerprint`` (hex), ``component_id`` (the
    smallest id reachable, itself included). Null and empty texts have the zero fingerprint and
    link like any other. Repeated ids and rows fall into one component by their texts; a null id
    is never a component's id unless it has no other. An empty table gives an empty result. Other
    columns, whatever their names, play no part.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    if minima:
        docs = docs.withColumns({"text1": F.xxhash64("text"), "text2": F.xxhash64(F.lit(1), "text")})
    found = materialise(prints(docs, shingle, bits, minima), "prints")
    keys = F.col("minima") if minima else pigeonhole_keys(F.col("fp"), radius, parts)
    # texts of one set of shingles, or of one narrow fingerprint, are one node
    same = "same" if minima else "fp"
    text = F.min(F.struct(*_TEXT)).alias("text") if minima else F.lit(None).alias("text")
    nodes = found.groupBy(*dict.fromkeys([same, "fp"])).agg(F.min("id").alias("low"), F.min("minima").alias("minima"), text)
    place = [F.col("text")[c].alias(c) for c in _TEXT] if minima else []
    nodes = materialise(nodes.select(*dict.fromkeys([same, "fp"]), "low", *place, keys.alias("keys"), F.monotonically_increasing_id().alias("node")), "nodes")
    edges = links(nodes, radius, bits // 8, lanes, None if minima else lambda fp, k: finer_keys(fp, k, radius, parts))
    if minima:
        edges = confirmed(docs.drop("id"), nodes, materialise(components(edges), "near"), shingle, similarity, lanes)
    labels = materialise(components(edges), "components")
    member = nodes.select(same, "low", "node").join(labels, "node")
    least = member.groupBy("root").agg(F.min("low").alias("least"))
    # nodes without a link are their own component
    known = materialise(member.join(least, "root").select(same, "least"), "linked")
    alone = nodes.select(same, F.col("low")).join(known, same, "left").select(same, F.coalesce("least", "low").alias("component_id"))
    return found.select("id", *dict.fromkeys([same, "fp"])).join(alone.hint("merge"), same).select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
