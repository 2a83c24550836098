"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

Every document of a source is wanted the same number of times on average: target over size. The
whole part is taken as it is. The fractions are rounded in pairs: two documents exchange words at
random, one gaining what the other loses, with the right expectation for both, until the fraction
of one of them is 0 or 1. So a source's words stay what they were. Documents of a source are dealt
to small buckets of similar size; each bucket leaves at most one fraction, and the residuals meet
in a reduction tree, ``FAN`` to a node, up to one per source, which is rounded to the nearer side.
What that leaves of the target in words is made up by a few documents of falling size. So a source
of any size takes a few short rounds, and no task sees more than a bucket. Equal rows are one item
with their number, and are told apart only in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, word_count

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
#: Members of a bucket, and children of a node of the tree.
FAN = 64
SEED = 42
_EPS = 1e-9


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sources`` (source, source_size) -> the same with ``src`` (number by code point) and ``target``.

    Targets share the total by weight; none exceeds ``max_copies`` times its source. The excess goes
    to the others by weight, which comes to one level for all that stay below their limit. One row
    per source goes through these windows.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (number % len(weights) + 1).cast("int"))
    s = sources.select("source", "source_size", number.alias("src"), weight.alias("weight"))
    s = s.withColumn("most", max_copies * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "src")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    rest = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    s = s.withColumn("level", rest / F.sum("weight").over(after)).withColumn("place", F.row_number().over(by_ratio))
    free = F.min(F.when(F.col("most") >= F.col("level") * F.col("weight"), F.struct("place", "level"))).over(everything)
    return s.withColumn("free", free).select("source", "source_size", "src", F.coalesce(F.least("most", F.col("free.level") * F.col("weight")), "most").alias("target"))


def _draw(*key: Column) -> Column:
    """Uniform in [0, 1), the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(*key, F.lit(SEED)), 11).cast("double") / float(1 << 53)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(items: Column, *key: Column) -> Column:
    """Round an array of structs with ``p`` and ``size``: (won: indexes rounded up; k, p, size: the rest)."""
    rest = lambda won, k, p, size: F.struct(won.alias("won"), k.alias("k"), p.alias("p"), size.alias("size"))
    none = lambda won: rest(won, F.lit(-1), F.lit(0.0), F.lit(0).cast("long"))
    numbered = F.transform(items, lambda x, i: F.struct(i.alias("i"), x["p"].alias("p"), x["size"].alias("size")))
    within = lambda p: (p > _EPS) & (p < 1.0 - _EPS)

    def pair(acc: Column, x: Column) -> Column:
        a, b = acc["size"], x["size"]
        gain, loss = F.least((1.0 - acc["p"]) * a, x["p"] * b), F.least(acc["p"] * a, (1.0 - x["p"]) * b)

        def moved(z: Column) -> Column:
            d = F.when(_draw(*key, x["i"]) * (z["gain"] + z["loss"]) < z["loss"], z["gain"]).otherwise(-z["loss"])
            return _let(d, lambda d: F.struct((acc["p"] + d / a).alias("p"), (x["p"] - d / b).alias("q")))

        def settled(z: Column) -> Column:
            one = lambda p, k: F.when(p >= 1.0 - _EPS, F.array(k)).otherwise(F.array().cast("array<int>"))
            won = F.concat(acc["won"], one(z["p"], acc["k"]), one(z["q"], x["i"]))
            return F.when(within(z["p"]), rest(won, acc["k"], z["p"], a)).when(within(z["q"]), rest(won, x["i"], z["q"], b)).otherwise(none(won))

        return _let(_let(F.struct(gain.alias("gain"), loss.alias("loss")), moved), settled)

    def step(acc: Column, x: Column) -> Column:
        return (
            F.when(x["p"] <= _EPS, acc)
            .when(x["p"] >= 1.0 - _EPS, rest(F.concat(acc["won"], F.array(x["i"])), acc["k"], acc["p"], acc["size"]))
            .when(acc["k"] < 0, rest(acc["won"], x["i"], x["p"], x["size"])).otherwise(pair(acc, x))
        )

    return F.aggregate(numbered, none(F.array().cast("array<int>")), step)


def _rounded(docs: DataFrame, fan: int) -> DataFrame:
    """``docs`` (src, size, p, row) -> (src, row, up): which fractions are rounded up."""
    spread = docs.withColumn("cls", F.floor(F.log2("size") * 8).cast("int"))
    classes = spread.groupBy("src", "cls").agg(F.ceil(F.count(F.lit(1)) / fan).alias("buckets"))
    first = F.coalesce(F.sum("buckets").over(Window.partitionBy("src").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = materialise(classes.withColumn("first", first), "size-classes")
    dealt = spread.join(classes, ["src", "cls"]).withColumn("node", F.col("first") + F.pmod(F.xxhash64("row"), F.col("buckets")))
    last = classes.agg(F.max(F.col("first") + F.col("buckets"))).first()[0] or 0
    levels = [dealt.groupBy("src", "node").agg(F.array_sort(F.collect_list(F.struct("size", F.xxhash64("row").alias("h"), "row", "p"))).alias("items"))]
    count, depth = last, 0
    while True:
        own = materialise(levels[-1].withColumn("r", _fold(F.col("items"), F.col("src"), F.lit(depth), F.col("node"))), "level")
        levels[-1] = own
        if count <= 1:
            break
        up = own.select("src", F.floor(F.col("node") / fan).cast("long").alias("above"), F.struct("node", F.col("r.p").alias("p"), F.col("r.size").alias("size")).alias("item"))
        levels.append(up.groupBy("src", F.col("above").alias("node")).agg(F.array_sort(F.collect_list("item")).alias("items")))
        count, depth = -(-count // fan), depth + 1
    decided = levels[-1].select("src", "node", (F.col("r.p") >= 0.5).alias("up"))
    for at in range(len(levels) - 1, -1, -1):
        known = levels[at].join(decided, ["src", "node"])
        up = lambda i: F.array_contains("r.won", i) | ((F.col("r.k") == i) & F.col("up"))
        item = known.select("src", "up", "r", F.posexplode("items").alias("i", "item"))
        decided = item.select("src", F.col("item.node" if at else "item.row").alias("node" if at else "row"), up(F.col("i")).alias("up"))
    return decided


def _made_up(items: DataFrame, max_copies: int) -> DataFrame:
    """``items`` (src, row, size, n, total, target) -> (src, row, more): one copy more or less of few of them.

    Each source's words then come as near its target as single copies of at most two items of each
    power of two in size, largest first, can bring them without passing it.
    """
    gap = items.groupBy("src").agg((F.first("target") - F.sum(F.col("total") * F.col("size"))).alias("gap"))
    one = F.struct("size", F.xxhash64("row").alias("h"), "row")
    some = lambda f, may: f(F.when(may, one))
    may_add, may_drop = F.col("total") < F.col("n") * max_copies, F.col("total") > 0
    by_size = items.where("size > 0").groupBy("src", F.floor(F.log2("size")).alias("cls")).agg(
        F.array_distinct(F.array(some(F.max, may_add), some(F.min, may_add))).alias("add"), F.array_distinct(F.array(some(F.max, may_drop), some(F.min, may_drop))).alias("drop"))
    listed = by_size.groupBy("src").agg(F.flatten(F.collect_list("add")).alias("add"), F.flatten(F.collect_list("drop")).alias("drop"))  # at most 64 classes
    known = listed.join(gap, "src").withColumn("use", F.reverse(F.array_sort(F.filter(F.when(F.col("gap") > 0, F.col("add")).otherwise(F.col("drop")), lambda x: x.isNotNull()))))
    start = F.struct(F.abs("gap").alias("left"), F.filter("use", lambda x: F.lit(False)).alias("won"))
    fold = F.aggregate("use", start, lambda acc, x: F.when(x["size"] <= acc["left"], F.struct((acc["left"] - x["size"]).alias("left"), F.concat(acc["won"], F.array(x)).alias("won"))).otherwise(acc))
    won = known.select("src", F.when(F.col("gap") > 0, 1).otherwise(-1).alias("more"), F.explode(fold["won"]["row"]).alias("row"))
    return materialise(won, "made-up")


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS,
        max_copies: int = MAX_COPIES, fan: int = FAN) -> DataFrame:
    """How often each document is taken, so that each source comes near its target.

    Returns one row per input row: the id column, ``size`` (words; null text: 0), ``source_size``,
    ``target`` (of its source), ``copies``, ``taken`` (copies times size). Null sources are one
    source, last in order. Documents without words are not taken.
    Ids may repeat or be null; equal rows are interchangeable, so reruns agree. An empty table
    gives an empty result. Other columns, whatever their names, play no part.
    """
    sized = materialise(df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    wanted = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies), "targets")
    rows = sized.groupBy("source", F.struct("id", "size").alias("row")).agg(F.count(F.lit(1)).alias("n"))
    known = rows.join(wanted.withColumnRenamed("source", "s"), rows["source"].eqNullSafe(F.col("s"))).withColumn("size", F.col("row.size"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    exact = F.when(F.col("size") > 0, F.col("n") * share).otherwise(0.0)
    whole = F.floor(exact + _EPS)
    items = materialise(known.select("src", "row", "size", "n", "source_size", "target", whole.alias("whole"), F.greatest(exact - whole, F.lit(0.0)).alias("p")), "items")
    rounded = _rounded(items.where("size > 0").select("src", "size", "p", "row"), fan)
    taken = items.join(rounded, ["src", "row"], "left").withColumn("total", F.col("whole") + F.coalesce(F.col("up").cast("int"), F.lit(0)))
    taken = materialise(taken.drop("up", "whole", "p"), "rounded")
    final = taken.join(_made_up(taken, max_copies), ["src", "row"], "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0)))
    # equal rows share their copies out, in runs of at most 1,024 rows
    alone = final.where("n = 1").select("*", F.lit(0).cast("long").alias("k"))
    runs = final.where("n > 1").select("*", F.explode(F.expr("sequence(0, (n - 1) div 1024)")).alias("run")).repartition("row", "run")
    many = runs.select("*", F.explode(F.expr("sequence(run * 1024, least(n, (run + 1) * 1024) - 1)")).alias("k")).drop("run")
    copies = F.expr("(total div n + int(k < total % n))").cast("int")
    every = alone.unionByName(many).withColumn("copies", copies)
    return every.select(F.col("row.id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
