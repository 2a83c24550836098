"""URL filters: explicit host and path rules, and association rules mined from labelled URLs.

URLs that an explicit rule judges are the labelled transactions: their tokens and their label.
Spark's FP-growth mines combinations of up to MAX_TOKENS tokens that imply a label from all of them,
pruned by support, in rows as well, and confidence; rules made of the explicit rules' own host names
alone aren't used.
Mined rules are posted under one token each; a URL's tokens look them up there, and a rule
applies if the URL has all its tokens.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
SITE_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE, MAX_TOKENS = 0.005, 5, 0.9, 3
DEFAULT = "allow"
_LABEL = "label="
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From the first :// to the next / ? # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def site_rule(host: Column, path: Column, rules=SITE_RULES) -> Column:
    """The longest rule (text, verdict) that fits the host or a parent of it and begins the path."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    return F.coalesce(*fits)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments (digits as #), extension, query keys, fragment."""
    tagged = lambda tag, xs: F.transform(xs, lambda x: F.concat(F.lit(tag), x))
    shape = F.regexp_replace(path, r"\d+", "#")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    every = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, r"(?s)^(.*?)://", 1))), tagged("host:", F.split(host, r"\.")), tagged("path:", F.split(shape, "/")),
        F.array(F.concat(F.lit("ext:"), F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), tagged("key:", keys), F.array(F.concat(F.lit("frag:"), F.regexp_extract(url, r"(?s)#(.*)$", 1))),
    )
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(every, F.array()), lambda t: ~t.endswith(":"))))


def rule_tokens(rules=SITE_RULES) -> list[str]:
    """Host tokens of the explicit rules themselves, which say where the labels come from."""
    return sorted({"host:" + part for host, _, _ in rules for part in host.split(".")})


def _combinations(items: Column) -> Column:
    """All sets of one to three of the items of a sorted array, as arrays."""
    after = lambda xs, i: F.slice(xs, i + 2, F.size(xs))
    pairs = lambda xs: F.flatten(F.transform(xs, lambda x, i: F.transform(after(xs, i), lambda y: F.array(x, y))))
    triples = F.flatten(F.transform(items, lambda x, i: F.transform(pairs(after(items, i)), lambda p: F.concat(F.array(x), p))))
    return F.concat(F.transform(items, lambda x: F.array(x)), pairs(items), triples)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE, given: list[str] | None = None) -> DataFrame:
    """``labelled`` (tokens, label) -> (antecedent, label, confidence, support), from every row.

    A rule needs ``min_support`` of the rows, and ``min_rows`` of them, and has at most MAX_TOKENS
    tokens. FP-growth, which can't be bounded by length, is given each row's combinations of up to
    so many tokens, each as one item beside the label, so that its work grows with the third power
    of a URL's tokens and never exponentially. Tokens of the very same rows (every key of a form,
    say) are one item there and come apart again in the rules, and those of all rows combine with
    none. A rule whose rows are just those of a part of it would say nothing more, and isn't kept;
    nor are rules of ``given`` tokens only, which would restate what the labels were made from.
    """
    spark = labelled.sparkSession
    rows = materialise(labelled.select(F.monotonically_increasing_id().alias("uid"), F.array_distinct("tokens").alias("tokens"), "label"), "labelled")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "antecedent array<string>, label string, confidence double, support double")
    least = min(total, max(math.ceil(min_support * total), min_rows))
    each = rows.select("uid", "label", F.explode("tokens").alias("token"))
    extent = [F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.xxhash64("uid", F.lit(k))).alias(f"x{k}") for k in range(2))]
    # frequent tokens, of which there are at most 1 / min_support times the tokens of a URL, by the rows they are in
    alike = each.groupBy("token").agg(*extent).where(F.col("n") >= least).groupBy("n", "x0", "x1").agg(F.collect_list("token").alias("members"))
    alike = materialise(alike.select(F.monotonically_increasing_id().alias("item"), "n", "members"), "items")
    known = alike.select("item", "n", F.explode("members").alias("token"))
    sets = each.join(known, "token").groupBy("uid", "label").agg(
        F.array_sort(F.collect_set(F.when(F.col("n") < total, F.col("item")))).alias("items"), F.collect_set(F.when(F.col("n") == total, F.col("item"))).alias("always"))
    named = F.transform(F.concat(_combinations(F.col("items")), F.transform("always", lambda x: F.array(x))), lambda c: F.array_join(c.cast("array<string>"), ","))
    deals = materialise(sets.select(F.explode(named).alias("c"), F.concat(F.lit(_LABEL), "label").alias("label")), "combinations").select(F.array("c", "label").alias("items"))
    number = deals.count()
    if not number:
        return spark.createDataFrame([], "antecedent array<string>, label string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / number, minConfidence=min_confidence).fit(deals)
    sizes = model.freqItemsets.where((F.size("items") == 1) & ~F.col("items")[0].startswith(_LABEL)).select(F.col("items")[0].alias("c"), F.col("freq").alias("n"))
    sizes = materialise(sizes, "combination-sizes")
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith(_LABEL))
    rules = rules.select(F.col("antecedent")[0].alias("c"), F.substring(F.element_at("consequent", 1), len(_LABEL) + 1, 1000).alias("label"), "confidence", F.round(F.col("support") * number).alias("hits"))
    rules = materialise(rules.join(sizes, "c"), "combination-rules")
    # without one of its tokens, a set that adds anything is in more rows
    parts = F.split("c", ",")
    fewer = rules.where(F.size(parts) > 1).select("c", "n", F.explode(F.transform(parts, lambda x: F.array_join(F.array_remove(parts, x), ","))).alias("less"))
    idle = fewer.join(sizes.select(F.col("c").alias("less"), F.col("n").alias("n_less")), "less").where("n = n_less").select("c").distinct()
    kept = rules.join(idle, "c", "left_anti").withColumns({"antecedent": F.array().cast("array<string>"), "left": parts})
    for _ in range(MAX_TOKENS):  # each item by each token that it stands for
        at = alike.select(F.col("item").cast("string").alias("item"), F.explode("members").alias("token"))
        more = kept.where(F.size("left") > 0).withColumn("item", F.col("left")[0]).join(at, "item")
        more = more.withColumns({"antecedent": F.concat("antecedent", F.array("token")), "left": F.slice("left", 2, MAX_TOKENS)}).select(*kept.columns)
        kept = kept.where(F.size("left") == 0).unionByName(more)
    own = F.size(F.array_except("antecedent", F.array(*(F.lit(t) for t in given or [])).cast("array<string>"))) > 0
    return kept.where(own).select(F.array_sort("antecedent").alias("antecedent"), "label", "confidence", (F.col("hits") / total).alias("support"))


def apply_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``sets`` (tokens) -> (tokens, label) of the most confident rule that a token set contains.

    Ties go to the larger support, then to the rule that sorts last. Sets without a rule are absent.
    """
    # a rule is posted under the token of its antecedent that the fewest rules have
    use = rules.select(F.explode("antecedent").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    spread = rules.withColumn("token", F.explode("antecedent")).join(use, "token")
    index = spread.groupBy("antecedent", "label", "confidence", "support").agg(F.min(F.struct("uses", "token"))["token"].alias("token"))
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hits.groupBy("tokens").agg(F.max(F.struct("confidence", "support", "antecedent", "label"))["label"].alias("label"))


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=SITE_RULES) -> DataFrame:
    """Judge every URL by its longest explicit rule, else by mined rules, else allow.

    Returns one row per input row: the id column, ``host``, ``path``, ``rule`` (null if none),
    ``verdict``. A null URL or one without :// has empty host and path. Ids may repeat or be null;
    equal URLs are judged alike; an empty table gives an empty result; other columns play no part.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumns({"ruled": site_rule(F.col("host"), F.col("path"), rules), "tokens": tokens(F.col("url"), F.col("host"), F.col("path"))}).drop("url")
    rows = materialise(rows, "urls")
    mined = materialise(mine(rows.where("ruled is not null").select("tokens", F.col("ruled.verdict").alias("label")), given=rule_tokens(rules)), "rules")
    found = apply_rules(rows.where("ruled is null").select("tokens").distinct(), mined)
    joined = rows.join(materialise(found, "judged"), "tokens", "left")
    return joined.select(F.col("id").alias(id_col), "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", "label", F.lit(DEFAULT)).alias("verdict"))
