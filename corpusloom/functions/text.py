"""Text functions as column expressions; white space and case follow Unicode unless said otherwise."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a lexical token, a reasoning block, a sentence end.
TOKEN = r"\$?\d+(?:[.,]\d+)*%?|[A-Za-z]+"
THINK = r"(?s)<\s*think(?:ing)?\s*>.*?<\s*/\s*think(?:ing)?\s*>"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"

# Phrases that make a query complex or simple.
COMPLEX = (
    "compare", "comparison", "contrast", "versus", " vs ", "vs.", "better than", "worse than", "outperform", "underperform", "bull", "bear",
    "thesis", "risk profile", "liquidity risk of", "investment recommendation", "should i invest", "buy or sell", "build a case",
)
SIMPLE = (
    "what was", "what were", "what is the", "how much", "how many", "when did", "when was", "revenue of", "net income", "net sales", "gross margin",
    "operating margin", "earnings per share", "eps", "pe ratio", "dividend", "free cash flow", "total cash",
)


def strip_u(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze_u(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), strip_u), lambda s: F.length(s) > 0)


def words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def strip_think(c: Column) -> Column:
    """Without reasoning blocks; one that isn't closed stays."""
    return strip_u(F.regexp_replace(c, THINK, ""))


def contains_any(c: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(p) for p in phrases))


def complexity(query: Column) -> Column:
    """complex, simple or normal, by phrases anywhere in the query; complex wins."""
    q = strip_u(F.lower(query))
    return F.when(contains_any(q, COMPLEX), "complex").when(contains_any(q, SIMPLE), "simple").otherwise("normal")


def last_places(text: Column, patterns: list[str]) -> Column:
    """0-based start of the last match of each pattern, null where there is none, as an array.

    One pass over the text stops wherever some pattern matches, whatever overlaps it, and tells
    there which of them do. A regular expression of Spark's gives matches but no places. Of a
    batch's texts only one at a time is made a Python string.
    """
    every = [re.compile(p, re.I | re.S) for p in patterns]
    some = re.compile("(?=" + "|".join(f"(?:{p})" for p in patterns) + ")", re.I | re.S)

    def places(t: str | None) -> list[int | None] | None:
        if t is None:
            return None
        last: list[int | None] = [None] * len(every)
        for hit in some.finditer(t):
            at = hit.start()
            for k, p in enumerate(every):
                if p.match(t, at):
                    last[k] = at
        return last

    found = F.arrow_udf(lambda texts: pa.array((places(t.as_py()) for t in texts), pa.list_(pa.int32())), "array<int>")
    return found(text)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector, a null, or vectors of different lengths."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    norm = lambda x: F.sqrt(total(F.transform(d(x), lambda v: v * v)))
    return F.when(F.size(a) == F.size(b), F.try_divide(total(F.zip_with(d(a), d(b), lambda x, y: x * y)), norm(a) * norm(b)))


def or_none(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def vector_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))
