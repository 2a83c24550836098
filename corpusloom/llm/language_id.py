"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to three bytes, with a bounded number of nodes. A
byte seen after a context costs its share of that context; an unseen one costs the context's escape
and is then priced in the next shorter context, down to a uniform price for bytes never seen. The
statistics are frozen after fitting, so the price of every byte after every context can be tabled,
and the exact code length of a text is a sum of table entries. The language with the shortest code
wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import column_type, materialise, numbered, slices, small_batches, text_or_empty

#: About so many labelled rows of each language are fitted on, chosen row by row by a hash of the
#: id, the text and the row's place in its file, so that rows of one id are drawn apart.
SAMPLE_PER_LANGUAGE = 2_000
#: So many languages are learned at most, those with the most labelled rows; dirty labels can't grow the model beyond.
MOST_LANGUAGES = 256
#: Nodes of a language's tree: its most frequent contexts of up to three bytes, the empty one first.
#: A table of prices thus has at most 2,048 x 257 entries, 2 MB, a language.
NODES_PER_LANGUAGE = 2_048
UNKNOWN = "und"
#: Characters priced at once; rows, and bytes of text, taken from a batch.
_SLICE, _ROWS, _BYTES = 1 << 17, 512, 1 << 20


@dataclass(frozen=True)
class Model:
    """``symbol``: byte -> symbol (0: start or unseen); ``node``: three symbols -> longest context in any tree.

    ``rows[language, node]`` is the row of ``prices[language]`` that the language prices the node
    by, its own longest context; ``prices[language][row, symbol]`` is in bits. ``node`` has one
    entry for each three symbols, at most 68 MB, however many languages there are.
    """

    languages: list[str]
    symbol: np.ndarray
    node: np.ndarray
    rows: np.ndarray
    prices: list[np.ndarray]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each byte with the three before it, by language; start pads count as byte 0."""
    held: dict[str, dict[int, int]] = {}
    for batch in (part for b in batches for part in slices(b, "text", _BYTES, _ROWS)):
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        texts = batch.column("text").to_pylist()
        for lang in set(langs):
            for k in np.flatnonzero(langs == lang):
                data = b"\0\0\0" + texts[k].encode()
                own = held.setdefault(lang, {})
                for at in range(0, len(data) - 3, _SLICE):
                    grams, n = np.unique(_grams(np.frombuffer(data[at:at + _SLICE + 3], np.uint8)), return_counts=True)
                    for g, c in zip(grams.tolist(), n.tolist()):
                        own[g] = own.get(g, 0) + c
    for lang, own in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])


def _grams(b: np.ndarray) -> np.ndarray:
    b = b.astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample_per_language: int = SAMPLE_PER_LANGUAGE, nodes_per_language: int = NODES_PER_LANGUAGE,
        most_languages: int = MOST_LANGUAGES) -> Model:
    """Fit on about ``sample_per_language`` whole texts of each language that ``labelled`` holds.

    Rows without text or language are left out, and so are languages whose sample has no byte to
    count. Spark counts, and chooses each tree's nodes: the driver gets at most 256 counts for
    each of them, and never a text.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = numbered(labelled).select(F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").cast("string").alias("text"), F.col(f"doc.`{lang_col}`").cast("string").alias("lang"), "row.place")
    rows = rows.where("text <> '' and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not sizes:
        return Model([], np.zeros(256, np.uint8), np.zeros(1, np.int32), np.zeros((0, 1), np.int32), [])
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, sample_per_language / n))))
    # of a language that isn't learned there is no share, and null chooses no row
    chosen = rows.where(F.pmod(F.xxhash64("id", "text", "place", F.lit("sample")), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    grams = materialise(chosen.select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    # a context is its bytes above its length, a gram's first three bytes
    context = F.explode(F.array(*(F.expr(f"shiftright(gram, 8) % {1 << 8 * k} + {k << 24}") for k in range(4)))).alias("context")
    seen = grams.select("lang", context, (F.col("gram") % 256).alias("byte"), "n").groupBy("lang", "context", "byte").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("total"), "context")  # a context's shorter ones come before it
    nodes = seen.groupBy("lang", "context").agg(F.sum("n").alias("total")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= nodes_per_language)
    found = seen.join(nodes.select("lang", "context"), ["lang", "context"]).toArrow()
    lang, key, byte, n = (found.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "context", "byte", "n"))
    return _tables(sorted(set(lang)), lang, key.astype(np.int64), byte.astype(np.int64), n.astype(np.int64))


def _tables(languages: list[str], lang: np.ndarray, key: np.ndarray, byte: np.ndarray, n: np.ndarray) -> Model:
    seen = np.setdiff1d(byte, [0])
    symbol = np.zeros(256, np.uint8)
    symbol[seen] = np.arange(1, len(seen) + 1)
    size = len(seen) + 1
    # nodes of all trees, shorter contexts first
    nodes = np.unique(np.append(key, 0))
    length = nodes >> 24
    a, b, c = (symbol[nodes >> s & 255] for s in (16, 8, 0))
    node = np.zeros((size, size, size), np.int32)
    for k, at in ((k, np.flatnonzero(length == k)) for k in (1, 2, 3)):
        node[(a[at] if k > 2 else slice(None), b[at] if k > 1 else slice(None), c[at])] = at
    # a node's context without its first byte, which is a node of the same trees
    shorter = np.searchsorted(nodes, np.where(length > 0, (length - 1 << 24) + (nodes & (1 << 8 * np.maximum(length - 1, 0)) - 1), 0))
    rows, prices = np.zeros((len(languages), len(nodes)), np.int32), []
    for k, name in enumerate(languages):
        mine = lang == name
        at = np.searchsorted(nodes, key[mine])
        own = np.union1d(at, [0])
        rows[k, own] = np.arange(len(own))
        rest = np.setdiff1d(np.arange(len(nodes)), own)
        for m in (1, 2, 3):
            some = rest[length[rest] == m]
            rows[k, some] = rows[k, shorter[some]]
        counts = np.bincount(rows[k, at] * size + symbol[byte[mine]], weights=n[mine], minlength=len(own) * size).reshape(len(own), size)
        # bytes never seen share one symbol; its price is that of one of the 256 bytes
        p = np.full((len(own), size), 1 / 256)
        for m in range(4):
            some = np.flatnonzero(length[own] == m)
            p[some] = _extend(counts[some], p[rows[k, shorter[own[some]]]])
        prices.append(-np.log2(p).astype(np.float32))
    return Model(languages, symbol, node.ravel(), rows, prices)


def _extend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities in longer contexts: escapes weigh as many as the distinct bytes seen there."""
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
    return counts / np.maximum(total + kinds, 1) + escape * shorter


def code_lengths(model: Model, texts: list[str]) -> np.ndarray:
    """Bits that each language needs for each whole text: (texts, languages)."""
    out = np.zeros((len(texts), len(model.languages)))
    k = 0
    while k < len(texts):
        group, held = [], 0
        while k < len(texts) and (not group or held + len(texts[k]) < _SLICE):
            group.append(k)
            held += len(texts[k])
            k += 1
        data = [texts[i].encode() for i in group]
        for at in range(0, max(map(len, data)), _SLICE) if len(data) == 1 else (0,):
            pad = b"\0\0\0" if not at else data[0][at - 3:at]
            some = [d[at:at + _SLICE] for d in data] if len(data) == 1 else data
            b = model.symbol[np.frombuffer(b"".join(pad + d for d in some), np.uint8)].astype(np.int64)
            if len(b) <= 3:
                continue
            size = model.prices[0].shape[1]
            node = model.node[(b[:-3] * size + b[1:-2]) * size + b[2:-1]]
            ends = np.cumsum([len(d) + 3 for d in some]) - 3
            starts = np.concatenate([[0], ends[:-1] + 3])
            for lang in range(len(model.languages)):
                price = model.prices[lang].ravel()[model.rows[lang][node].astype(np.int64) * size + b[3:]]
                total = np.concatenate([[0.0], np.cumsum(price, dtype=np.float64)])
                out[group, lang] += total[ends] - total[starts]
    return out


def _judged(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the language with the shortest code, its score, and its bits a byte."""
    bits = code_lengths(model, texts)
    gap = np.minimum(bits - bits.min(1, keepdims=True), 1000)
    # of equal ones the first language by name
    return bits.argmin(1), 1 / np.exp2(-gap).sum(1), bits.min(1) / [len(t.encode()) for t in texts]


def _predict(shared, fold_above: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in (part for b in batches for part in slices(b, "text", _BYTES, _ROWS)):
            known = np.array(batch.column("letters").to_pylist(), dtype=bool)
            texts = batch.column("text").to_pylist()
            lang, score, cost = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts)), np.full(len(texts), np.nan)
            at = np.flatnonzero(known)
            if len(at) and model.languages:
                best, score[at], cost[at] = _judged(model, [texts[i] for i in at])
                odd = np.flatnonzero(cost[at] >= fold_above)
                if len(odd):
                    low, sure, bits = _judged(model, [texts[i].lower() for i in at[odd]])
                    less = bits < cost[at[odd]]
                    best[odd[less]], score[at[odd[less]]], cost[at[odd[less]]] = low[less], sure[less], bits[less]
                lang[at] = np.array(model.languages, dtype=object)[best]
            keep = batch.drop_columns(["text", "letters"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cost, pa.float64(), from_pandas=True)], [*keep.schema.names, "lang_pred", "score", "bits_per_byte"])

    return run


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(df: DataFrame, model: Model, text_col: str = "text", fold_above: float = np.inf) -> DataFrame:
    """``df`` without the text, with ``lang_pred``, ``score`` and ``bits_per_byte``.

    The score is the winner's share when each language weighs two to the minus its code length;
    ``bits_per_byte`` is that length by the text's bytes. A text that is null or has no letter, or
    a model without languages, gives ``und``, 0 and null. A text of ``fold_above`` bits a byte or
    more is judged by its lower-cased form, if that is cheaper. Other columns keep their names, but for
    those of the result, which replace columns of the same name. Rows are judged one by one, so
    repeated ones come out alike.
    """
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in (text_col, "lang_pred", "score", "bits_per_byte")]
    kept = [F.col(f"`{c}`").alias(f"kept{k}") for k, c in enumerate(rest)]  # so that no name clashes on the way
    ready = df.select(*kept, has_letter(F.col(text_col)).alias("letters"), text_or_empty(text_col).alias("text"))
    schema = ", ".join([*(f"kept{k} {column_type(df, c)}" for k, c in enumerate(rest)), "lang_pred string, score double, bits_per_byte double"])
    found = ready.mapInArrow(_predict(df.sparkSession.sparkContext.broadcast(model), fold_above), schema)
    return found.select(*(F.col(f"kept{k}").alias(c) for k, c in enumerate(rest)), "lang_pred", "score", "bits_per_byte")


def held_out(id_col: Column) -> Column:
    """True for every fourth id by its CRC-32 as text; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out and predict every row's language.

    Returns one row per input row: the id column, ``held_out``, ``lang_pred``, ``score``,
    ``bits_per_byte``. Ids may repeat or be null; an empty table gives an empty result; other columns play no part.
    """
    model = fit(df.where(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    found = predict(docs.select("id", held_out(F.col("id")).alias("held_out"), "body"), model, "body")
    return found.withColumnRenamed("id", id_col)
