"""How far the sources of a language differ in their words: a token-start pointer sort.

Each task builds pointers to the starts of all words over the Arrow buffer of a slice of texts,
lower-cased in place, and sorts the pointers, not the words, by multikey quicksort: by the next
eight bytes at a time, each run of pointers that are still equal going on to the eight bytes after
those. Runs of equal words then give occurrences and documents by source. Spark adds the slices up.
Shares and divergences are whole numbers throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, small_batches

#: Shares are in parts of this; a term is kept from so many documents on; ranks of terms go to this.
SCALE, LEAST_DOCS, RANKS = 1_000_000_000, 3, 200
#: Bytes of text whose pointers are sorted at once (or one longer text).
SLICE_BYTES = 8 << 20
#: Words still equal after so many bytes are compared whole.
DEPTH = 64
#: Numbers in the matrix of shares that a task holds at once.
_CELLS = 1 << 19

_byte = np.arange(256)
_letter = ((_byte >= 0x41) & (_byte <= 0x5A)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
#: A byte of a term in lower case (A-Z only), or 0 for all that stands between terms.
_FOLD = np.where(_letter, np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte), 0).astype(np.uint8)
_KEEP = np.array([0] + [(1 << 64) - (1 << (64 - 8 * n)) for n in range(1, 9)], dtype=np.uint64)


def pointers(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes (eight zeros after them), and the start and length of each term; ``ends``: where texts end."""
    fold = np.zeros(len(data) + 8, np.uint8)
    np.take(_FOLD, data, out=fold[:len(data)])
    inside = fold[:len(data)] != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = ends[(ends > 0) & (ends < len(data))]  # a term ends with its text
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(first)
    return fold, start, np.flatnonzero(last) + 1 - start


def sort_pointers(fold: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their terms, and the number of each one's run of equal terms."""
    eight = np.lib.stride_tricks.as_strided(fold[:8].view(">u8"), shape=(len(fold) - 7,), strides=(1,))

    def character(at: np.ndarray, depth: int) -> np.ndarray:
        """Eight bytes from a depth on as one number; zeros after the term's end."""
        left = np.clip(length[at] - depth, 0, 8)
        return eight[np.where(left > 0, start[at] + depth, 0)].astype(np.uint64) & _KEEP[left]

    key = character(np.arange(len(start)), 0)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    depth = 8
    while True:
        run = np.cumsum(new) - 1
        several = np.bincount(run, minlength=1)[run] > 1
        going = np.flatnonzero(several & (length[order] >= depth)) if depth == 8 else going[several[going] & (length[order[going]] >= depth)]
        if not len(going):
            return order, run
        own, runs = order[going], run[going]
        if depth < DEPTH:
            key = character(own, depth)
            by = np.lexsort((key, runs))
            order[going] = own[by]
            differ = (runs[by][1:] == runs[by][:-1]) & (key[by][1:] != key[by][:-1])
            depth += 8
        else:
            words = [fold[start[p] + depth:start[p] + length[p]].tobytes() for p in own]
            by = sorted(range(len(own)), key=lambda k: (runs[k], words[k]))
            order[going] = own[by]
            differ = np.array([runs[a] == runs[b] and words[a] != words[b] for a, b in zip(by, by[1:])], bool)
            depth = 1 << 62
        new[going[1:][differ]] = True


def tally(texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts with their groups: for each term in each group the term, the group, occurrences and documents."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    ends = offsets[1:].astype(np.int64) - offsets[0]
    fold, start, length = pointers(data, ends)
    if not len(start):
        return pa.array([], pa.string()), *(np.zeros(0, np.int64),) * 3
    order, run = sort_pointers(fold, start, length)
    # documents in the order of their groups, so that a term's documents of a group stand together
    rank = np.empty(len(texts), np.int64)
    by_group = np.argsort(group, kind="stable")
    rank[by_group] = np.arange(len(texts))
    place = run * len(texts) + rank[np.searchsorted(ends, start[order], "right")]
    place.sort()
    at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    times = np.diff(np.append(at, len(place)))
    term, own = place[at] // len(texts), group[by_group][place[at] % len(texts)]
    cut = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (own[1:] != own[:-1])]))
    one = order[np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))]  # a pointer of each run
    size = length[one]
    to = np.concatenate([[0], np.cumsum(size)])
    letters = fold[np.repeat(start[one] - to[:-1], size) + np.arange(to[-1])]
    words = pa.StringArray.from_buffers(len(one), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(letters))
    return words.take(pa.array(term[cut])), own[cut], np.add.reduceat(times, cut), np.diff(np.append(cut, len(term)))


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> occurrences and documents of terms; a row without a term names a group."""
    waiting, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(waiting).combine_chunks()
        lang, source, text = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
        langs, sources = lang.dictionary_encode(), source.dictionary_encode()
        code = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        there, group = np.unique(code, return_inverse=True)
        terms, own, n, docs = tally(text, group)
        l_of, s_of = (d.take(pa.array(x)) for d, x in ((langs.dictionary, there // len(sources.dictionary)), (sources.dictionary, there % len(sources.dictionary))))
        every = np.arange(len(there))
        yield pa.RecordBatch.from_arrays([l_of, s_of, pa.nulls(len(there), pa.string()), pa.array(every * 0), pa.array(every * 0)], ["lang", "source", "term", "n", "docs"])
        for a in range(0, len(terms), 50_000):
            some = pa.array(own[a:a + 50_000])
            yield pa.RecordBatch.from_arrays([l_of.take(some), s_of.take(some), terms[a:a + 50_000], pa.array(n[a:a + 50_000]), pa.array(docs[a:a + 50_000])], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting and size + batch.nbytes > SLICE_BYTES:
            yield from flush()
            waiting, size = [], 0
        waiting.append(batch)
        size += batch.nbytes
    if waiting:
        yield from flush()


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / whole) for count <= whole: long division by thousands, so that nothing overflows below 9e15."""
    out, left = np.zeros(np.broadcast_shapes(count.shape, whole.shape), np.int64), count
    for _ in range(3):
        out = out * 1000 + left * 1000 // whole
        left = left * 1000 % whole
    return out + 1


def _divergences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, own: [(source_no, n)], totals: [N], kept: V) of terms -> sums over this task's terms for each pair of sources."""
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        code = lang.indices.to_numpy()
        for k, name in enumerate(lang.dictionary.to_pylist()):
            rows = batch.take(pa.array(np.flatnonzero(code == k)))
            whole = np.array(rows.column("totals")[0].as_py(), np.int64) + rows.column("kept")[0].as_py()
            many = len(whole)
            total = found.setdefault(name, np.zeros((many, many), np.int64))
            for a in range(0, rows.num_rows, max(1, _CELLS // many)):
                own = rows.column("own").slice(a, max(1, _CELLS // many))
                entries = own.flatten()
                row = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
                count = np.zeros((len(own), many), np.int64)
                count[row, entries.field("source_no").to_numpy()] = entries.field("n").to_numpy()
                p = share(count + 1, whole[None, :])
                for s in range(many):
                    d = p[:, s:s + 1] - p
                    total[s] += (d * d // p).sum(0)
    for name, total in found.items():
        many = len(total)
        a, b = np.divmod(np.arange(many * many), many)
        yield pa.RecordBatch.from_arrays([pa.array([name] * (many * many), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total.ravel())], ["lang", "source_no", "other_no", "part"])


def _share(count: Column, whole: Column) -> Column:
    """As ``share``, for Spark: a decimal product, so that it can't overflow."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)"), whole.cast("decimal(19,0)")) + 1


def group_terms(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, and a row without a term for each group."""
    small_batches(df.sparkSession)
    docs = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    found = docs.mapInArrow(_tallies, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """How far each source's words differ from those of the others of its language, and by which words.

    Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased. A language
    keeps the terms in at least ``least_docs`` of its documents. With p = 1 + floor(10^9 (n + 1) /
    (N + V)) of a source and q that of another (part ``pair``) or of the whole language (part
    ``term``), a term's value is floor((p - q)^2 / q). Returns ``lang``, ``source``, ``part``,
    ``item`` (the other source, or a term that the source has more of; those up to rank ``ranks``),
    ``value`` (a sum over all kept terms in part ``pair``), ``rank``.

    Null languages, sources and texts count as empty strings. A group without terms has pairs; a
    language without a kept term has values of 0; one with a single source has no pairs. Repeated
    rows count each time. An empty table gives an empty result. Other columns, whatever their
    names, play no part. A row of the work holds one term's counts by source; a task holds the
    matrix of a language's sources, which the result has too.
    """
    counts = materialise(group_terms(df, lang_col, source_col, text_col), "group-terms")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("by"))
    kept = materialise(kept.where(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    each = kept.select("lang", "term", "lang_n", F.explode("by").alias("s")).select("lang", "term", "lang_n", "s.source", "s.n")
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    of_group = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = counts.where("term is null").select("lang", "source").join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = materialise(groups.select("lang", "source", number.alias("source_no"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "lang_total"))), "source-groups")

    # Spark broadcasts the table of groups if it is small, by its real size
    entries = each.join(groups, ["lang", "source"])
    p, q = _share(F.col("n"), F.col("total") + F.col("kept")), _share(F.col("lang_n"), F.col("lang_total") + F.col("kept"))
    terms = entries.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", "part", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))

    totals = groups.groupBy("lang", "kept").agg(F.array_sort(F.collect_list(F.struct("source_no", "total")))["total"].alias("totals"))
    no = groups.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "source_no"))).alias("nos"))
    about = materialise(totals.join(no, "lang"), "languages")
    rows = kept.join(about, "lang").select("lang", F.transform("by", lambda x: F.struct(F.col("nos")[x["source"]].alias("source_no"), x["n"].alias("n"))).alias("own"), "totals", "kept")
    sums = rows.mapInArrow(_divergences, "lang string, source_no int, other_no int, part long")
    sums = materialise(sums.groupBy("lang", "source_no", "other_no").agg(F.sum("part").alias("value")), "pair-sums")
    other = groups.select("lang", F.col("source").alias("item"), F.col("source_no").alias("other_no"))
    pairs = groups.select("lang", "source", "source_no").join(other, "lang").where("source_no <> other_no").join(sums, ["lang", "source_no", "other_no"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = terms.withColumn("rank", rank).where(F.col("rank") <= ranks).unionByName(pairs.withColumn("rank", rank))
    return ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
