"""Aligning the tokens of two tokenizers, and how common each pair of aligned tokens is.

Two tokens are linked where their byte ranges overlap; the components of links are the groups
between places where tokens of both end. Pointer jumping finds them: every token points to the
token that reaches farthest right among those that overlap it, and successors are doubled, for all
tokens of many words at once, until every token points to the last one of its component.

Texts are cut before a single space or newline between other characters, and between a letter and a
mark, where no token of either tokenizer can reach across; each distinct piece is aligned once by a
worker. A document's
distinct links are kept by blocks of documents: a block has a dictionary of its pairs, and its
documents refer to that by number. Only the dictionaries meet the corpus-wide counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import column_type, materialise, slices, small_batches, text_or_empty

#: Pieces that a worker remembers, at about 300 bytes each; longer ones than LONG aren't remembered.
MEMO_ENTRIES, LONG = 250_000, 64
#: Bytes of text of a block (or one longer document), and bytes and rows whose words are held at once.
BLOCK_BYTES, _BYTES, _BATCH = 12 << 20, 1 << 20, 512
#: Longer documents are aligned by parts of about so many characters.
PART_CHARS = 1 << 18
#: Before a space or newline between other characters, and between a Latin letter and a mark.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[.,;:!?])")
_ACROSS = re.compile(r"[^▁]▁|\n|[A-Za-zÀ-ÖØ-öø-ɏ][.,;:!?]")


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens A and B that cover the same bytes, with these ends: the last B token of each one's component."""
    a = len(a_end)
    after_a, after_b = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
    # the farthest-right token that overlaps: of A's the B token over its last byte, of B's the A token there, if it reaches on
    own = np.arange(a, a + len(b_end))
    to = np.concatenate([a + after_a, np.where(a_end[np.minimum(after_b, max(a - 1, 0))] > b_end, after_b, own) if a else own])
    while True:
        further = to[to]
        if (further == to).all():
            return to[:a] - a, to[a:] - a
        to = further


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (A token, B token) whose byte ranges overlap."""
    start = np.concatenate([[0], a_end[:-1]]) if len(a_end) else a_end
    low, high = np.searchsorted(b_end, start, "right"), np.searchsorted(b_end, a_end)
    many = high - low + 1
    left = np.repeat(np.arange(len(a_end)), many)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + low[left]


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Aligner:
    """Alignments of pieces of text under a byte-level ``tokenizers`` file (A) and a ``sentencepiece`` model (B)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.a.no_truncation()
        self.a.no_padding()
        spec, of = json.loads(self.a.to_str()), byte_characters()
        self.a_bytes = [b""] * (max(self.a.get_vocab(True).values()) + 1)
        for entry, k in self.a.get_vocab(True).items():
            self.a_bytes[k] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        pre = spec.get("pre_tokenizer") or {}
        #: At a cut a token of A begins, and no piece of B reaches across one.
        self.cuts = (
            pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space") and not spec.get("normalizer")
            and not any(map(_ACROSS.search, pieces))
        )
        self.a_size, self.b_size = (np.array([len(x) for x in own]) for own in (self.a_bytes, self.b_bytes))
        # what is known of pieces, by number: counts (tokens A and B, groups, links; -1 where the bytes differ), the groups' text, links
        self.memo: dict[str, int] = {}
        self.counts, self.said = np.zeros((1 << 12, 4), np.int32), []
        self.links, self.at = np.zeros(1 << 14, np.int64), np.zeros((1 << 12) + 1, np.int64)

    def pieces(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def parts(self, text: str) -> Iterator[str]:
        """A long text by parts, cut as its pieces are."""
        at = 0
        while self.cuts and len(text) - at > PART_CHARS and (m := _CUT.search(text, at + PART_CHARS)):
            yield text[at:m.end()]
            at = m.end()
        yield text[at:]

    def learn(self, pieces: list[str]) -> list[str]:
        """Aligns the pieces that aren't known; returns those that are to be forgotten again."""
        new = [p for p in pieces if p not in self.memo]
        new.sort(key=lambda p: len(p) > LONG)
        first = len(self.said)
        for a in range(0, len(new), 20_000):
            self._add(new[a:a + 20_000])
        self.memo.update(zip(new, range(first, first + len(new))))
        stay = max(0, min(MEMO_ENTRIES - first, sum(len(p) <= LONG for p in new)))
        return new[stay:]

    def forget(self, pieces: list[str]) -> None:
        for p in pieces:
            del self.memo[p]
        del self.said[len(self.memo):]

    def _add(self, pieces: list[str]) -> None:
        counts, said, links, many = self._aligned(pieces)
        have, more = len(self.said), len(self.said) + len(pieces)
        while more > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.at = np.concatenate([self.at, np.zeros(len(self.counts) + 1 - len(self.at), np.int64)])
        self.counts[have:more] = counts
        self.at[have + 1:more + 1] = self.at[have] + np.cumsum(many)
        while self.at[more] > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.links[self.at[have]:self.at[more]] = links
        self.said += said

    def _aligned(self, pieces: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of pieces the counts, the groups' text, all links in a row, and how many each has."""
        a_ids = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        # B puts a space before a text; where the piece has none, a newline, which joins nothing, takes it
        inner = [p[0] != " " for p in pieces]
        b_ids = self.b.encode(["\n" + p if i else p[1:] for p, i in zip(pieces, inner)], num_threads=1)
        b_ids = [x[2:] if i else x for x, i in zip(b_ids, inner)]
        want = [p.encode() for p in pieces]
        flat = lambda ids: np.fromiter(chain.from_iterable(ids), np.int64)
        starts = lambda ids: np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        a_all, b_all, a_at, b_at = flat(a_ids), flat(b_ids), starts(a_ids), starts(b_ids)
        if not self._covers(want, a_all, b_all, a_at, b_at):
            good = [b"".join([self.a_bytes[x] for x in i]) == w == b"".join([self.b_bytes[x] for x in j]) for w, i, j in zip(want, a_ids, b_ids)]
            if not any(good):
                return np.full((len(pieces), 4), -1), [""] * len(pieces), np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
            at = np.flatnonzero(good)
            some, text, links, own = self._grouped([a_ids[k] for k in at], [b_ids[k] for k in at])
            counts, many, said = np.full((len(pieces), 4), -1), np.zeros(len(pieces), np.int64), [""] * len(pieces)
            counts[at], many[at] = some, own
            for k, t in zip(at.tolist(), text):
                said[k] = t
            return counts, said, links, many
        return self._grouped(a_ids, b_ids)

    def _covers(self, want: list[bytes], a_all: np.ndarray, b_all: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> bool:
        """Whether the tokens' bytes make up all pieces, each its own."""
        ends, whole = np.cumsum(np.fromiter(map(len, want), np.int64, len(want))), b"".join(want)
        for ids, at, size, of in ((a_all, a_at, self.a_size, self.a_bytes), (b_all, b_at, self.b_size, self.b_bytes)):
            reached = np.concatenate([[0], np.cumsum(size[ids])])[at[1:]]
            if (reached != ends).any() or b"".join(map(of.__getitem__, ids.tolist())) != whole:
                return False
        return True

    def _grouped(self, a_ids: list[list[int]], b_ids: list[list[int]]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        a_all, b_all = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a_ids, b_ids))
        a_at, b_at = (np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]) for ids in (a_ids, b_ids))
        # all pieces in a row: their ends are ends of both tokenizers
        a_end, b_end = np.cumsum(self.a_size[a_all]), np.cumsum(self.b_size[b_all])
        a_last, b_last = terminals(a_end, b_end)
        left, right = overlaps(a_end, b_end)
        a_text, b_text = list(map(str, a_all.tolist())), list(map(str, b_all.tolist()))
        a_cut = np.flatnonzero(np.diff(a_last, append=-1)) + 1
        b_cut = np.flatnonzero(np.diff(b_last, append=-1)) + 1
        spans = zip([0, *a_cut[:-1].tolist()], a_cut.tolist(), [0, *b_cut[:-1].tolist()], b_cut.tolist())
        groups = [a_text[i] + "|" + b_text[k] if j - i == m - k == 1 else ",".join(a_text[i:j]) + "|" + ",".join(b_text[k:m]) for i, j, k, m in spans]
        g_at, l_at = np.searchsorted(a_cut, a_at, "right"), np.searchsorted(left, a_at)
        edges = g_at.tolist()
        said = [groups[i] if j - i == 1 else ";".join(groups[i:j]) for i, j in zip(edges, edges[1:])]
        many = np.diff(l_at)
        return np.stack([np.diff(a_at), np.diff(b_at), np.diff(g_at), many], axis=1), said, (a_all[left] << 32) | b_all[right], many

    def measure(self, texts: list[str], hashes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bool]]:
        """Of texts (each with the space before it) the four counts, and their distinct links: text, link, times; whether each is whole.

        The groups' texts go on into ``hashes``.
        """
        cut = [self.pieces(t) for t in texts]
        words = list(chain.from_iterable(cut))
        distinct = list(set(words))
        again = self.learn(distinct)
        known = np.fromiter(map(self.memo.__getitem__, distinct), np.int64, len(distinct))
        number = dict(zip(distinct, range(len(distinct))))
        piece = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        first = np.cumsum([0, *map(len, cut)])
        own = self.counts[known].astype(np.int64)
        whole = ~np.logical_or.reduceat(own[piece, 0] < 0, first[:-1])
        counts = np.add.reduceat(np.maximum(own, 0)[piece], first[:-1], axis=0)
        said = list(map(self.said.__getitem__, known.tolist()))
        for k, h in enumerate(hashes):
            if whole[k]:
                h.update((";" * h.begun + ";".join(map(said.__getitem__, piece[first[k]:first[k + 1]].tolist()))).encode())
                h.begun = True
        place = np.repeat(np.arange(len(cut)), np.diff(first)) * len(distinct) + piece
        place, times = np.unique(place, return_counts=True)
        doc, piece = np.divmod(place, len(distinct))
        # links of the distinct pieces in a row, each by its number among the different ones
        size = self.at[known + 1] - self.at[known]
        at = np.cumsum(size) - size
        pool, link = np.unique(self.links[np.arange(size.sum()) - np.repeat(at - self.at[known], size)], return_inverse=True)
        many = size[piece]
        take = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(at[piece], many)
        self.forget(again)
        return counts, *_distinct(np.repeat(doc, many), link[take], np.repeat(times, many), pool), whole.tolist()


class _Hash:
    def __init__(self):
        self.of, self.begun = hashlib.sha256(), False
        self.update = self.of.update


def _distinct(doc: np.ndarray, link: np.ndarray, times: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adds up equal (doc, link); links are numbers in ``pool``, which is sorted."""
    if not len(doc):
        return doc, link, times
    place = doc * len(pool) + link
    order = np.argsort(place)
    place = place[order]
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[cut] // len(pool), pool[place[cut] % len(pool)], np.add.reduceat(times[order], cut)


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process, so that what it remembers serves all its tasks."""
    return Aligner(a_path, b_path)


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, by planes of bytes, of which the higher ones are nearly all zero."""
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) if len(numbers) else b""


def _unsqueezed(data: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * count, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Block:
    """Documents whose links share a dictionary."""

    def __init__(self):
        self.ids, self.counts, self.sha, self.doc, self.link, self.times, self.bytes = [], [], [], [], [], [], 0

    def add(self, ids: pa.Array, counts: np.ndarray, sha: list[str], doc: np.ndarray, link: np.ndarray, times: np.ndarray, size: int) -> None:
        self.doc.append(doc + sum(map(len, self.ids)))
        for into, x in zip((self.ids, self.counts, self.sha, self.link, self.times), (ids, counts, sha, link, times)):
            into.append(x)
        self.bytes += size

    def row(self, number: int) -> pa.RecordBatch:
        ids, counts, doc = pa.concat_arrays(self.ids), np.concatenate(self.counts), np.concatenate(self.doc)
        pairs, code = np.unique(np.concatenate(self.link), return_inverse=True)
        many = np.bincount(doc, minlength=len(ids))
        step = np.diff(code, prepend=0)
        start = (np.cumsum(many) - many)[many > 0]
        step[start] = code[start]
        one = lambda x, kind=None: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), one(ids), *(one(counts[:, c], pa.int64()) for c in range(4)), one(list(chain.from_iterable(self.sha)), pa.string()), one(many, pa.int64()),
             pa.array([_squeezed(step)], pa.binary()), pa.array([_squeezed(np.concatenate(self.times))], pa.binary()), one(pairs, pa.int64()), one(np.bincount(code, minlength=len(pairs)), pa.int64())],
            ["block", "ids", "n_a", "n_b", "n_groups", "n_links", "sha", "many", "steps", "times", "pairs", "docs"],
        )


def _blocks(a_path: str, b_path: str):
    def long(work: Aligner, text: str) -> tuple:
        """A long text by parts; its links are added up at the end."""
        h, counts, links, times = _Hash(), np.zeros(4, np.int64), [], []
        for part in work.parts(text):
            c, _, link, n, whole = work.measure([part], [h])
            if not whole[0]:
                return _Hash(), np.zeros(4, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), False
            counts += c[0]
            links.append(link)
            times.append(n)
        pool, link = np.unique(np.concatenate(links), return_inverse=True)
        return h, counts, *_distinct(np.zeros(len(link), np.int64), link, np.concatenate(times), pool)[1:], True

    def entire(work: Aligner, text: str) -> tuple:
        """A text of which some piece's bytes differ, looked at uncut."""
        counts, said, links, _ = work._aligned([text])
        h = _Hash()
        if counts[0, 0] < 0:
            return h, np.zeros(4, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), False
        h.update(said[0].encode())
        h.begun = True
        return h, counts[0], *np.unique(links, return_counts=True), True

    def aligned(work: Aligner, texts: list[str]) -> tuple:
        """(counts, sha, doc, link, times) of a slice of texts."""
        hashes, counts = [_Hash() for _ in texts], np.zeros((len(texts), 4), np.int64)
        usual = [k for k, t in enumerate(texts) if 0 < len(t) <= PART_CHARS]
        docs, links, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        own = {}
        if usual:
            c, doc, link, n, whole = work.measure([" " + texts[k] for k in usual], [hashes[k] for k in usual])
            good = np.array(whole)
            keep = good[doc]
            at = np.array(usual)
            counts[at[good]] = c[good]
            docs, links, times = [at[doc[keep]]], [link[keep]], [n[keep]]
            own = {k: entire(work, " " + texts[k]) for k, w in zip(usual, whole) if not w}
        for k in (k for k, t in enumerate(texts) if len(t) > PART_CHARS):
            found = long(work, " " + texts[k])
            own[k] = found if found[-1] else entire(work, " " + texts[k])
        for k, (h, c, link, n, _) in own.items():
            hashes[k], counts[k] = h, c
            docs.append(np.full(len(link), k))
            links.append(link)
            times.append(n)
        doc, link, n = np.concatenate(docs), np.concatenate(links), np.concatenate(times)
        order = np.lexsort((link, doc)) if own else slice(None)
        return counts, [h.of.hexdigest() if h.begun else "" for h in hashes], doc[order], link[order], n[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, first, seen, block = aligner(a_path, b_path), TaskContext.get().partitionId() << 32, 0, _Block()
        for batch in batches:
            for part in slices(batch, "text", _BYTES, _BATCH):
                block.add(part.column("id"), *aligned(work, part.column("text").to_pylist()), part.nbytes)
                if block.bytes >= BLOCK_BYTES:
                    yield block.row(first + seen)
                    seen, block = seen + 1, _Block()
        if block.ids:
            yield block.row(first + seen)

    return run


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _summed(id_type: pa.DataType):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block and what the corpus says of its pairs -> a row for each of its documents."""
        ids, flat = left.column("ids").combine_chunks().flatten(), lambda c: left.column(c).combine_chunks().flatten()
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        at = right.column("no").to_numpy()
        count[at], best[at] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        many = flat("many").to_numpy()
        step, times = (_unsqueezed(left.column(c)[0].as_py(), int(many.sum())) for c in ("steps", "times"))
        start = np.cumsum(many) - many
        code = np.cumsum(step)
        code -= np.repeat(code[np.minimum(start, max(len(code) - 1, 0))] - step[np.minimum(start, max(len(code) - 1, 0))], many) if len(code) else code
        doc = np.repeat(np.arange(len(ids)), many)
        add = lambda x: np.add.reduceat(np.append(x, 0), np.minimum(start, len(x))) * (many > 0)
        assert len(doc) == len(code)
        out = [ids.cast(id_type), *(flat(c) for c in _COUNTS), pa.array(add(times * best[code])), pa.array(add(times * count[code])), flat("sha")]
        return pa.table(out, ["id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    return run


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align the tokens of each text's two tokenizations, A's of a space and the text, B's of the text.

    Returns one row per input row: the id column, ``n_a``, ``n_b`` (tokens), ``n_groups``,
    ``n_links``, ``n_best`` (links whose pair is in as many documents as any pair of its A token),
    ``count_sum`` (documents with the pair, over links), ``groups_sha256`` (of the groups written
    as ``a1,a2|b1;a3|b2,b3``). Null and empty texts, and those whose tokens' bytes don't make up
    the text, have no tokens: zeros and an empty string. Repeated rows are documents of their own,
    an id may be null. An empty table gives an empty result. Other columns, whatever their names,
    play no part.
    """
    spark = df.sparkSession
    small_batches(spark)
    kind = column_type(df, id_col)
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    lists = ", ".join(f"{c} array<long>" for c in _COUNTS)
    rows = docs.mapInArrow(_blocks(a_path, b_path), f"block long, ids array<{kind}>, {lists}, sha array<string>, many array<long>, steps binary, times binary, pairs array<long>, docs array<long>")
    rows = materialise(rows, "aligned")
    pairs = rows.select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("pairs", "docs")).alias("no", "p")).select("of", "no", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", 32))
    counts = materialise(counts, "pair-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    known = counts.join(most.hint("merge"), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    back = pairs.select("of", "no", "pair").join(known.hint("merge"), "pair").select("of", "no", "count", "best")
    left = rows.drop("pairs", "docs").groupBy("block").cogroup(back.groupBy("of"))
    found = left.applyInArrow(_summed(to_arrow_type(df.schema[id_col].dataType)), f"id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, n_best long, count_sum long, groups_sha256 string")
    return found.withColumnRenamed("id", id_col)
