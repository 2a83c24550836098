"""Alignment of two tokenizers against the definition, token by token."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers

from corpusloom.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [None, "", " ", "\n", "x▁y", "a  b ", " lead", "\nline", "tab\tand\r\nmore", "<|endoftext|> <s></s> <0x41>", "ﬁne é𝔸", "dé\x1cz don't\n\nsave\n1234567 ::", "x" * 900 + "  y", "a  b　c", "word\nword two\nthree", "￿ \x85 z"]


def plain(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of = alignment.byte_characters()
    docs, held = [], collections.Counter()
    for i, t in rows:
        text = " " + (t or "")
        x = [(k, bytes(of[c] for c in a.id_to_token(k))) for k in a.encode(text, add_special_tokens=False).ids] if t else []
        y = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(t)] if t else []
        if not t or any(b"".join(v for _, v in z) != text.encode() for z in (x, y)):
            x = y = []
        spans = []
        for z in (x, y):
            at, own = 0, []
            for k, v in z:
                own.append((k, at, at + len(v)))
                at += len(v)
            spans.append(own)
        links = [(p, q) for p, s, e in spans[0] for q, u, w in spans[1] if s < w and u < e]
        groups, both = [], sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        for low, high in zip([0, *both], both):
            groups.append("|".join(",".join(str(k) for k, s, _ in z if low <= s < high) for z in spans))
        held.update(set(links))
        docs.append((i, len(x), len(y), groups, links))
    most = collections.Counter()
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    return collections.Counter(
        (i, x, y, len(g), len(ls), sum(held[k] == most[k[0]] for k in ls), sum(held[k] for k in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, x, y, g, ls in docs
    )


def test_pointer_jumping_finds_the_components():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(0, 60)
        a, b = (np.array(sorted({*r.sample(range(1, n), r.randint(0, n - 1)), n}) if n else [], np.int64) for _ in range(2))
        a_last, b_last = alignment.terminals(a, b)
        shared = np.array(sorted(set(a.tolist()) & set(b.tolist())), np.int64)
        for ends, last in ((a, a_last), (b, b_last)):
            assert (b[last] == shared[np.searchsorted(shared, ends)]).all() if n else not len(last)
        left, right = alignment.overlaps(a, b)
        spans = [[(s, e) for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())] for ends in (a, b)]
        assert list(zip(left.tolist(), right.tolist())) == [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, w) in enumerate(spans[1]) if s < w and u < e]


def test_alignment_of_a_table(spark, monkeypatch):
    r = random.Random(2)
    words = ["straße", "naïve", "don't", "tokenization", "12,5", "été.", "xx", "Q", "the", "日本語", "undiscoverable"]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "same text")] * 3 + [(7, "same text")]
    rows += [(100 + i, "".join(r.choice(words) + r.choice((" ", " ", " ", "\n", "  ")) for _ in range(r.randint(1, 60)))) for i in range(60)]
    rows.append((999, " ".join(r.choice(words) for _ in range(3000))))
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, block long").selectExpr("*", "1 AS n_a", "2 AS id").repartition(3)
    want = plain(rows)
    for block, part in ((1 << 24, 1 << 18), (2000, 500)):  # blocks of a few documents, long texts by parts: workers are forked with these
        monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
        monkeypatch.setattr(alignment, "PART_CHARS", part)
        work = alignment.Aligner(A, B)
        assert work.cuts and "".join(work.parts(rows[-1][1])) == rows[-1][1]
        got = collections.Counter(tuple(x) for x in alignment.align(df, A, B).collect())
        assert got == want
    assert alignment.align(df.limit(0), A, B).count() == 0


def test_blocks_and_parts_change_nothing():
    """In this process, where small blocks and parts are certain to take effect."""
    import pyarrow as pa

    texts = [t for t in ODD if t] + ["some words " * 300, "no_space" * 200]
    outs = []
    for part in (1 << 18, 100):
        old, alignment.PART_CHARS = alignment.PART_CHARS, part
        try:
            work = alignment.Aligner(A, B)
            found = []
            for t in texts:
                rows = [work.measure([p], [alignment._Hash()]) for p in work.parts(" " + t)]
                found.append((sum(x[0] for x in rows).tolist(), [all(x[-1]) for x in rows].count(False) > 0))
            outs.append(found)
        finally:
            alignment.PART_CHARS = old
    assert outs[0] == outs[1]
    x = np.array([0, 5, 300, 70_000, 4_000_000_000])
    assert (alignment._unsqueezed(alignment._squeezed(x), 5) == x).all() and pa is not None
