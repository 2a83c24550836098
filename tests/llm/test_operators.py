"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import xxhash

from corpusloom.llm import exact_dedup, language_id, memo, mixing, packing, simhash, site_style, token_counts, topk, url_rules, warc
from corpusloom.llm._common import possibly

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "a <|endoftext|>b, x<|endoftext|> é.  é,  x y \x1cz don't. it'save\n\nA b \n c\td ́e 12.5 I'll."


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_memo_is_the_library():
    texts = [ODD, "", " ", "\n", "plain words, here. And more;\nline two", "ß.\n.\n, x", "word" * 50]
    for cls, name in ((memo.Counter, "word_bpe_49k.json"), (memo.Encoder, "byte_bpe_50k.json")):
        path = public_tokenizers.path(name)
        want = [e.ids for e in memo.load(path).encode_batch(texts, add_special_tokens=False)]
        own = cls(path)
        for _ in range(2):
            if cls is memo.Counter:
                assert own.count(texts) == list(map(len, want))
            else:
                assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want


def test_token_counts_splice(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x" * 3000 + "é" * 300, "c"), (3, "ab cd " * 400 + "z" * 2500 + " q" * 300, "d"), (None, ODD, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_counts.token_counts(df, path, limit=100, chunk_chars=700, overlap_chars=8).collect()
    want = [(i, len((t or "").encode()), len(memo.load(path).encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str) and all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.token_counts(df.limit(0), path).count() == 0


def test_language_id(spark):
    rng = random.Random(1)
    make = lambda syll: " ".join("".join(rng.choice(syll) for _ in range(rng.randint(1, 4))) for _ in range(40))
    rows = [(i, make(["th", "er", "ing", "on"]) if i % 2 else make(["ö", "sch", "ung", "ei"]), "en" if i % 2 else "de") for i in range(400)]
    df = spark.createDataFrame([*rows, (None, "theron", None), (900, None, "en"), (901, "12 ...", "de")], "doc_id long, text string, lang string")
    got = language_id.identify(df).collect()
    want = {i: lang for i, _, lang in rows}
    assert all(r.lang_pred == want[r.doc_id] and 0 <= r.score <= 1 for r in got if r.doc_id in want and r.held_out)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (900, 901)} == {900: ("und", 0.0), 901: ("und", 0.0)}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    m = language_id.fit(df, "doc_id", "text", "lang")
    b, size = [0, 0, 0, *(int(m.symbol[c]) for c in rows[0][1].encode())], m.prices[0].shape[1]
    slow = [sum(float(m.prices[k][m.rows[k, m.node[(b[i] * size + b[i + 1]) * size + b[i + 2]]], b[i + 3]]) for i in range(len(b) - 3)) for k in range(2)]
    assert np.allclose(language_id.code_lengths(m, ["x", rows[0][1], ""])[1], slow)
    assert language_id.identify(df.limit(0)).count() == 0


def test_mixing(spark):
    rows = [(1, None, "a b", 1), (1, None, "a b", 1), (None, "z", "x " * 50, 1), (4, "y", None, 2), *((100 + i, "big", "w " * (i % 9 + 1), 0) for i in range(600)), *((1000 + i, "c", "w " * (i % 9 + 1), 0) for i in range(600))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    got = mixing.mix(df, fan=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df, fan=4).collect())) and len(got) == len(rows)
    size = collections.Counter()
    for _, s, t, _ in rows:
        size[s] += len(WORDS.findall(t or ""))
    weight = {"big": 1, "c": 2, "y": 3, "z": 1, None: 2}
    free, left, target = set(weight), float(sum(size.values())), {}
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * size[s]]:
        for s in over:
            target[s] = 3.0 * size[s]
        left -= sum(target[s] for s in over)
        free -= set(over)
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    taken = collections.Counter()
    source = {r[0]: r[1] for r in rows}
    for r in got:
        assert math.isclose(r.target, target[source[r.doc_id]]) and r.source_size == size[source[r.doc_id]] and r.taken in range(0, 3 * r.size + 1)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(0.03 * target[s], 1) for s in ("big", "c", "z"))
    assert mixing.mix(df.limit(0)).count() == 0


def test_packing(spark):
    rng = random.Random(2)
    for _ in range(200):
        items = collections.Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 60)))
        packed = packing.plan(dict(items), 30)
        used = collections.Counter()
        for lengths, times in packed:
            assert sum(lengths) <= 30 and times > 0
            for n in lengths:
                used[n] += times
        assert used == items
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, None, 1), (1, "", 2), (None, "x " * 3000, 3), (None, "x " * 3000, 3), (5, ODD, 1)] + [(10 + i, "some words " * i, 0) for i in range(60)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length int"), path).collect()
    want = collections.Counter()
    for i, t, _ in rows:
        ids = memo.load(path).encode(t or "", add_special_tokens=False).ids + [2]
        first, at = (len(ids) - 1) % 1024 + 1, 0
        for no, stop in enumerate(range(first, len(ids) + 1, 1024)):
            want[i, no, at, stop - at, zlib.crc32(np.array(ids[at:stop], "<u4").tobytes())] += 1
            at = stop
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_exact_dedup(spark):
    rows = [(1, None, 1), (1, "", 2), (None, "x" * 200000, 3), (None, "X" * 200000, 3), (5, "É", 1), (6, "é", 1), (7, "x" * 200000, 3), (8, "x" * 100000 + "y" + "x" * 99999, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[low(t)].append(i)
    want = sorted(((i, max((x for x in groups[low(t)] if x is not None), default=None), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t, _ in rows), key=str)
    for huge in (1000, 1 << 22):
        got = exact_dedup.dedup_groups(df, huge_bytes=huge, per_copy=2).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want and sum(r.kept for r in got) == len(groups)
    a, b = b"ab" * 40000, b"c" * 10
    joined = tuple(exact_dedup.combine(x, y, len(b), base, p) for x, y, base, p in zip(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b), exact_dedup.BASES, exact_dedup.PRIMES))
    assert exact_dedup.fingerprint(a + b) == joined


def test_simhash(spark):
    rng = np.random.default_rng(0)
    for bits, radius in ((64, 2), (64, 0), (512, 92), (128, 20)):
        fps = np.repeat(rng.integers(0, 256, (30, bits // 8), dtype=np.uint8), 5, 0)
        for row in fps:
            row[rng.integers(bits // 8)] ^= np.uint8(1 << rng.integers(8))
        away = np.unpackbits(fps[:, None] ^ fps[None], axis=2).sum(2)
        assert (simhash.near_lanes(fps, fps, radius) == (away <= radius)).all()
    r = random.Random(3)
    base = [f"w{r.randrange(50)}" for _ in range(400)]
    rows = []
    for i in range(200):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(400)] = f"w{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "Aa b"), (1004, "aA  b")]
    prints = {}
    for i, t in rows:
        w = WORDS.findall(low(t))
        sh = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        hs = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in sh]
        prints[i] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in prints:
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(df).collect()
    assert {x.doc_id: (x.fingerprint, x.component_id) for x in got} == {i: (f"{v:016x}", find(i)) for i, v in prints.items()}


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(700)] + [(700, None, 1), (701, [float("nan")] * 8, 1), (702, [None] * 8, 1), (703, [1.0], 2), (800, [1.0] * 8, 2), (801, [1.0] * 8, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    good = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in df.collect() if r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)]
    m = np.zeros((len(good), 8), np.int64)
    for k, (_, v) in enumerate(good):
        m[k, :len(v)] = v
    want = set()
    for k, (i, _) in enumerate(good):
        if i % 100 == 0:
            s = m @ m[k]
            want |= {(i, r + 1, j, -x) for r, (x, j) in enumerate(sorted((-int(s[o]), good[o][0]) for o in range(len(good)) if o != k)[:10])}
    old, topk.PER_PART = topk.PER_PART, 200
    try:
        assert {tuple(r) for r in topk.top_k(df, lambda i: i % 100 == 0).collect()} == want
    finally:
        topk.PER_PART = old
    assert topk.top_k(df.limit(0), lambda i: i % 100 == 0).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a", None, 1), (2, None, "", 1), (3, "http://b/\r\nX: y", "é" * 80, 1), (4, "u", "é" * 80, 2), (5, "u", "WARC/1.1\r\n\r\n" * 30, 2), (6, "u", "WARC/1.1\r\n\r\n" * 30, 2), (7, "u", "x\r\n\r\n", 1), (8, "u", "y" * 300000, 0), (9, "u", "x\r\n\r\n", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, date int")
    by = collections.defaultdict(list)
    for i, _, h, _ in rows:
        by[(h or "").encode()].append(i)
    want = set()
    for i, _, h, _ in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and min(by[b]) != i
        want.add((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", min(by[b]) if again else None))
    assert {tuple(r) for r in warc.archived(df).collect()} == want and warc.archived(df.limit(0)).count() == 0
    path = warc.scratch_path(spark, "t")
    warc.archive(df, path)
    assert {r.record_id for r in spark.read.format("warc").load(path).where("record_type = 'revisit'").collect()} == {"urn:row:4", "urn:row:6"}


def test_url_rules(spark):
    rows = [(1, None, 1), (2, "nothing", 1), (3, "http://EXAMPLE.net/en/x", 1), (4, "http://a.example.net?x", 1), (5, "http://net/q#z", 1), (None, "http://org/fr/", 1), (7, "http://notnet/", 1)]
    rows += [(100 + i, f"http://h{i % 3}.net/buy/{i}", 1) for i in range(60)] + [(200 + i, f"http://s{i}.com/buy/{i}", 1) for i in range(5)] + [(300 + i, f"http://x{i}.org/fr/{i}", 1) for i in range(40)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string, host int")).collect()}
    assert got[3] == ("example.net", "/en/x", "example.net/en/", "allow") and got[4] == ("a.example.net", "", None, got[4][3]) and got[5] == ("net", "/q", "net/", "block")
    assert got[1] == got[2] == ("", "", None, "allow") and got[7][2] is None and got[None][2:] == ("org/fr/", "allow")
    assert all(got[200 + i][2:] == (None, "block") for i in range(5))  # mined: path:buy implies block


def test_main_text(spark):
    page = '<body><nav>menu</nav><div class="ad">x</div><article><h1>T&amp;t</h1><p>One<b>x</b> two<p>Three<br>five<div class="comments">c</div><aside>s</aside></article><footer>f</footer><script>var a="</p>";</script>'
    bare = "<body><ul class='links'><li>Home</ul><p>Text number {}</p>"
    rows = [(1, "http://a/1", page, 1), (2, None, None, 2), (2, "http://a/2", "", 2)] + [(10 + i, "http://b/x", bare.format(i), 0) for i in range(8)]
    got = collections.defaultdict(list)
    for r in site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect():
        got[r.page_id].append((r.text, r.n_chars))
    text = "T&t\n\nOnex two\n\nThree five"
    assert got[1] == [(text, len(text))] and got[2] == [("", 0)] * 2
    assert all(got[10 + i][0][0] == f"Text number {i}" for i in range(8))  # the menu repeats on every page


def test_prefilter_loses_nothing(spark):
    maybe, rest = possibly(spark.range(20000), spark.range(0, 20000, 100), ["id"])
    assert maybe.count() + rest.count() == 20000 and rest.join(spark.range(0, 20000, 100), "id").count() == 0 and maybe.count() < 400


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(5)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300))
    base = [text() for _ in range(40)]
    near = base[0].split()
    near[150] = "changed"
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)] + [(100, base[0].upper(), "en", "s1", 1), (101, " ".join(near), "en", "s1", 1), (102, None, None, None, None), (103, "123", "en", "s1", 3), (None, base[5], "en", None, 1), (7, base[7], "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    ids = lambda name: sorted((x.doc_id for x in kept[name]), key=str)
    assert ids("language_id") == sorted((x[0] for x in rows if x[0] not in (102, 103)), key=str)
    assert ids("exact_dedup") == sorted([*range(1, 40), 100, 101], key=str)
    assert ids("near_dedup") == sorted([*range(1, 40), 100], key=str)
    assert set(ids("mix_sources")) <= set(ids("near_dedup")) and docs.columns[0] == "doc_id"
    assert corpus_pipeline.ORACLE_SQL is None


def test_words_encoded_as_lines_are_the_librarys(monkeypatch):
    r = random.Random(12)
    monkeypatch.setattr(memo, "_AT_ONCE", 7)
    monkeypatch.setattr(memo, "MEMO_ENTRIES", 60)
    monkeypatch.setattr(memo, "FREE", 20)
    own = memo.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    alphabet = ["a", "Be", "'s", "1", ".", "é", "𝔸", "<|endoftext|>", "\x1c", "\xa0", "日"]
    for _ in range(8):
        texts = [" ".join("".join(r.choice(alphabet) for _ in range(r.randint(1, 6))) + r.choice(("", "", ",", "\n", "\n\n")) for _ in range(r.randint(1, 40))) for _ in range(30)]
        want = [e.ids for e in own.t.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
    assert len(own.memo) == 60
