"""The word audit of sources against plain counting, and its pointer sort against Python's."""

import collections
import random
import re

import numpy as np
import pyarrow as pa

from corpusloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(rows, ranks):
    groups, docs, count = set(), collections.Counter(), collections.Counter()
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", terms(text)
        groups.add((lang, source))
        docs.update((lang, t) for t in set(found))
        count.update((lang, source, t) for t in found)
    out = []
    for lang, source in groups:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= 3]
        many = {s: {t: count[lang, s, t] for t in kept} for x, s in groups if x == lang}
        whole = {t: sum(m[t] for m in many.values()) for t in kept}
        share = lambda m: {t: 1 + 1000000000 * (m[t] + 1) // (sum(m.values()) + len(kept)) for t in kept}
        p, q = share(many[source]), share(whole)
        pair = [(s, sum((p[t] - o[t]) ** 2 // o[t] for t in kept)) for s, o in ((s, share(m)) for s, m in many.items() if s != source)]
        term = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if many[source][t] and p[t] > q[t]]
        for part, found in (("pair", pair), ("term", sorted(term, key=lambda x: (-x[1], x[0].encode()))[:ranks])):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found)]
    return sorted(out)


def test_pointers_are_sorted():
    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abAé𝔸") for _ in range(r.choice((1, 3, 8, 9, 16, 17, 40, 70)))) for _ in range(200)) for _ in range(20)]
    texts += ["", "abc", "def", "x" * 200, "x" * 200, "x" * 199 + "y", "y-1 z", "12"] + ["q" * 64, "q" * 65, "Q" * 64]
    column = pa.array(["skipped", *texts], pa.string()).slice(1)
    group = np.arange(len(texts)) % 3
    want = collections.Counter()
    docs = collections.Counter()
    for t, g in zip(texts, group):
        want.update((w, int(g)) for w in terms(t))
        docs.update((w, int(g)) for w in set(terms(t)))
    found, own, n, held = divergence.tally(column, group)
    got = list(zip(found.to_pylist(), own.tolist()))
    assert dict(zip(got, n.tolist())) == want and dict(zip(got, held.tolist())) == docs and len(set(got)) == len(got)
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    fold, start, length = divergence.pointers(data, np.array([len(data)]))
    order, run = divergence.sort_pointers(fold, start, length)
    words = [fold[start[p]:start[p] + length[p]].tobytes() for p in order]
    assert words == sorted(words) and all((a == b) == (words[i] == words[i + 1]) for i, (a, b) in enumerate(zip(run, run[1:])))


def test_shares_do_not_overflow():
    for count, whole in ((1, 3), (9 * 10**14, 10**15), (10**15, 10**15), (1, 9 * 10**14)):
        assert divergence.share(np.array([count]), np.array([whole]))[0] == 1 + 10**9 * count // whole


def test_audit(spark, monkeypatch):
    r = random.Random(2)
    vocabulary = ["one", "Two", "three", "été", "ÉTÉ", "x", "averyverylongwordindeed", "averyverylongwordindead", "日本"]
    rows = [(r.choice(("en", "de", None)), r.choice(("a", "b", "", None, "c")), " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 30))), 1) for _ in range(120)]
    rows += [("en", "hot", "one one Two-three 1x", 1)] * 60 + [("fr", "only", "one", 2), ("fr", "empty", "12 ..", 2), ("fr", None, None, 2), ("it", "z", "w w w w", 3), ("en", "big", "y" * 100_000 + " x", 1)]
    df = spark.createDataFrame(rows, "lang string, source string, text string, n int").selectExpr("*", "1 AS term", "2 AS docs").repartition(5)
    for size in (divergence.SLICE_BYTES, 100):  # 100: a slice for each batch
        monkeypatch.setattr(divergence, "SLICE_BYTES", size)
        got = sorted(tuple(x) for x in divergence.audit(df, ranks=5).collect())
        assert got == plain([x[:3] for x in rows], 5)
    assert divergence.audit(df.limit(0)).count() == 0
