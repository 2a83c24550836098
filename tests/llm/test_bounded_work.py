"""Cases in which an operator's work once grew out of proportion, or met in one task."""

import collections
import itertools
import random
import time

from pyspark.sql import functions as F

from corpusloom.llm import language_id, packing, token_counts, topk, url_rules, warc


def test_rules_are_all_sets_of_up_to_three(spark):
    r = random.Random(3)
    rows = []
    for _ in range(120):
        have = {t for t in "abcdefg" if r.random() < 0.5} | {"every"}
        have |= {"twin of b"} if "b" in have else set()
        rows.append((sorted(have), "block" if {"a", "b"} <= have or r.random() < 0.2 else "allow"))
    sets = [(frozenset(t), x) for t, x in rows]
    cover = lambda s: [x for t, x in sets if s <= t]
    want = {}
    for k in (1, 2, 3):
        for s in map(frozenset, itertools.combinations(sorted({t for x, _ in rows for t in x}), k)):
            n = cover(s)
            if any(len(cover(s - {t})) == len(n) for t in s if k > 1):
                continue
            for label, hits in collections.Counter(n).items():
                if hits >= 6 and hits / len(n) >= 0.8:
                    want[tuple(sorted(s)), label] = (hits, round(hits / len(n), 9))
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), min_support=0.05, min_rows=5, min_confidence=0.8).collect()
    assert {(tuple(x.antecedent), x.label): (round(x.support * 120), round(x.confidence, 9)) for x in got} == want and len(got) == len(want)


def test_many_tokens_stay_cheap(spark):
    keys = [f"key:k{k}" for k in range(30)]
    rows = [(sorted([*keys, "scheme:http", f"host:h{i % 40}", f"path:{i % 7}"]), "block") for i in range(400)]
    r = random.Random(4)
    rows += [(sorted(k for k in keys if r.random() < 0.5), "allow") for _ in range(400)]
    start = time.time()
    found = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string")).count()
    assert found > 0 and time.time() - start < 90


def test_rows_of_one_id_are_drawn_apart(spark):
    texts = {"en": "the thing that is there and then", "de": "der dachs und die ente auf dem see"}
    rows = [(11, f"{texts[lang]} {i}", lang) for i in range(3000) for lang in texts] + [(None, f"{texts['en']} {i}", "en") for i in range(3000)]
    rows += [(5, "", "empty"), (6, "dirty", "x" * 5000)] + [(i, "le chat est sur la table", f"rare{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("lang in ('en', 'de', 'empty')"), "doc_id", "text", "lang", sample_per_language=200)
    assert model.languages == ["de", "en"] and all(p.shape[0] > 50 for p in model.prices)
    bits = language_id.code_lengths(model, list(texts.values()))
    assert bits[0].argmin() == 1 and bits[1].argmin() == 0
    assert len(language_id.fit(df, "doc_id", "text", "lang", most_languages=10).languages) == 10
    clash = spark.createDataFrame([(1, "der see", 2, 3, 4, 5)], "id int, text string, letters int, score int, kept0 int, lang_pred int")
    out = language_id.predict(clash, model).collect()[0]
    assert (out.id, out.letters, out.kept0, out.lang_pred) == (1, 2, 4, "de") and 0 < out.score <= 1


def test_equal_rows_are_numbered_by_many_tasks(spark):
    parts = spark.range(4000, numPartitions=4).select(F.lit(None).cast("long").alias("id"), F.lit(7).cast("long").alias("length"), F.col("id").alias("uid"))
    parts = packing.materialise(parts, "test")
    got = packing.assign(parts, 21, rows_per_group=100)
    places = sorted((r.sequence_id, r.offset) for r in got.collect())
    assert len(set(places)) == 4000 and got.columns == ["id", "length", "sequence_id", "offset"] and {o for _, o in places} == {0, 7, 14}
    plan = packing.gapless(parts, "length", "uid", "rank", 100)._jdf.queryExecution().toString()
    assert "loom_group" in plan and plan.count("Window") >= 2  # ranked within groups of a written number, not within a length


def test_long_runs_are_cut_into_little_more_than_themselves():
    import pyarrow as pa

    for overlap in (1024, 1 << 20, 1 << 21):
        text = "x" * (1 << 22)
        batch = pa.RecordBatch.from_pydict({"uid": [1], "overlap": [overlap], "text": [text]})
        chunks = [c for b in token_counts._cut(65_536)(iter([batch])) for c in b.to_pylist()]
        assert sum(len(c["part"]) for c in chunks) <= 2 * len(text)
        assert "".join(c["part"][:(c["next"] or len(text)) - c["start"]] for c in chunks) == text


def test_queries_meet_summaries_in_packed_rows(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(topk, "SHARD", 64)
    monkeypatch.setattr(topk, "PER_PART", 256)
    monkeypatch.setattr(topk, "SUMMARIES", 4)
    monkeypatch.setattr(topk, "ASKED", 50)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in rng.integers(0, 900, 1500)] + [(None, [1.0] * 4)] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(r.vec_id, np.floor(1024 * np.array(r.embedding, float)).astype(np.int64)) for r in df.collect() if r.vec_id is not None]
    m = np.stack([v for _, v in good])
    want = collections.Counter()
    for k, (i, _) in enumerate(good):
        if i % 10 == 0:
            s = m @ m[k]
            want.update((i, n + 1, j, -x) for n, (x, j) in enumerate(sorted((-int(s[o]), good[o][0]) for o in range(len(good)) if o != k)[:10]))
    assert collections.Counter(tuple(r) for r in topk.top_k(df, lambda i: i % 10 == 0).collect()) == want


def test_revisits_ship_no_payload(spark):
    rows = [(i, "u", "same page " * 50) for i in range(300)] + [(1000 + i, "u", f"own {i} " * 40) for i in range(50)] + [(None, "u", "same page " * 50), (7, "u", "own 1 " * 40), (7, "u", "own 1 " * 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collections.Counter((r.record_type, r.refers_to, r.payload is None) for r in warc.to_records(df, "page_id", "url", "html").collect())
    assert got == {("revisit", "urn:row:0", True): 300, ("response", None, False): 49 + 1 + 2, ("revisit", "urn:row:7", True): 1}
