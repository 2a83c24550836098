"""The kept BM25 index: ranges passed over, segments, snapshots; each against the formula over all chunks."""

import math
import random
import re
import threading

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import lexical


def formula(docs, queries, k):
    """docs: [(key, text)]; the k best of each query by rounded score, then key."""
    toks = [(i, re.findall(T.TOKEN, (t or "").lower())) for i, t in docs]
    n, avg = len(docs), sum(len(x) for _, x in toks) / len(docs)
    terms = {t for _, x in toks for t in x}
    df = {t: sum(t in x for _, x in toks) for t in terms}
    raw = {t: math.log(n - df[t] + 0.5) - math.log(df[t] + 0.5) for t in terms}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else floor for t, v in raw.items()}
    out = {}
    for q, text in queries:
        found = []
        for i, x in toks:
            s = sum(idf.get(t, 0) * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t in re.findall(T.TOKEN, text.lower()))
            if s > 0:
                found.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.doc_id, r.score))
    return out


def same(got, want):
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items() if x}
    assert all(abs(a - b) < 2e-6 for q in got for (_, a), (_, b) in zip(got[q], want[q]))


def corpus(r, n, first=0):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs = []
    for i in range(n):
        topic = (i // 64) % 8
        docs.append((first + i, " ".join(r.choice(words[topic * 30:topic * 30 + 40]) if r.random() < 0.8 else "common" for _ in range(r.randint(0, 60)))))
    return docs


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, content string").coalesce(2)


def test_ranges_are_passed_over_exactly(spark, tmp_path):
    r = random.Random(6)
    docs = corpus(r, 1200) + [(5000, None), (5001, "")]
    queries = [(k, " ".join(r.sample([w for _, t in docs if t for w in t.split()][k * 900:k * 900 + 60], 3))) for k in range(12)] + [(90, "common common"), (91, "unknown"), (92, "")]
    q = spark.createDataFrame(queries, "query_id long, query string")
    index = lexical.build_index(frame(spark, docs), ["doc_id"], str(tmp_path / "i"))
    same(found(lexical.search(index, q, 5)), formula(docs, queries, 5))
    assert sum(len(x) for x in formula(docs, queries, 10_000).values()) == lexical.scores(index, q).where("score > 0").count()
    over = lexical.passed_over(index, q, 5).collect()
    assert sum(x.read for x in over) < 0.7 * sum(x.ranges for x in over)
    # only buckets of the query's terms are read, and within them only its terms
    plan = lexical.search(index, q.where("query_id = 90"), 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", plan) and "EqualTo(term,common)" in plan
    # a hot term is dealt to several tasks and files of its bucket
    assert index.blocks.where("term = 'common'").select(F.input_file_name()).distinct().count() > 1


def test_an_index_that_changes(spark, tmp_path):
    r = random.Random(7)
    at = str(tmp_path / "i")
    now = dict(corpus(r, 300))
    queries = [(0, "common"), (1, "waa wba wca"), (2, now[70]), (3, now[299])]
    q = spark.createDataFrame(queries, "query_id long, query string")
    first = lexical.build_index(frame(spark, list(now.items())), ["doc_id"], at)
    before = found(lexical.search(first, q, 8))
    for step in range(3):
        new = dict(corpus(r, 40, first=1000 * step + 280))  # some replace, some are new
        gone = [step * 10 + k for k in range(10)] + [99_999]
        lexical.put(spark, at, frame(spark, list(new.items())), spark.createDataFrame([(k,) for k in gone], "doc_id long"))
        now = {k: v for k, v in (now | new).items() if k not in gone or k in new}
    index = lexical.open_index(spark, at)
    want = formula(list(now.items()), queries, 8)
    assert index.chunks == len(now)
    same(found(lexical.search(index, q, 8)), want)
    fresh = lexical.build_index(frame(spark, list(now.items())), ["doc_id"], str(tmp_path / "fresh"))
    pairs = lambda i: sorted(map(tuple, i.frequencies.select("term", "df", "tokens").collect()))
    assert pairs(index) == pairs(fresh) and abs(index.floor - fresh.floor) < 1e-12 and abs(index.avgdl - fresh.avgdl) < 1e-12
    assert found(lexical.search(first, q, 8)) == before  # whoever has it open keeps it
    merged = lexical.compact(spark, at)
    assert merged.gone is None and pairs(merged) == pairs(fresh)
    same(found(lexical.search(merged, q, 8)), want)
    lexical.put(spark, at, None, spark.createDataFrame([(k,) for k in now], "doc_id int"))
    none = lexical.open_index(spark, at)
    assert none.chunks == 0 and lexical.search(none, q, 8).count() == 0
    assert len(lexical.vacuum(spark, at, keep=1, older_than=0)) >= 1 and lexical.search(lexical.open_index(spark, at), q, 8).count() == 0


def test_writers_of_an_index_at_once(spark, tmp_path):
    at, faults = str(tmp_path / "i"), []
    docs = corpus(random.Random(8), 60)
    lexical.build_index(frame(spark, docs), ["doc_id"], at)

    def work(k):
        try:
            lexical.put(spark, at, frame(spark, [(5, f"only writer{k} has this"), (2000 + k, "common waa")]))
        except Exception as e:
            faults.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    index = lexical.open_index(spark, at)
    assert not faults and index.chunks == 62
    q = spark.createDataFrame([(1, "writer")], "query_id long, query string")
    assert [x.doc_id for x in lexical.search(index, q, 5).collect()] == [5]


def test_scores_are_added_up_where_their_ranges_are(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    docs = corpus(r, 400)
    queries = [(k, docs[k * 50][1] + " common") for k in range(7)]
    q = spark.createDataFrame(queries, "query_id long, query string")
    at = str(tmp_path / "i")
    lexical.build_index(frame(spark, docs), ["doc_id"], at)
    index = lexical.put(spark, at, frame(spark, docs[:100]), spark.createDataFrame([(399,)], "doc_id long"))
    assert index.unique and index.chunks == 399
    plan = lexical.scores(index, q)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((\w+)#\d+L?(?:, (\w+)#)?", plan)
    assert dealt and {a for a, _ in dealt} == {"range"}, dealt  # neither postings nor scores go by query or chunk
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", 3)
    same(found(lexical.search(index, q, 6)), formula(docs[:399], queries, 6))


def test_chunks_that_share_their_keys_in_several_ranges(spark, tmp_path):
    docs = [(k % 150, f"common w{'abc'[k % 3]}a") for k in range(300)]
    index = lexical.build_index(frame(spark, docs), ["doc_id"], str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "waa")], "query_id long, query string")
    assert not index.unique
    every = {x.doc_id: round(x.score, 6) for x in lexical.scores(index, q).collect()}
    assert {i: s for i, s in found(lexical.search(index, q, 20))[1]}.items() <= every.items()


def test_scores_are_added_up_within_tasks(spark, tmp_path):
    """Rows of a posting and a query are many times the index: none leave their range's task."""
    r = random.Random(9)
    docs = [(None if i == 7 else f"d{i // 3}", i % 3, t) for i, t in corpus(r, 900)]
    queries = [(f"q{j}", r.choice(docs)[2] or "common") for j in range(12)] + [("none", "nowhere"), ("twice", "common common waa")]
    frame = spark.createDataFrame(docs, "doc_id string, part int, content string").coalesce(2)
    index = lexical.build_index(frame, ["doc_id", "part"], str(tmp_path / "i"))
    assert index.unique
    out = lexical.search(index, spark.createDataFrame(queries, "query_id string, query string"), 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "inline(" not in plan
    got = {}
    for x in sorted(out.collect(), key=lambda x: x["rank"]):
        got.setdefault(x.query_id, []).append(((x.doc_id or "~", x.part), x.score))
    same(got, formula([((d or "~", p), t) for d, p, t in docs], queries, 5))
