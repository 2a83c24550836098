"""The approximate index against exact search."""

import numpy as np
import pytest

from corpusloom.operators import ann, dense


def exact(rows, queries, k):
    out = {}
    for i, q in queries:
        scores = sorted(((-round(float(np.dot(v, q) / (np.linalg.norm(v) * np.linalg.norm(q))), 6), key) for key, v in rows), key=lambda x: x)
        out[i] = [key for _, key in scores[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], "doc_id long, embedding array<float>").repartition(4)


@pytest.mark.parametrize("clustered", (True, False))
def test_recall(spark, tmp_path, clustered):
    r = np.random.default_rng(5)
    middle = r.normal(size=(40, 16)) * 4
    rows = [(i, (middle[i % 40] if clustered else 0) + r.normal(size=16)) for i in range(4000)]
    asked = [(i, (middle[i % 40] if clustered else 0) + r.normal(size=16)) for i in range(60)]
    index = ann.build(frame(spark, rows), ["doc_id"], str(tmp_path / "index"), k=10)
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in asked], "query_id long, q array<float>")
    got = ann.search(ann.open_index(spark, str(tmp_path / "index")), q, 10).collect()
    want = exact(rows, asked, 10)
    hits = sum(x.doc_id in want[x.query_id] for x in got)
    assert len(got) == 600 and hits >= 0.95 * 600
    read = ann.reads(index, q).collect()
    share = sum(x.read for x in read) / sum(x.vectors for x in read)
    assert len(read) == 60 and (share < 0.25 if clustered else share <= 1)  # isotropic vectors have no near cells to speak of
    # all cells, and all candidates: exact
    every = ann.search(index, q, 10, probes=10_000, rescore=20).collect()
    assert {x.query_id: [y.doc_id for y in sorted(every, key=lambda y: y.rank) if y.query_id == x.query_id] for x in every} == want
    plan = ann.search(index, q.limit(1), 10, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [1.0, 1.0])]
    df = spark.createDataFrame([(*x, "c", "u") for x in rows], "doc_id long, embedding array<float>, cell string, unit string")
    index = ann.build(df, ["doc_id"], str(tmp_path / "i"), cells=2)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0])], "query_id long, q array<float>")
    got = sorted(((x.query_id, x["rank"], x.doc_id, x.score) for x in ann.search(index, q, 5, probes=2).collect()), key=str)
    assert got == [(1, 1, 1, 1.0), (1, 2, 1, 1.0), (1, 3, 7, 0.707107), (1, 4, None, 0.0)]
    empty = ann.build(df.limit(0), ["doc_id"], str(tmp_path / "e"))
    assert ann.search(empty, q, 5).count() == 0
    assert dense.dense_search(df.limit(0), q, ["doc_id"], 5).count() == 0
