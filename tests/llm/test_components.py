"""Components: right on any shape, in few rounds, since each round is three jobs whatever is left."""

import random

import pytest

from corpusloom.llm import simhash


def shapes():
    r = random.Random(5)
    return {
        "star": ([(0, k) for k in range(1, 3000)], 2),
        "stars in a row": ([(1000 * k, 1000 * k + j) for k in range(3) for j in range(1, 1001)], 3),
        "path": ([(k, k + 1) for k in range(400)], 8),
        "random": ([(r.randrange(900), r.randrange(900)) for _ in range(600)] + [(950, 950)], 7),
    }


@pytest.mark.parametrize("shape", list(shapes()))
def test_components(spark, monkeypatch, shape):
    edges, most = shapes()[shape]
    random.Random(6).shuffle(edges)
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    rounds, write = [], simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, name, *rest: rounds.append(name) or write(df, name, *rest))
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = lambda of: {frozenset(n for n in of if of[n] == root) for root in set(of.values())}
    assert got.keys() == label.keys() and groups(got) == groups(label)
    assert rounds.count("moves") <= most
