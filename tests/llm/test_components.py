"""Components: right on any graph, and no round more than the graph needs."""

import random

import pytest

from loamgrid.llm import _common as c
from loamgrid.llm import jaccard
from loamgrid.llm.components import components


def least(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("seed", range(4))
def test_components_of_any_graph(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range((5, 25, 45, 90)[seed])]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len({x["id"] for x in rows})
    assert {x["id"]: x["component"] for x in rows} == least(edges)


def test_stars_need_no_round(spark, monkeypatch):
    written, materialize = [], c.materialize
    monkeypatch.setattr(c, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    stars = spark.createDataFrame([(10 * i + j, 10 * i) for i in range(5) for j in range(1, 6)], "a long, b long")
    rows = components(stars).collect()
    assert len(rows) == 30 and all(x["component"] == x["id"] // 10 * 10 for x in rows)
    assert written == ["edges"]


def test_components_are_not_named_again_without_new_links(spark, monkeypatch):
    named, rule = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda edges: named.append(1) or rule(edges))
    r = random.Random(1)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(40))
    base = text()
    docs = spark.createDataFrame([(i, text()) for i in range(20)] + [(20 + i, f"{base} {i} tail") for i in range(4)], "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in jaccard.shingle_components(docs).collect()}
    assert got == {i: min(i, 20) for i in range(24)}
    assert len(named) == 1
