"""op3 over its whole table, with repeated ids, clashing columns, ties at the threshold and lengths without learnt codes."""

import numpy as np
import pytest

from loamgrid.llm import embeddings as E
from loamgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, threshold=0.93):
    """(vec_id, label, vector) -> sorted (vec_id, n_links, component_id, kept), rows as they are."""
    unit = []
    for i, label, v in rows:
        ok = i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float64) if ok else None
        unit.append(None if x is None else x / np.linalg.norm(x))
    n, links = len(rows), [0] * len(rows)
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(n):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][1] == rows[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k in range(n):
        if unit[k] is not None:
            least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    out = [(rows[k][0], links[k], least[find(k)] if unit[k] is not None else rows[k][0]) for k in range(n)]
    return sorted(((i, m, r, i == r) for i, m, r in out), key=str)


def family(rng, n, dims, spread):
    base = rng.normal(size=(max(1, n // 5), dims))
    return [(base[k % len(base)] + spread * rng.normal(size=dims)).astype(np.float32).astype(float).tolist() for k in range(n)]


@pytest.mark.parametrize("planted", [False, True])
def test_query_against_brute_force(spark, tmp_path, planted):
    folder = SF
    if planted:  # the given table of this size holds no near copies
        folder, given = str(tmp_path), spark.read.parquet(f"{SF}/embeddings.parquet")
        rng = np.random.default_rng(2)
        more = [(1000 + k, v, k % 4) for k, v in enumerate(family(rng, 160, 64, 0.15))]
        given.unionByName(spark.createDataFrame(more, given.schema)).write.parquet(f"{folder}/embeddings.parquet")
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op3_itq_embeddings"](spark, folder).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == brute(rows) and any(r[1] for r in got) == planted


def test_repeated_ids_are_vectors_of_their_own(spark):
    rng = np.random.default_rng(4)
    vectors = family(rng, 120, 8, 0.12)
    rows = [(k % 40, k % 3, v) for k, v in enumerate(vectors)]
    rows += [(1, 0, [1.0, 0.0, 0.0]), (2, 0, [1.0, 0.1, 0.0]), (1, 0, [1.0, 0.0, 0.0, 0.0, 0.0]), (3, 0, [0.9, 0.0, 0.0, 0.0, 0.1]), (3, 1, [1.0, 0.0, 0.0])]
    rows += [rows[5], rows[5], (None, 1, vectors[0]), (7, None, vectors[1]), (8, 1, None), (8, 1, [0.0] * 8)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, component_id string, id int").repartition(5)
    stored = [(r["vec_id"], r["label"], r["embedding"]) for r in table.collect()]
    for block in (4, 1024):
        got = E.near_duplicates(table, block=block).select("vec_id", "n_links", "component_id", "kept").collect()
        assert sorted(map(tuple, got), key=str) == brute(stored)


def test_a_tie_at_the_threshold_links(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [3.0, 4.0]), (3, 0, [0.0, 1.0])]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), threshold=0.6).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {1: (1, 1), 2: (2, 1), 3: (1, 1)}


@pytest.mark.parametrize("lengths", [1, 0])
def test_recall_of_learnt_and_of_random_directions(spark, monkeypatch, lengths):
    """A thousand vectors of one length: at most a twentieth of the links may be missing, none may be wrong."""
    monkeypatch.setattr(E, "LENGTHS", lengths or 1)
    if not lengths:
        monkeypatch.setattr(E, "ENOUGH", 10**9)  # no length learns codes
    rng = np.random.default_rng(9)
    rows = [(k, 0, v) for k, v in enumerate(family(rng, 1000, 24, 0.27))]
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.93).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()}
    assert all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.95 * want.sum() and want.sum() > 300
