"""Near-duplicate vectors against all cosines."""

import math

import numpy as np
import pytest

from trialspark.llm import projections, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, cls long, n long, v string, `a.b` int"


def brute(rows, least=0.95):
    """(id, vector) -> (id, links, component, kept) in the same order."""
    able = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = [set() for _ in rows]
    for dim in {len(v) for (_, v), ok in zip(rows, able, strict=True) if ok}:
        own = [k for k, ((_, v), ok) in enumerate(zip(rows, able, strict=True)) if ok and len(v) == dim]
        m = np.array([rows[k][1] for k in own], dtype=float)
        m /= np.abs(m).max(axis=1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in np.argwhere(m @ m.T >= least):
            if a != b:
                links[own[a]].add(own[b])
    root = list(range(len(rows)))
    for k in range(len(rows)):
        if root[k] == k:
            todo = [k]
            while todo:
                x = todo.pop()
                for y in links[x]:
                    if y != k and root[y] == y:
                        root[y] = k
                        todo.append(y)
    ids = {}
    for (i, _), r in zip(rows, root, strict=True):
        ids[r] = min((x for x in (ids.get(r), i) if x is not None), default=None)
    return [(i, len(links[k]), ids[root[k]], i is not None and i == ids[root[k]]) for k, (i, _) in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "v", 4) for i, v in rows], SCHEMA)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def clusters(seed, groups, size, spread, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        centre = rng.standard_normal(dim)
        for _ in range(size):
            rows.append((centre + spread * rng.standard_normal(dim)).tolist())
    return list(enumerate(rows))


def test_query_as_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert found(queries.op12_embedding_dedup(spark, SF)) == sorted(brute(rows), key=str)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(8).tolist()
    rows = [(1, None), (2, []), (3, [0.0] * 8), (4, [1.0, None] * 4), (5, [float("nan")] + x[1:]), (6, [float("inf")] + x[1:]), (7, x), (7, x), (7, [2 * v for v in x]), (None, x), (None, [-v for v in x]), (8, [1e300 * v for v in x]), (9, [1e-300 * v for v in x]), (10, x[:7]), (11, [*x, 0.0]), (12, [-0.0, 1.0]), (13, [0.0, 1.0]), (14, [5.0])]
    assert found(projections.near_vectors(frame(spark, rows))) == sorted(brute(rows), key=str)


def test_recall_of_links(spark, monkeypatch):
    """Groups whose members lie about the least similarity, among many others: links found against all links, and none below."""
    monkeypatch.setattr(projections, "TOGETHER", 16)
    rows = clusters(2, 300, 4, 0.225) + [(10_000 + i, v) for i, v in clusters(3, 1500, 1, 0.0)]
    want = {r[0]: r[1] for r in brute(rows)}
    got = {r[0]: r[1] for r in found(projections.near_vectors(frame(spark, rows)))}
    assert sum(want.values()) > 400
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_a_dense_group_is_cut_into_tiles(spark):
    rows = clusters(4, 1, 3000, 0.02, dim=16) + [(5000 + i, [1.0] * 16) for i in range(500)]
    got = found(projections.near_vectors(frame(spark, rows)))
    assert got == sorted(brute(rows), key=str)
    assert {r[1] for r in got} == {2999, 499}


@pytest.mark.parametrize("vectors", [0, 1, 500, 10**5, 10**8])
def test_plans_reach_their_recall(vectors):
    plan = projections.Plan(vectors, 0.95, 0.999)
    assert plan.recall() >= 0.999 and plan.tables < 120


def test_empty_table(spark):
    assert found(projections.near_vectors(frame(spark, []))) == []
