"""Nearest neighbours: magnitudes, ties, copies, lengths and clashing columns, and recall against brute force."""

import collections

import numpy as np
import pytest

from vetra.llm import neighbours

VECTORS = "vec_id long, embedding array<double>"


def answers(spark, rows, **kw):
    got = collections.defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, VECTORS), **kw).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(own)] for q, own in got.items()}


def brute(rows, divisor=100, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in ids[ids % divisor == 0].tolist():
        d = neighbours.distances(x, x[ids == q][0])
        out[q] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != q][:k]
    return out


def test_search_walks_a_chain_to_its_end(spark):
    nodes = spark.createDataFrame([(i, [float(i)]) for i in range(9)], "node long, vec array<double>")
    graph = spark.createDataFrame([(i, [i + 1], [1.0]) for i in range(8)], "a long, bs array<long>, ds array<float>").selectExpr("*", "array(false) AS fresh")
    queries = spark.createDataFrame([(0, [0.0])], "q long, vec array<double>")
    assert {r.v for r in neighbours.graph_search(nodes, graph, queries).collect()} == set(range(1, 9))


@pytest.mark.parametrize("scale", [1e25, 1e-42, 1e200, 1e-200])
def test_any_finite_magnitude(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * scale).tolist()) for i in range(201)]
    got, want = answers(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
        assert np.allclose([d for _, d in got[q]], [d for _, d in want[q]], rtol=1e-12, atol=0)


def test_copies_ties_lengths_and_few_candidates(spark):
    rows = [(i, [float(i % 4), 0.0, 1.0]) for i in range(0, 40)] + [(100, [5.0, 5.0]), (101, [5.0, 6.0]), (102, [5.0, 4.0]), (200, [1.0])]
    rows += [(100, [5.0, 5.0])]  # an equal row counts once
    got = answers(spark, rows)
    assert got == {0: brute(rows[:40])[0], 100: [(101, 1.0), (102, 1.0)]}  # 200 has no candidate of its length


def test_other_columns(spark):
    rows = [(i, [float(i), 1.0], i, "x", 0.5, i) for i in range(5)]
    table = spark.createDataFrame(rows, VECTORS + ", node long, vec string, q double, bucket int")
    assert {(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(table).collect()} == {(0, k, k) for k in range(1, 5)}


def test_recall_on_twenty_thousand(spark):
    """Random directions are the hardest case; several leaves, rounds and hops are needed."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20_000, 32))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got, want = answers(spark, rows, divisor=500), brute(rows, 500)
    assert got.keys() == want.keys()
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want]) >= 0.95
