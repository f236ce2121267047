"""Clusterings of all classes at once, against a plain version and the library's k-means."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetra.operators import clustering as L

KIND = "image_id long, class_name string, v array<double>"


def clouds(sizes, width=6, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for name, n in sizes.items():
        middles = rng.normal(size=(5, width)) * 2
        rows += [(len(rows) + i, name, (middles[rng.integers(5)] + rng.normal(size=width)).tolist()) for i in range(n)]
    return rows


def cost_of(rows, name, centres):
    x = np.array([r[2] for r in rows if r[1] == name])
    return ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


def test_cost_is_that_of_fixed_points_and_close_to_one_fit_a_class(spark):
    """Both start at random, and class b has several optima within half a percent: the best of ten runs needn't be the same."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = clouds({"a": 300, "b": 120, "c": 40})
    table = spark.createDataFrame(rows, KIND).repartition(6)
    found = L.class_kmeans(table, 4, runs=10)
    for name in "abc":
        x = np.array([r[2] for r in rows if r[1] == name])
        got = found[name]
        assert got.cost == pytest.approx(cost_of(rows, name, got.centres))
        label = ((x[:, None] - got.centres[None]) ** 2).sum(2).argmin(1)
        assert np.allclose([x[label == i].mean(0) for i in range(4)], got.centres, atol=1e-4)
        own = table.filter(F.col("class_name") == name).withColumn("features", array_to_vector("v"))
        assert got.cost <= min(KMeans(k=4, seed=s, maxIter=100).fit(own).summary.trainingCost for s in range(3)) * 1.005
    again = L.class_kmeans(table.repartition(3), 4, runs=10)
    assert all(np.allclose(found[n].centres, again[n].centres) for n in "abc")


def test_batches_of_classes_and_hot_classes_give_the_same(spark):
    rows = clouds({"a": 60, "b": 1500, "c": 30, "d": 25}, width=3)  # b has more rows than starts are drawn from
    table = spark.createDataFrame(rows, KIND).repartition(4)
    whole = L.class_kmeans(table, 3, runs=3)
    parts = L.class_kmeans(table, 3, runs=3, most_centres=8 * 3 * 3 * 3 * 2)  # two classes at a time
    assert whole.keys() == parts.keys() and all(np.allclose(whole[n].centres, parts[n].centres) for n in whole)
    one, cut = (sorted(map(tuple, L.class_medoids(table, whole, m).collect())) for m in (L.MOST_CENTRES, 1))
    assert one == cut and len(one) == 12
    for name, cluster, image_id, score in one:
        x = {r[0]: np.array(r[2]) for r in rows if r[1] == name}
        centres = whole[name].centres
        members = [i for i, v in x.items() if ((v - centres) ** 2).sum(1).argmin() == cluster]
        assert image_id == min(members, key=lambda i: (-round(float(x[i] @ centres[cluster]), 9), i)) and score == pytest.approx(float(x[image_id] @ centres[cluster]))


def test_odd_rows(spark):
    rows = [(1, "few", [1.0, 0.0]), (2, "few", [1.0, 0.0]), (3, "few", [0.0, 1.0]), (4, "one", [5.0, 5.0]), (5, None, [1.0, 1.0]), (6, "few", None), (7, "few", []), (8, "one", [None, 1.0]), (9, "one", [float("nan"), 1.0]), (10, "bad", [2.0, 2.0]), (11, "zero", [0.0, 0.0])]
    table = spark.createDataFrame(rows, KIND).withColumn("cluster", F.lit("x")).withColumn("ok", F.when(F.col("image_id") != 10, True))
    got = sorted((r.class_name, r.image_id) for r in L.kmeans_references(table, 4, runs=2, acceptable=F.col("ok")).collect())
    assert got == [("few", 1), ("few", 3), ("one", 4), ("zero", 11)]
    assert L.kmeans_references(table.limit(0), 4).collect() == []
    with pytest.raises(ValueError, match="components"):
        L.kmeans_references(spark.createDataFrame([(1, "a", [1.0]), (2, "a", [1.0, 2.0])], KIND), 2)
    named = spark.createDataFrame([("x", "a", [1.0]), ("y", "a", [3.0])], "image_id string, class_name string, v array<double>")
    assert [r.image_id for r in L.kmeans_references(named, 1).collect()] == ["y"]


def test_a_pass_reads_matrices_and_sends_one_row_a_class(spark):
    """Few rows, whatever the number of starts and clusters, with the sums of plain numpy; in one step and in two."""
    rng, rows = np.random.default_rng(2), clouds({"a": 700, "b": 50}, width=3)
    centres = {(c, run): rng.normal(size=(4 + run, 3)) for c in "ab" for run in range(3)}
    for parts in (3, 70):
        blocks = L._packed(spark.createDataFrame(rows, KIND).repartition(parts))
        assert blocks.count() <= 2 * parts
        found = L._pass(blocks, centres)
        assert found.keys() == centres.keys()
        for (name, run), own in centres.items():
            x = np.array([r[2] for r in rows if r[1] == name])
            apart = ((x[:, None] - own[None]) ** 2).sum(2)
            label = apart.argmin(1)
            n, cost, total = found[name, run]
            assert n.tolist() == np.bincount(label, minlength=len(own)).tolist() and cost.sum() == pytest.approx(apart.min(1).sum())
            assert np.allclose(total, [x[label == i].sum(0) for i in range(len(own))])
