"""Ordered folds, class-count group folds, training on views."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetra.operators import crossvalidation as X
from vetra.operators import curation as K
from vetra.operators import folds as D


def test_a_fold_runs_in_order_and_starts_anew(spark):
    rows = spark.createDataFrame([(k, i) for k in ("a", "b", None) for i in range(500)], "k string, i long").repartition(7)

    def step(state, row):
        state.append(row["i"])
        return len(state) if state[-1] == len(state) - 1 else -1

    got = D.ordered_fold(rows, ["k"], ["i"], list, step, "n", T.IntegerType()).collect()
    assert len(got) == 1500 and all(r.n == r.i + 1 for r in got)
    assert D.ordered_fold(rows.limit(0), ["k"], ["i"], list, step, "n", T.IntegerType()).collect() == []


def naive(groups, classes, folds):
    """Every group one by one by the same rule, the most uneven first."""
    totals = [sum(c[k] for _, c in groups) for k in range(classes)]
    filled = np.zeros((folds, classes))
    spread = lambda c: classes * sum(x * x for x in c) - sum(c) ** 2
    for _, c in sorted(groups, key=lambda g: (-spread(g[1]), -sum(g[1]), hashlib.md5(("cv" + g[0]).encode()).hexdigest())):
        cost = [(sum(filled[f][k] * c[k] / totals[k] ** 2 for k in range(classes) if totals[k]), filled[f].sum(), f) for f in range(folds)]
        filled[min(cost)[2]] += c
    return filled


def variance(filled):
    shares = filled / np.maximum(filled.sum(axis=0), 1)
    return float(shares.var(axis=0).sum())


@pytest.mark.parametrize("seed", range(3))
def test_classes_are_spread_no_worse_than_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows, groups = [], []
    for g in range(300):
        labels = [rng.choice([0, 0, 0, 0, 1, 1, 2]) for _ in range(rng.choice([1, 1, 2, 3, 9]))]
        rows += [(f"g{g}", x) for x in labels]
        groups.append((f"g{g}", [labels.count(k) for k in range(3)]))
    table = spark.createDataFrame(rows, "group_id string, label long").repartition(5)
    got = {r.group_id: r.fold for r in D.stratified_group_folds(table, 3, 5).collect()}
    assert len(got) == 300 and set(got.values()) == set(range(5))
    filled = np.zeros((5, 3))
    for g, c in groups:
        filled[got[g]] += c
    assert variance(filled) <= variance(naive(groups, 3, 5)) + 1e-5
    spread = D.class_spread(table, spark.createDataFrame(list(got.items()), "group_id string, fold int"), 3, 5)
    assert {r.label: (r.images, r.least, r.most) for r in spread.collect()} == {k: (filled[:, k].sum(), filled[:, k].min(), filled[:, k].max()) for k in range(3)}
    assert {r.group_id: r.fold for r in D.stratified_group_folds(table.repartition(2), 3, 5).collect()} == got


def test_one_crowd_of_equal_groups_is_dealt_evenly(spark):
    rows = spark.range(5003).select(F.concat(F.lit("g"), "id").alias("group_id"), F.lit(1).cast("long").alias("label"))
    sizes = [r["count"] for r in D.stratified_group_folds(rows, 3, 5).groupBy("fold").count().collect()]
    assert sorted(sizes) == [1000, 1000, 1001, 1001, 1001]


def test_odd_groups(spark):
    rows = spark.createDataFrame([(None, 0), (None, 1), ("a", None), ("b", 7), ("c", 0)], "group_id string, label long")
    got = D.stratified_group_folds(rows, 2, 3).collect()
    assert sorted((r.group_id or "") for r in got) == ["", "a", "b", "c"]
    assert D.stratified_group_folds(rows.limit(0), 2, 3).collect() == []
    with pytest.raises(ValueError):
        D.stratified_group_folds(rows, 2, 0)


def test_a_split_fold_is_the_sequential_rule(spark):
    rng = random.Random(5)
    groups = [(f"g{i}", rng.choice("ab"), rng.choice(["x", None]), rng.randint(1, 9)) for i in range(700)]
    table = spark.createDataFrame(groups, "group_id string, class_name string, fragment_type string, size long").repartition(6)
    want = {}
    for stratum in {g[1:3] for g in groups}:
        own = sorted((g for g in groups if g[1:3] == stratum), key=lambda g: hashlib.md5(("s" + g[0]).encode()).hexdigest())
        total, filled = float(sum(g[3] for g in own)), dict.fromkeys(["train", "validation", "test"], 0.0)
        for g in own:
            lack = [(r * total - filled[n], n) for n, r in K.SPLITS]
            name = max(lack, key=lambda x: x[0])[1]
            filled[name] += g[3]
            want[g[0]] = name
    assert {r.group_id: r.split for r in K.greedy_split(table).collect()} == want
    assert "collect_list" not in K.greedy_split(table)._jdf.queryExecution().toString()


def test_a_wide_fit_is_that_of_its_span():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(30, 12)), np.arange(30) % 3
    wide = np.column_stack([x, np.zeros((30, 60))])
    near, far = X.fit_softmax(x, y, 3, 1.0), X.fit_softmax(wide, y, 3, 1.0)
    here = np.ones(3, dtype=bool)
    assert np.allclose(X.probabilities(near, x, here), X.probabilities(far, wide, here), atol=1e-6)
    assert X.fit_softmax(rng.normal(size=(60, 1536)), np.arange(60) % 6, 6, 1.0).shape == (1537, 6)


def test_equal_views_weigh_as_a_larger_strength(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, i % 2, [float(v) for v in rng.normal(size=4) + i % 3]) for i in range(40)]
    plain = spark.createDataFrame(rows, "id long, label long, fold int, v array<double>")
    seen = plain.withColumn("views", F.array("v", "v", "v", "v"))
    a = {r.id: (r.said, r.p) for r in X.out_of_fold(plain, 2, (4.0,), 3).collect()}
    b = {r.id: (r.said, r.p) for r in X.out_of_fold(seen, 2, (1.0,), 3, on_views=True).collect()}
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1], abs=1e-5) for k in a)


def test_larger_development_sets_are_fitted_by_parts(spark):
    """More rows than a task takes were refused; parts give the predictions of one task, on views too."""
    rng = np.random.default_rng(11)
    middle = rng.normal(size=(3, 4))
    data = []
    for i in range(240):
        label = int(rng.integers(3))
        v = middle[label] + rng.normal(size=4) * 1.5
        data.append((i, label, int(rng.integers(4)), v.tolist(), [v.tolist(), (v + rng.normal(size=4) * 0.1).tolist()]))
    rows = spark.createDataFrame(data, "id long, label long, fold int, v array<double>, views array<array<double>>")
    for on_views in (False, True):
        a = {(r.c, r.id): r for r in X.out_of_fold(rows, 4, (0.1, 1000.0), 3, on_views=on_views).collect()}
        b = {(r.c, r.id): r for r in X.out_of_fold(rows, 4, (0.1, 1000.0), 3, on_views=on_views, most_rows=50).collect()}
        assert a.keys() == b.keys() and len(a) == 480
        assert all(a[k].said == b[k].said and a[k].fold == b[k].fold and abs(a[k].p - b[k].p) < 1e-7 for k in a)
