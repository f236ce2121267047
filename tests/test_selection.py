"""Order statistics, percentiles and running sums over splitters and ranges, against a sort."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetra.operators import calibration as A
from vetra.operators import selection as O


def values(seed):
    rng = random.Random(seed)
    ties = [float(rng.choice([0, 1, 1, 1, 2, 50])) for _ in range(400)]  # most of them one value, which splitters meet
    return {"a": [rng.gauss(0, 1) for _ in range(900)], "b": ties, "c": [7.0], "d": [1.0] * 300, "e": [-0.0, 0.0, float("-inf"), float("inf"), 1e-300]}


@pytest.mark.parametrize(("few", "splitters"), [(65_536, 63), (20, 3), (1, 1)])
def test_places_are_those_of_a_sort(spark, few, splitters):
    own = values(1)
    rows = [(k, x) for k, v in own.items() for x in v] + [("a", None), ("b", float("nan")), ("none", None)]
    frame = spark.createDataFrame(rows, "key string, x double").repartition(3).cache()
    wanted = {k: sorted({0, len(v) // 3, len(v) // 2, len(v) - 1}) for k, v in own.items()} | {"none": [0]}
    wanted["a"] += [900, -1]  # outside
    got = O.order_statistics(frame, wanted, few, splitters)
    assert got == {(k, p): sorted(v)[p] for k, v in own.items() for p in wanted[k] if 0 <= p < len(v)}


def test_percentiles_interpolate(spark):
    own = {k: v for k, v in values(2).items() if k != "e"}
    frame = spark.createDataFrame([(k, x) for k, v in own.items() for x in v], "key string, x double").cache()
    points = [0.0, 0.01, 0.33, 0.5, 0.999, 1.0]
    got = O.percentiles(frame, dict.fromkeys([*own, "none"], points), few=30)
    for k, v in own.items():
        assert [got[k, p] for p in points] == pytest.approx(list(np.percentile(v, [100 * p for p in points])), abs=1e-12)
    assert all(got["none", p] is None for p in points)


@pytest.mark.parametrize("per_part", [7, 1000])
def test_running_sums_go_on_over_ranges(spark, per_part):
    rows = [(i * 0.5, i % 3, 1) for i in range(60)]
    frame = spark.createDataFrame(random.Random(1).sample(rows, 60), "x double, n long, one long")
    got = {r.x: (r.n, r.one) for r in O.running_sums(frame, F.desc("x"), ["n", "one"], per_part).collect()}
    assert got == {x: (sum(b for a, b, _ in rows if a >= x), sum(1 for a, _, _ in rows if a >= x)) for x, _, _ in rows}


def test_no_task_sees_all_values(spark):
    rows = spark.range(5000).select((F.col("id") % 977).cast("double").alias("confidence"), (F.col("id") % 3 == 0).alias("ok"))
    plan = A.select_min_confidence(rows, 0.3)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("Window")[-1].split("Aggregate")[0]
    got = A.select_min_confidence(rows, 0.3).first()
    own = [(r.confidence, r.ok) for r in rows.collect()]
    met = [c for c in sorted({c for c, _ in own}) if (over := [ok for x, ok in own if x >= c]) and sum(over) / len(over) >= 0.3]
    assert got.min_confidence == (met[0] if met else 1.0)
    assert A.order_statistic(rows, "confidence", 10**9).first().x is None
