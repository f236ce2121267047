"""Folds in a given order: sequential rules over sorted partitions, with a state that doesn't grow with the rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetra.plans.session import cut


def ordered_fold(rows: DataFrame, keys: list[str], order: list[Column | str], start: Callable, step: Callable, result: str, kind: T.DataType) -> DataFrame:
    """``rows`` and ``result``: for each value of ``keys``, ``step(state, row)`` gives it row by row in the order of ``order``.

    Rows are shuffled once by ``keys`` (into one partition where there are none) and sorted there, which can spill; they pass
    through a task in Arrow batches and only the state of the value at hand, from ``start()``, is held. ``step`` gets a
    dict of the row and changes the state. Null is a value like any other. ``order`` should leave no ties.
    """
    spread = rows.repartition(*keys) if keys else rows.repartition(1)
    schema = T.StructType(rows.schema.fields + [T.StructField(result, kind)])
    made = pa.int32() if isinstance(kind, T.IntegerType) else pa.string()

    def run(batches):
        at, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if at is None or at != [row[k] for k in keys]:
                    at, state = [row[k] for k in keys], start()
                out.append(step(state, row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, made)], [*batch.schema.names, result])

    return spread.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def group_counts(rows: DataFrame, classes: int) -> DataFrame:
    """group_id, counts (rows of each label from 0 to classes - 1), size; a null or other label counts in the size alone."""
    counts = F.array(*[F.count_if(F.coalesce(F.col("label") == k, F.lit(False))) for k in range(classes)])
    return rows.groupBy("group_id").agg(counts.alias("counts"), F.count(F.lit(1)).alias("size"))


def stratified_group_folds(rows: DataFrame, classes: int, folds: int, seed: str = "cv", spare: int = 8) -> DataFrame:
    """group_id, fold (int, from 0) for ``rows`` (group_id string, label): groups stay whole, every class is spread over the folds.

    Groups with the same counts are interchangeable: of m of them, floor(m / folds) - ``spare`` go to each fold in the order of a
    seeded hash, which leaves no difference between folds. What is left, fewer than (``spare`` + 1) x ``folds`` groups for each
    distinct vector of counts, small ones to even out the larger among them, is placed one by one, the most uneven vectors first, then the larger ones: each where it adds least to the sum
    over classes of squared shares, which is the variance of class shares; ties to the fold with fewer rows, then the first.

    A vector of counts that most groups have is numbered in 256 ranges of the hash, so no task sees all of it. The rows
    of a null group are one group. No rows: no folds.
    """
    if folds < 1 or classes < 1:
        raise ValueError("folds and classes must be positive")
    key = F.md5(F.concat(F.lit(seed), F.coalesce("group_id", F.lit(""))).cast("binary"))
    groups = cut(group_counts(rows, classes).withColumn("key", key).withColumn("range", F.substring("key", 1, 2)))
    sums = groups.agg(*[F.sum(F.get("counts", F.lit(k))).alias(f"n{k}") for k in range(classes)]).first()  # one row
    weight = np.array([1.0 / (n * n) if n else 0.0 for n in sums])

    alike = ["counts", "size"]
    ranges = groups.groupBy(*alike, "range").agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(*alike)
    before = F.sum("n").over(whole.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.select(*alike, "range", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(whole).alias("m"))
    own = F.row_number().over(W.partitionBy(*alike, "range").orderBy("key", "group_id")) - 1
    numbered = groups.withColumn("own", own).join(ranges, [*alike, "range"]).withColumn("nth", F.col("before") + F.col("own"))
    numbered = cut(numbered.select("group_id", "key", *alike, "nth", (F.greatest(F.floor(F.col("m") / folds) - spare, F.lit(0)) * folds).alias("even")))

    dealt = numbered.filter("nth < even").select("group_id", (F.col("nth") % folds).cast("int").alias("fold"))
    squares = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x * x)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    left = numbered.filter("nth >= even").select("group_id", "key", *alike, (classes * squares - total * total).alias("spread"))

    def start():
        return np.zeros((folds, classes), dtype=np.int64), np.zeros(folds, dtype=np.int64)

    def step(state, row):
        filled, sizes = state
        counts = np.array(row["counts"])
        cost = (filled * counts * weight).sum(axis=1).round(12)
        best = int(np.lexsort((np.arange(folds), sizes, cost))[0])
        filled[best] += counts
        sizes[best] += row["size"]
        return best

    placed = ordered_fold(left, [], [F.desc("spread"), F.desc("size"), "key", "group_id"], start, step, "fold", T.IntegerType())
    return dealt.unionByName(placed.select("group_id", "fold"))


def class_spread(rows: DataFrame, placed: DataFrame, classes: int, folds: int) -> DataFrame:
    """label, images, least, most: how many rows of each class the folds with fewest and most of it have."""
    by_fold = rows.join(placed, "group_id").groupBy("fold").agg(*[F.count_if(F.col("label") == k).alias(f"c{k}") for k in range(classes)])
    names = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("label"), F.col(f"c{k}").alias("n")) for k in range(classes)])).alias("o")
    got = by_fold.select(names).select("o.*").groupBy("label")
    least = F.when(F.count(F.lit(1)) < folds, F.lit(0)).otherwise(F.min("n"))
    return got.agg(F.sum("n").alias("images"), least.alias("least"), F.max("n").alias("most"))
