"""k-means of every class, with several starts each, in one chain of jobs, and the medoids of the best start.

Rows are packed once into matrices of one class each, in double precision. A pass over these assigns them to the centres of all classes and starts at once; tasks hand on sums by cluster, which
are added up in two steps where tasks are many. What is broadcast and collected is the centres alone: classes go in batches whose centres
have a stated size, so neither grows with the rows. Starts are k-means++ with trials on a bounded sample of a class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetra.plans.session import cut

#: Bytes of centres of a batch of classes, as broadcast; a single class above goes by itself.
MOST_CENTRES = 16 << 20
#: Rows of a class, the first in the order of a seeded hash, from which its starts are drawn. All rows move the centres.
SEED_ROWS = 1_000
_SLICE = 1_024


@dataclass
class Clustering:
    """Of a class: the centres (clusters x width) of its best start and the sum of squared distances to them."""

    centres: np.ndarray
    cost: float


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(1)[None, :], 0.0)


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator, trials: int) -> np.ndarray:
    """Up to ``k`` distinct rows as centres: each is the best of some drawn by squared distance to those before it."""
    chosen = [int(rng.integers(len(x)))]
    near = _distances(x, x[chosen])[:, 0]
    while len(chosen) < k:
        near[_same(x, x[chosen[-1]])] = 0.0  # rounding leaves no distance to a copy
        if not near.any():
            break
        drawn = rng.choice(len(x), size=trials, p=near / near.sum())
        left = np.minimum(near[:, None], _distances(x, x[drawn]))
        best = int(left.sum(0).argmin())
        chosen.append(int(drawn[best]))
        near = left[:, best]
    return x[chosen]


def _same(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    return (x == row).all(axis=1)


def _starts(rows: DataFrame, per_class: int, runs: int, seed: int, seed_rows: int) -> dict[tuple[str, int], np.ndarray]:
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("image_id").cast("string")).cast("binary"))
    nth = F.row_number().over(W.partitionBy("class_name").orderBy("key", "image_id"))  # its limit cuts before the shuffle too
    sample = rows.withColumn("key", key).withColumn("nth", nth).filter(F.col("nth") <= seed_rows).select("class_name", "nth", "v")

    def draw(key, tab):
        order = np.argsort(tab.column("nth").to_numpy())
        x = np.array(tab.column("v").to_pylist(), dtype=np.float64)[order]
        made = [plus_plus(x, min(per_class, len(x)), np.random.default_rng([seed, run]), 2 + int(np.log(per_class))) for run in range(runs)]
        return pa.table([pa.array([key[0].as_py()] * runs), pa.array(range(runs), pa.int32()), pa.array([m.tolist() for m in made], pa.list_(pa.list_(pa.float64())))], names=["class_name", "run", "centres"])

    found = sample.groupBy("class_name").applyInArrow(draw, "class_name string, run int, centres array<array<double>>")
    return {(r["class_name"], r["run"]): np.array(r["centres"]) for r in found.collect()}  # the centres of a batch


def _by_class(batch: pa.RecordBatch, names: list[str]):
    """Slices of a batch: class, ids, vectors."""
    code = pc.index_in(batch.column("class_name"), value_set=pa.array(names)).fill_null(-1).to_numpy(zero_copy_only=False)
    for i, name in enumerate(names):
        at = np.flatnonzero(code == i)
        for lo in range(0, len(at), _SLICE):
            part = batch.take(pa.array(at[lo : lo + _SLICE]))
            v = part.column("v").flatten().to_numpy(zero_copy_only=False)
            yield name, part.column("image_id"), v.reshape(part.num_rows, -1)


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` as matrices: class_name, x (vectors of that class, end to end, as bytes of doubles)."""

    def pack(batches):
        for batch in batches:
            names = batch.column("class_name").unique().drop_null().to_pylist()
            found = [(name, x.tobytes()) for name, _, x in _by_class(batch, names)]
            yield pa.RecordBatch.from_arrays([pa.array([name for name, _ in found], pa.string()), pa.array([x for _, x in found], pa.binary())], names=["class_name", "x"])

    return cut(rows.filter("size(v) > 0").select("class_name", "image_id", "v").mapInArrow(pack, "class_name string, x binary"))


#: A row a class: of all starts' clusters, end to end, n (longs), cost and total (doubles).
_SUMS = "class_name string, bucket int, n binary, cost binary, total binary"
_SUMS_NAMES = ["class_name", "bucket", "n", "cost", "total"]
_SUMS_KINDS = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_FEW = 64


def _pass(blocks: DataFrame, centres: dict[tuple[str, int], np.ndarray], buckets: int = 32) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each class and run n, cost and total, by cluster, of the rows of ``blocks`` nearest to it (ties to the first cluster)."""
    runs: dict[str, list[int]] = {}
    for name, run in centres:
        runs.setdefault(name, []).append(run)
    edges = {name: np.concatenate([[0], np.cumsum([len(centres[name, run]) for run in own])]) for name, own in runs.items()}
    shared = blocks.sparkSession.sparkContext.broadcast({name: (edges[name], np.concatenate([centres[name, run] for run in own])) for name, own in runs.items()})

    def assign(batches):
        from pyspark import TaskContext

        bucket = TaskContext.get().partitionId() % buckets
        n, cost, total = {}, {}, {}
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name not in shared.value:
                    continue
                at, own = shared.value[name]
                x = np.frombuffer(raw.as_buffer(), np.float64).reshape(-1, own.shape[1])
                if name not in n:
                    n[name], cost[name], total[name] = np.zeros(len(own), np.int64), np.zeros(len(own)), np.zeros(own.shape)
                apart, member = _distances(x, own), np.zeros((len(own), len(x)))
                for a, b in zip(at, at[1:]):
                    label = a + apart[:, a:b].argmin(1)
                    member[label, np.arange(len(x))] = 1.0
                    n[name] += np.bincount(label, minlength=len(own))
                    cost[name] += np.bincount(label, apart[np.arange(len(x)), label], minlength=len(own))
                total[name] += member @ x
        for name in n:  # a record batch a class, so that no second copy of all is made
            out = [name, bucket, n[name].tobytes(), cost[name].tobytes(), total[name].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, _SUMS_KINDS)], _SUMS_NAMES)

    def add(key, tab):
        """Added in one order whatever the order of arrival, so that sums are the same in every run."""
        rows = sorted(zip(*(tab.column(c).to_pylist() for c in ("n", "cost", "total"))))
        whole = [sum(np.frombuffer(r[i], kind) for r in rows).tobytes() for i, kind in enumerate((np.int64, np.float64, np.float64))]
        return pa.table([pa.array([v], t) for v, t in zip([key[0].as_py(), key[1].as_py(), *whole], _SUMS_KINDS)], names=_SUMS_NAMES)

    sums = blocks.mapInArrow(assign, _SUMS)
    if blocks.rdd.getNumPartitions() > _FEW:
        sums = sums.groupBy("class_name", "bucket").applyInArrow(add, _SUMS)
    found = sums.withColumn("bucket", F.lit(0)).groupBy("class_name", "bucket").applyInArrow(add, _SUMS).collect()  # the centres of a batch
    shared.unpersist()
    out = {}
    for r in found:
        n, cost, total = (np.frombuffer(r[c], kind) for c, kind in (("n", np.int64), ("cost", np.float64), ("total", np.float64)))
        at = edges[r["class_name"]]
        for run, a, b in zip(runs[r["class_name"]], at, at[1:]):
            out[r["class_name"], run] = n[a:b], cost[a:b], total.reshape(len(n), -1)[a:b]
    return out


def _batches(classes: list[str], each: int, most: int) -> list[list[str]]:
    size = max(1, most // max(each, 1))
    return [classes[i : i + size] for i in range(0, len(classes), size)]


def class_kmeans(rows: DataFrame, per_class: int, runs: int = 10, seed: int = 7, iterations: int = 100, tolerance: float = 1e-9, most_centres: int = MOST_CENTRES, seed_rows: int = SEED_ROWS) -> dict[str, Clustering]:
    """The best of ``runs`` clusterings of each class by cost. ``rows``: image_id, class_name (string), v (array<double> of one width).

    A start is done when its centres move by no more than ``tolerance`` of the mean square of its vectors, or after
    ``iterations``; those done drop out of the passes. A class of fewer distinct vectors than ``per_class`` has fewer clusters.
    A cluster that loses its rows keeps its centre. Rows without class or vector take no part; differing widths are refused.
    """
    if min(per_class, runs, iterations) < 1:
        raise ValueError("per_class, runs and iterations must be positive")
    widths = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if widths["least"] != widths["most"]:
        raise ValueError(f"vectors have {widths['least']} to {widths['most']} components")
    if not widths["most"]:
        return {}
    names = [r[0] for r in rows.select("class_name").distinct().orderBy("class_name").collect()]  # one row a class
    blocks, out = _packed(rows), {}
    for batch in _batches(names, 8 * runs * per_class * widths["most"], most_centres):
        own = rows.filter(F.col("class_name").isin(batch)) if len(batch) < len(names) else rows
        parts = blocks.filter(F.col("class_name").isin(batch)) if len(batch) < len(names) else blocks
        active = _starts(own, per_class, runs, seed, seed_rows)
        ended: dict[tuple[str, int], tuple[np.ndarray, float]] = {}
        for turn in range(iterations):
            sums, moved = _pass(parts, active), {}
            for at, centres in active.items():
                n, costs, total = sums[at]
                new, held = centres.copy(), n > 0
                new[held] = total[held] / n[held, None]
                cost = float(costs.sum())
                scale = (centres * centres).sum(1).mean()
                if turn == iterations - 1 or ((new - centres) ** 2).sum(1).max() <= tolerance * max(scale, 1e-300):
                    ended[at] = centres, cost  # the cost is of these centres
                else:
                    moved[at] = new
            active = moved
            if not active:
                break
        for name in batch:
            best = min(((name, run) for run in range(runs)), key=lambda at: (ended[at][1], at[1]))
            out[name] = Clustering(*ended[best])
    return out


def class_medoids(rows: DataFrame, found: dict[str, Clustering], most_centres: int = MOST_CENTRES) -> DataFrame:
    """class_name, cluster, image_id, score: of the rows nearest to each centre, the one with the largest dot product with it (to 9 digits); ties to the smaller id."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField("class_name", T.StringType()), T.StructField("cluster", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("image_id", kinds["image_id"])])
    if not found:
        return rows.sparkSession.createDataFrame([], schema)
    each = max(c.centres.nbytes for c in found.values())
    out = None
    for batch in _batches(sorted(found), each, most_centres):
        shared = rows.sparkSession.sparkContext.broadcast({name: found[name].centres for name in batch})

        def score(batches, shared=shared, names=batch):
            for b in batches:
                for name, ids, x in _by_class(b, names):
                    own = shared.value[name]
                    label = _distances(x, own).argmin(1)
                    dots = np.round((x * own[label]).sum(1), 9)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(label.astype(np.int32)), pa.array(dots), ids], ["class_name", "cluster", "score", "image_id"])

        part = rows.mapInArrow(score, schema)
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("class_name", "cluster").agg(F.min(F.struct((-F.col("score")).alias("far"), "image_id")).alias("m"))
    return best.select("class_name", "cluster", "m.image_id", (-F.col("m.far")).alias("score"))


def kmeans_references(rows: DataFrame, per_class: int, runs: int = 10, seed: int = 7, acceptable: Column | None = None, **options) -> DataFrame:
    """class_name, image_id: per class up to ``per_class`` medoids of the best of ``runs`` clusterings of its acceptable rows.

    ``rows``: image_id, class_name, v. Without ``acceptable`` all rows count; a row for which it is null doesn't. A
    class with no acceptable row has no reference. Rows without class, or with an empty vector or one that holds null,
    NaN or infinity, take no part.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kept = rows if acceptable is None else rows.filter(acceptable)
    usable = kept.filter(F.col("class_name").isNotNull() & (F.size("v") > 0) & finite).select("image_id", F.col("class_name").cast("string").alias("class_name"), F.col("v").cast("array<double>").alias("v"))
    usable = cut(usable)  # read once a pass
    return class_medoids(usable, class_kmeans(usable, per_class, runs, seed, **options)).select("class_name", "image_id")
