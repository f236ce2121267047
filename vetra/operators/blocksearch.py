"""Exact search of libraries of any size: blocks of references, bounds that rule blocks out, best of each block, merge.

1. References go to the nearest of at most ``MOST_CELLS`` pivots. A cell keeps its largest distance from the pivot
   and its largest norm; no product of a query with a member exceeds q * pivot + |q| * distance, nor |q| * norm.
2. A query first meets the cell of the pivot it is most similar to. The k-th similarity found there is what
   other cells must reach.
3. It then meets the cells whose bound reaches that, and the best of all cells are merged.

A cell is dealt to tasks in blocks of at most ``per_block`` references, its queries in blocks of about
``per_queries``. Within a task products are matrix products; what comes near the k-th is multiplied again in the
order of the array search, so both give the same similarities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vetra.plans.session import cut

#: Pivots that every task holds at most, each with a vector.
MOST_CELLS = 1024
FOUND = "row long, far double, reference_id string, class_name string, fragment_type string"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _placed(pivots: np.ndarray):
    """For mapInArrow: rows with the nearest pivot's number, their distance from it and their norm."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(batch.schema.get_field_index("v")))
                cell = ((pivots**2).sum(axis=1) - 2 * (x @ pivots.T)).argmin(axis=1)
                apart, norm = np.linalg.norm(x - pivots[cell], axis=1), np.linalg.norm(x, axis=1)
                extra = [pa.array(cell.astype(np.int32)), pa.array(apart), pa.array(norm)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "cell", "apart", "norm"])

    return run


def _routed(pivots: np.ndarray, apart: np.ndarray, norm: np.ndarray, full: np.ndarray, first: bool):
    """For mapInArrow over row, v, worst: the cells that a query meets first, or all the others that may hold better."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1))
            product, size = q @ pivots.T, np.linalg.norm(q, axis=1)[:, None]
            home = np.where(full, product, -np.inf).argmax(axis=1) if full.any() else product.argmax(axis=1)
            if first:
                rows, cells = np.arange(len(q)), home
            else:
                slack = 1e-9 * (1 + size * norm.max())  # far more than products can be off by rounding
                worst = np.nan_to_num(batch.column(2).to_numpy(zero_copy_only=False), nan=-np.inf)[:, None]
                met = np.minimum(product + size * apart, size * norm) + slack >= worst
                met[np.arange(len(q)), home] = False
                rows, cells = np.nonzero(met)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(cells.astype(np.int32))], names=["row", "v", "cell"])

    return run


def _best(k: int):
    """For cogroups of queries (row, v) and references: each query's k best, with all that equal the last up to rounding multiplied exactly."""

    def run(key, queries: pa.Table, refs: pa.Table) -> pa.Table:
        out = {c: [] for c in ("row", "far", "at")}
        if queries.num_rows and refs.num_rows:
            q, r, ids = _matrix(queries.column("v")), _matrix(refs.column("v")), queries.column("row").to_numpy()
            names = np.array(refs.column("reference_id").to_pylist(), object)
            norm, most = np.linalg.norm(r, axis=1).max(), min(k, len(r))
            for i in range(0, len(q), 256):
                own = q[i : i + 256]
                product = own @ r.T
                last = np.partition(product, len(r) - most, axis=1)[:, len(r) - most]
                slack = 1e-10 * (1 + np.linalg.norm(own, axis=1) * norm)
                a, b = np.nonzero(product >= (last - slack)[:, None])
                exact = np.zeros(len(a))
                for j in range(q.shape[1]):  # the order of the array search
                    exact = exact + own[a, j] * r[b, j]
                order = np.lexsort((names[b], -exact, a))
                a, b, exact = a[order], b[order], exact[order]
                kept = np.arange(len(a)) - np.searchsorted(a, a) < most
                out["row"].append(ids[i + a[kept]])
                out["far"].append(-exact[kept])
                out["at"].append(b[kept])
        joined = {c: np.concatenate(v) if v else np.empty(0, float if c == "far" else np.int64) for c, v in out.items()}
        at = pa.array(joined["at"], pa.int64())
        return pa.table([pa.array(joined["row"], pa.int64()), pa.array(joined["far"], pa.float64()), *[refs.column(c).take(at).cast(pa.string()) for c in ("reference_id", "class_name", "fragment_type")]], names=["row", "far", "reference_id", "class_name", "fragment_type"])

    return run


def _meet(pairs: DataFrame, placed: DataFrame, blocks: dict[int, int], k: int, per_queries: int) -> DataFrame:
    """The k best of each (row, cell block) in ``pairs`` (row, v, cell), as FOUND."""
    pairs = cut(pairs)
    loads = [(r["cell"], blocks[r["cell"]], -(-r["count"] // per_queries)) for r in pairs.groupBy("cell").count().collect()]  # a row a cell
    plan = F.broadcast(pairs.sparkSession.createDataFrame(loads, "cell int, blocks int, chunks int"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = pairs.join(plan, "cell").select("row", "v", "cell", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int").alias("chunk"), numbers("blocks").alias("block"))
    held = placed.join(plan, "cell").select("reference_id", "class_name", "fragment_type", "v", "cell", "block", numbers("chunks").alias("chunk"))
    keys = ["cell", "block", "chunk"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_best(k), FOUND)


def _kept(found: DataFrame, k: int) -> DataFrame:
    """The k best of each row; a window of ranks up to k is cut short before the shuffle."""
    nth = F.row_number().over(W.partitionBy("row").orderBy("far", "reference_id", "class_name", "fragment_type"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= k)


def search_blocks(queries: DataFrame, refs: DataFrame, k: int, per_block: int = 20_000, per_queries: int = 8_192, most_cells: int = MOST_CELLS) -> tuple[DataFrame, dict]:
    """``queries`` plus matches, as ``retrieval.search`` gives them, and what the bounds saved: {cells, pairs, met}.

    ``refs``: reference_id, class_name, fragment_type, v; all vectors have the same length. ``pairs`` are all
    (query, cell) pairs, ``met`` those that were multiplied.
    """
    spark = queries.sparkSession
    columns = ["reference_id", "class_name", "fragment_type", "v"]
    n = refs.count()
    cells = max(1, min(most_cells, -(-n // per_block), n))
    sample = refs.orderBy(F.xxhash64("reference_id"), "reference_id").select("v").limit(cells).collect()  # at most MOST_CELLS
    pivots = np.array([r["v"] for r in sample])
    schema = "reference_id string, class_name string, fragment_type string, v array<double>, cell int, apart double, norm double"
    placed = cut(refs.select(*[F.col(c).cast("string") for c in columns[:3]], "v").mapInArrow(_placed(pivots), schema))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("apart"), F.max("norm").alias("norm")).collect()
    apart, norm, count = np.full(cells, -np.inf), np.full(cells, -np.inf), np.zeros(cells, np.int64)
    for r in sizes:
        apart[r["cell"]], norm[r["cell"]], count[r["cell"]] = r["apart"], r["norm"], r["n"]
    blocks = {c: -(-int(m) // per_block) for c, m in enumerate(count) if m}
    of = F.element_at(F.array(*[F.lit(max(1, blocks.get(c, 1))) for c in range(cells)]), F.col("cell") + 1)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("reference_id", F.lit(1)), of).cast("int"))
    rows = cut(queries.withColumn("__row", F.monotonically_increasing_id()))
    plain = rows.select(F.col("__row").alias("row"), "v")
    route = lambda frame, first: frame.select("row", "v", "worst").mapInArrow(_routed(pivots, apart, norm, count >= k, first), "row long, v array<double>, cell int")
    home = _meet(route(plain.withColumn("worst", F.lit(None).cast("double")), True), placed, blocks, k, per_queries)
    home = cut(_kept(home, k).drop("nth"))
    worst = home.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, -F.max("far")).alias("worst"))
    others = cut(route(plain.join(worst, "row", "left"), False))
    away = _meet(others, placed, blocks, k, per_queries)
    item = F.struct("nth", (-F.col("far")).alias("similarity"), "reference_id", "class_name", "fragment_type")
    best = _kept(home.unionByName(away), k).groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("m"))
    ranked = F.transform("m", lambda m: F.struct(m["nth"].alias("rank"), m["similarity"].alias("similarity"), m["reference_id"].alias("reference_id"), m["class_name"].alias("class_name"), m["fragment_type"].alias("fragment_type")))
    asked = rows.count()
    return rows.join(best.select(F.col("row").alias("__row"), ranked.alias("matches")), "__row", "left").drop("__row"), {"cells": len(blocks), "pairs": asked * len(blocks), "met": asked + others.count()}
