"""Connected components by alternating stars, with DataFrame operations only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetra.llm.common import cut, trimmed

#: Links that a task contracts by itself before the rounds.
TASK_LINKS = 200_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of links u, v as a link from every other node to the component's smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        least, before = np.minimum(root[a], root[b]), root.copy()
        for side in (a, b, before[a], before[b]):
            np.minimum.at(root, side, least)
        while not (root == root[root]).all():
            root = root[root]
        if (root == before).all():
            break
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def contracted(links: DataFrame, tasks: int) -> DataFrame:
    """Links u, v with the components of ``links``, of which at most ``tasks`` tasks make stars, each of its own; never more links than before."""
    most = 2 * TASK_LINKS

    def run(batches):
        held, n = [], 0

        def done():
            u, v = stars(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:  # a partition of any size
                yield done()
                held, n = [], 0
        if n:
            yield done()

    return links.coalesce(tasks).mapInArrow(trimmed(run), "u long, v long")


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of ``links`` (u, v: long); root is the component's smallest node.

    The first round makes stars of about ``TASK_LINKS`` links at a time, which is all there is to do where there are no more.
    Each later round turns every node's larger neighbours, then its smaller ones, to the smallest node known;
    the links end as one star a component, which one look at the ends of all links tells. Minima are aggregated map-side
    first, so a node with very many links sends few rows; no row goes to the driver but whether all are stars.
    """
    links = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for done in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = both.groupBy("u").agg(F.count_if(F.col("v") < F.col("u")).alias("up"), F.count_if(F.col("v") > F.col("u")).alias("down"))
        if ends.filter("up > 1 OR up = 1 AND down > 0").isEmpty():
            break
        if not done:
            tasks = -(-links.count() // TASK_LINKS)
            links = cut(contracted(links, tasks) if tasks == 1 else contracted(links, tasks).distinct())
            if tasks == 1:
                break
            continue
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.repartition("u").distinct()  # its minima and the join with them need no other exchange
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.unionByName(least.withColumnRenamed("m", "v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
