"""Exact order statistics and running sums of columns of any length.

No sort of all values, and no task that sees them all: values are counted between splitters, and only what
lies between the two splitters around a wanted place is looked at again, until that is little.
"""

from __future__ import annotations

from math import ceil, floor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values around the wanted places that are brought together in the end, and splitters of a pass.
FEW, SPLITTERS = 65_536, 63


class Bracket(NamedTuple):
    """Where a wanted value lies: between ``low`` and ``high`` (neither included, None is open), after ``before`` values of its key."""

    key: str
    low: float | None
    high: float | None
    before: int


def _inside(rows: DataFrame, brackets: list[Bracket], cuts: list[list[float]] | None = None) -> DataFrame:
    """id (of the bracket), x and cuts of the values in any of ``brackets``, which are few and don't overlap."""
    table = [(i, b.key, b.low, b.high, cuts and cuts[i]) for i, b in enumerate(brackets)]
    small = rows.sparkSession.createDataFrame(table, "id int, of string, low double, high double, cuts array<double>")
    fits = (F.col("key") == F.col("of")) & (F.col("low").isNull() | (F.col("x") > F.col("low"))) & (F.col("high").isNull() | (F.col("x") < F.col("high")))
    return rows.join(F.broadcast(small), fits).select("id", "x", "cuts")


def values_of(*columns: Column, **named: Column) -> Column:
    """An array of structs (key, x): ``named`` columns, and ``columns`` that are such arrays themselves. Explode it with ``F.inline``."""
    own = F.array(*[F.struct(F.lit(k).alias("key"), c.cast("double").alias("x")) for k, c in named.items()])
    return F.concat(own, *columns) if columns else own


def order_statistics(rows: DataFrame, wanted: dict[str, list[int]], few: int = FEW, splitters: int = SPLITTERS) -> dict[tuple[str, int], float]:
    """The value at each wanted 0-based place among the values of its key; places outside are left out.

    ``rows``: key, x (double). Nulls and NaN don't count. ``rows`` is read about log(n) / log(splitters) times: give
    a checkpointed frame. A splitter is one of the values and is counted apart, so ties take no more passes.
    """
    rows = rows.filter("x IS NOT NULL AND NOT isnan(x)").select("key", F.col("x").cast("double").alias("x"))
    sizes = {r["key"]: r["count"] for r in rows.filter(F.col("key").isin(*wanted)).groupBy("key").count().collect()}
    found: dict[tuple[str, int], float] = {}
    open_at = {(k, p): Bracket(k, None, None, 0) for k, places in wanted.items() for p in places if 0 <= p < sizes.get(k, 0)}
    left = sum(sizes.get(k, 0) for k in {k for k, _ in open_at})
    while open_at:
        brackets = [*dict.fromkeys(open_at.values())]
        if left <= few:
            own: dict[int, list] = {}
            for r in _inside(rows, brackets).groupBy("id", "x").count().collect():
                own.setdefault(r["id"], []).append((r["x"], r["count"]))
            for (k, p), b in open_at.items():
                before = b.before
                for x, n in sorted(own[brackets.index(b)]):
                    before += n
                    if before > p:
                        found[k, p] = x
                        break
            return found
        points = F.array(*[F.lit((i + 1) / (splitters + 1)) for i in range(splitters)])
        cuts: list[list[float]] = [[] for _ in brackets]
        for r in _inside(rows, brackets).groupBy("id").agg(F.percentile_approx("x", points, 10_000).alias("cuts")).collect():
            cuts[r["id"]] = sorted(set(r["cuts"]))
        # slot 2 i lies before cut i, slot 2 i + 1 is the cut itself
        slot = 2 * F.size(F.filter("cuts", lambda c: c < F.col("x"))) + F.array_contains("cuts", F.col("x")).cast("int")
        counts: list[dict[int, int]] = [{} for _ in brackets]
        for r in _inside(rows, brackets, cuts).groupBy("id", slot.alias("slot")).count().collect():
            counts[r["id"]][r["slot"]] = r["count"]
        narrower, sizes_of = {}, {}
        for (k, p), b in open_at.items():
            i = brackets.index(b)
            before = b.before
            for s in sorted(counts[i]):
                if before + counts[i][s] > p:
                    break
                before += counts[i][s]
            if s % 2:
                found[k, p] = cuts[i][s // 2]
            else:
                at = s // 2
                inner = Bracket(k, cuts[i][at - 1] if at else b.low, cuts[i][at] if at < len(cuts[i]) else b.high, before)
                narrower[k, p], sizes_of[inner] = inner, counts[i][s]
        open_at, left = narrower, sum(sizes_of.values())
    return found


def percentiles(rows: DataFrame, wanted: dict[str, list[float]], few: int = FEW) -> dict[tuple[str, float], float | None]:
    """Percentiles (0 to 1) with linear interpolation between neighbours, for each key; None for a key without values.

    ``rows``: key, x, as for ``order_statistics``.
    """
    valid = rows.filter("x IS NOT NULL AND NOT isnan(x)")
    sizes = {r["key"]: r["count"] for r in valid.groupBy("key").count().collect()}  # one row a key
    place = {(k, p): p * (sizes[k] - 1) for k, points in wanted.items() for p in points if k in sizes}
    both: dict[str, list[int]] = {k: [] for k in wanted}
    for (k, _), at in place.items():
        both[k] += [floor(at), ceil(at)]
    value = order_statistics(rows, {k: sorted(set(v)) for k, v in both.items()}, few)
    out: dict[tuple[str, float], float | None] = {(k, p): None for k, points in wanted.items() for p in points}
    for (k, p), at in place.items():
        lo, hi = value[k, floor(at)], value[k, ceil(at)]
        out[k, p] = lo if lo == hi else (ceil(at) - at) * lo + (at - floor(at)) * hi
    return out


def running_sums(rows: DataFrame, by: Column, sums: list[str], per_part: int = 100_000) -> DataFrame:
    """``rows`` with each of ``sums`` replaced by its sum over all rows up to and with this one in the order ``by``.

    Rows are dealt to ranges of ``by``; sums run within a range, after the totals of the ranges before it.
    """
    from vetra.plans.session import cut

    parts = max(1, -(-rows.count() // per_part))
    dealt = cut(rows.repartitionByRange(parts, by).withColumn("part", F.spark_partition_id()))
    before, table = [0] * len(sums), []
    for r in dealt.groupBy("part").agg(*[F.sum(c).alias(c) for c in sums]).orderBy("part").collect():  # one row a range
        table.append((r["part"], *before))
        before = [b + (r[c] or 0) for b, c in zip(before, sums)]
    offsets = rows.sparkSession.createDataFrame(table, "part int, " + ", ".join(f"`{c}_before` long" for c in sums))
    upto = W.partitionBy("part").orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.join(F.broadcast(offsets), "part")
    return placed.withColumns({c: F.sum(c).over(upto) + F.col(f"{c}_before") for c in sums}).drop("part", *[f"{c}_before" for c in sums])
