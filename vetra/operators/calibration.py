"""Thresholds and fits: unknown detection, quality bounds, decision policy, classifier training."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetra.operators.selection import order_statistics, percentiles, running_sums, values_of


def order_statistic(rows: DataFrame, value: str, place: int) -> DataFrame:
    """One row: the value at 0-based ``place`` of all values; null where there are fewer."""
    found = order_statistics(rows.select(F.lit("x").alias("key"), F.col(value).cast("double").alias("x")), {"x": [place]})
    return rows.sparkSession.createDataFrame([(found.get(("x", place)),)], "x double")


def lower_quantile_place(q: float, n: int) -> int:
    """0-based place of the quantile that takes the lower neighbour."""
    return floor(q * (n - 1))


def select_threshold(known: DataFrame, ood: DataFrame, target: float) -> DataFrame:
    """boundary, threshold and acceptance rates. ``known`` and ``ood`` have distance.

    The boundary is the smallest known distance with ``target`` of the known at or under it; the
    threshold lies midway to the next out-of-distribution distance over it, or at the largest known.
    """
    n = known.count()
    boundary = order_statistic(known, "distance", ceil(target * n) - 1).withColumnRenamed("x", "boundary")
    top = known.agg(F.max("distance").alias("top"))
    over = ood.join(F.broadcast(boundary), F.col("distance") > F.col("boundary")).agg(F.min("distance").alias("over"))
    chosen = boundary.join(top).join(over).select("boundary", F.coalesce((F.col("boundary") + F.col("over")) / 2, F.col("top")).alias("threshold"))
    rate = lambda rows, name: rows.join(F.broadcast(chosen)).agg(F.try_divide(F.count_if(F.col("distance") <= F.col("threshold")), F.count(F.lit(1))).alias(name))
    return chosen.join(rate(known, "known_acceptance")).join(rate(ood, "ood_acceptance"))


def standardise(rows: DataFrame, value: str) -> DataFrame:
    stats = rows.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return rows.join(F.broadcast(stats)).withColumn("z", F.try_divide(F.col(value) - F.col("m"), F.col("s"))).drop("m", "s")


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """weight = n / (classes x n of the class)."""
    per = rows.groupBy(label).agg(F.count(F.lit(1)).alias("own"))
    whole = per.agg(F.sum("own").alias("n"), F.count(F.lit(1)).alias("k"))
    share = per.join(F.broadcast(whole)).select(label, (F.col("n") / (F.col("k") * F.col("own"))).alias("weight"))
    return rows.join(F.broadcast(share), label)


def fit_logistic(rows: DataFrame, features: str, label: str, c: float, max_iter: int = 200):
    """Balanced logistic regression with an L2 penalty of strength 1 / c on the sum of losses."""
    from pyspark.ml.classification import LogisticRegression

    weighted = balanced_weights(rows, label)
    n = rows.count()
    model = LogisticRegression(featuresCol=features, labelCol=label, weightCol="weight", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter)
    return model.fit(weighted)


def fit_risk(rows: DataFrame) -> tuple[float, float]:
    """intercept, slope of unknown risk in distance. ``rows``: distance, unknown (0 or 1)."""
    from pyspark.ml.feature import VectorAssembler

    m, s = rows.agg(F.avg("distance"), F.stddev_pop("distance")).first()
    scaled = VectorAssembler(inputCols=["z"], outputCol="x").transform(rows.withColumn("z", (F.col("distance") - m) / s))
    model = fit_logistic(scaled, "x", "unknown", 1.0)
    slope = float(model.coefficients[0]) / s
    return float(model.intercept) - slope * m, slope


def log_loss(rows: DataFrame, probability: Column, floor_at: float = 1e-15) -> DataFrame:
    return rows.agg(F.avg(-F.ln(F.greatest(probability, F.lit(floor_at)))).alias("log_loss"))


def select_min_confidence(rows: DataFrame, target: float) -> DataFrame:
    """The smallest observed confidence at or over which accuracy meets ``target``. ``rows``: confidence, ok.

    Rows are counted by distinct confidence first, and counts run over ranges of it. Where no confidence meets the target: 1, and no accuracy.
    """
    counted = rows.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("right"))
    running = running_sums(counted, F.desc("confidence"), ["n", "right"])
    whole = rows.agg(F.count(F.lit(1)).alias("all"))
    met = running.withColumn("accuracy", F.col("right") / F.col("n")).filter(F.col("accuracy") >= target)
    best = met.agg(F.min_by(F.struct("confidence", "accuracy", "n"), "confidence").alias("b")).join(whole)
    return best.select(
        F.coalesce("b.confidence", F.lit(1.0)).alias("min_confidence"), F.col("b.accuracy").alias("accuracy"),
        F.coalesce(F.try_divide(F.col("b.n"), F.col("all")), F.lit(0.0)).alias("coverage"), F.col("b").isNotNull().alias("met"),
    )


def describe(rows: DataFrame, value: str, points: dict[str, float]) -> DataFrame:
    """n, mean, least, most and the percentiles ``points`` of a column, as one row."""
    cuts = percentiles(rows.select(F.lit("x").alias("key"), F.col(value).cast("double").alias("x")), {"x": [*points.values()]})
    whole = rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return whole.select("n", *[F.round(c, 8).alias(c) for c in ("mean", "least", "most")], *[F.round(F.lit(cuts["x", p]).cast("double"), 8).alias(k) for k, p in points.items()])


def signal_percentiles(rows: DataFrame, coverage_of, wanted: dict[str, list[float]], tile_floor: float = 0.1) -> tuple[dict[tuple[str, float], float | None], float | None]:
    """Percentiles of quality signals (sharpness, brightness, clipped; coverage) of ``rows``, which has tiles, and the tiles' floor.

    All columns go through one selection; coverage needs the floor, which is a percentile of all rows' tiles, and follows in a second.
    """
    plain = {k: v for k, v in wanted.items() if k != "coverage"}
    tiles = F.transform("tiles", lambda t: F.struct(F.lit("tiles").alias("key"), t.cast("double").alias("x")))
    found = percentiles(rows.select(F.inline(values_of(tiles, **{k: F.col(k) for k in plain}))), plain | {"tiles": [tile_floor]})
    floor_at = found.pop(("tiles", tile_floor))
    covered = rows.select(F.lit("coverage").alias("key"), coverage_of(F.col("tiles"), F.lit(floor_at).cast("double")).alias("x"))
    return found | percentiles(covered, {"coverage": wanted["coverage"]}), floor_at


def quality_bounds(rows: DataFrame, coverage_of) -> DataFrame:
    """Bounds from training rows (sharpness, brightness, clipped, tiles), as one row: first and last percentiles, and a
    floor for tiles pooled over all rows, from which the coverage bound follows in a second pass."""
    q, floor_at = signal_percentiles(rows, coverage_of, {"sharpness": [0.01], "brightness": [0.01, 0.99], "clipped": [0.99], "coverage": [0.01]})
    bounds = {
        "sharpness_min": q["sharpness", 0.01], "brightness_min": q["brightness", 0.01], "brightness_max": q["brightness", 0.99],
        "clipped_max": q["clipped", 0.99], "tile_floor": floor_at, "coverage_min": q["coverage", 0.01],
    }
    return rows.sparkSession.createDataFrame([tuple(bounds.values())], ", ".join(f"{k} double" for k in bounds))


def quality_checks(bounds: dict[str, float]) -> Column:
    """The six checks over columns side, sharpness, brightness, clipped, coverage: name, passed."""
    b = bounds
    rows = [
        ("resolution", F.col("side") >= b["min_side"]), ("focus", F.col("sharpness") >= b["sharpness_min"]),
        ("too_dark", F.col("brightness") >= b["brightness_min"]), ("too_bright", F.col("brightness") <= b["brightness_max"]),
        ("clipping", F.col("clipped") <= b["clipped_max"]), ("detail", F.col("coverage") >= b["coverage_min"]),
    ]
    return F.array(*[F.struct(F.lit(n).alias("name"), c.alias("passed")) for n, c in rows])
