"""Calibration queries: unknown thresholds, quality bounds, decision policy, classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetra.functions import canvas as C
from vetra.operators import calibration as A
from vetra.operators import screening as S
from vetra.queries.base import P_SQL, canvases, embeddings, query
from vetra.queries.screening import CAL, S_SQL, samples, screened, weights
from vetra.queries.vectors import _laplacian_sql, _tile_sql


def _distances(spark, sf_dir, where):
    """Computed once: thresholds read them several times."""
    from vetra.plans.session import cut

    return cut(screened(spark, sf_dir).filter(where).select(F.round("distance", 9).alias("distance")))


_KNOWN, _OOD = "split = 'validation'", "split = 'ood_calibration'"
_KO = S_SQL + f", k AS (SELECT round(distance, 9) AS distance FROM s WHERE {_KNOWN}), o AS (SELECT round(distance, 9) AS distance FROM s WHERE {_OOD}) "


@query(_KO + """, b AS (SELECT (list_sort(list(distance)))[ceil(0.95::DOUBLE * count(*))::INT] AS boundary, max(distance) AS top FROM k),
    t AS (SELECT boundary, coalesce((boundary + (SELECT min(distance) FROM o WHERE distance > boundary)) / 2, top) AS threshold FROM b)
    SELECT boundary, round(threshold, 8) AS threshold, (SELECT count(*) FILTER (distance <= threshold)::DOUBLE / count(*) FROM k) AS known_acceptance, (SELECT count(*) FILTER (distance <= threshold)::DOUBLE / count(*) FROM o) AS ood_acceptance FROM t""")
def select_threshold(spark, sf_dir):
    out = A.select_threshold(_distances(spark, sf_dir, _KNOWN), _distances(spark, sf_dir, _OOD), 0.95)
    return out.withColumn("threshold", F.round("threshold", 8))


_POINTS = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
_DESCRIBE = "count({0}) AS n, round(avg({0}), 8) AS mean, round(min({0}), 8) AS least, round(max({0}), 8) AS most, " + ", ".join(f"round(quantile_cont({{0}}, {v}), 8) AS {k}" for k, v in _POINTS.items())


@query(_KO + "SELECT " + _DESCRIBE.format("distance") + " FROM k")
def describe_distances(spark, sf_dir):
    return A.describe(_distances(spark, sf_dir, _KNOWN), "distance", _POINTS)


@query("SELECT " + _DESCRIBE.format("o_totalprice") + " FROM orders")
def describe(spark, sf_dir):
    return A.describe(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice", _POINTS)


@query(_KO + ", st AS (SELECT avg(distance) AS m, stddev_pop(distance) AS sd FROM k) SELECT round(distance, 8) AS distance, round((distance - m) / sd, 6) AS z FROM k, st")
def standardise(spark, sf_dir):
    return A.standardise(_distances(spark, sf_dir, _KNOWN), "distance").select(F.round("distance", 8).alias("distance"), F.round("z", 6).alias("z"))


@query()
def fit_risk(spark, sf_dir):
    rows = screened(spark, sf_dir).filter(f"{_KNOWN} OR {_OOD}").select("distance", F.expr(f"CAST({_OOD} AS double)").alias("unknown"))
    return spark.createDataFrame([A.fit_risk(rows)], "intercept double, slope double")


@query(f"SELECT round(1 / (1 + exp(-({CAL.boundary} * {CAL.risk_slope} + {CAL.risk_intercept})::DOUBLE)), 8) AS max_risk")
def max_risk(spark, sf_dir):
    return spark.range(1).select(F.round(S.risk(F.lit(CAL.boundary), CAL), 8).alias("max_risk"))


@query(S_SQL + """, r AS (SELECT round(confidence, 6) AS confidence, predicted_class = true_class AS ok FROM s WHERE split = 'validation'),
    c AS (SELECT confidence, sum(count(*)) OVER w AS n, sum(count(*) FILTER (ok)) OVER w AS good FROM r GROUP BY confidence WINDOW w AS (ORDER BY confidence DESC)),
    m AS (SELECT min(confidence) AS confidence, arg_min(good / n::DOUBLE, confidence) AS accuracy, arg_min(n, confidence) AS n FROM c WHERE good / n::DOUBLE >= 0.25)
    SELECT coalesce(confidence, 1) AS min_confidence, accuracy, coalesce(n / (SELECT count(*) FROM r)::DOUBLE, 0) AS coverage, confidence IS NOT NULL AS met FROM m""")
def select_min_confidence(spark, sf_dir):
    rows = screened(spark, sf_dir).filter(_KNOWN).select(F.round("confidence", 6).alias("confidence"), (F.col("predicted_class") == F.col("true_class")).alias("ok"))
    return A.select_min_confidence(rows, 0.25)


@query(S_SQL + """, r AS (SELECT round(top_similarity, 9) AS x FROM s WHERE split = 'validation' AND predicted_class = true_class)
    SELECT count(*) AS n, (list_sort(list(x)))[floor((1.0::DOUBLE - 0.95::DOUBLE) * (count(*) - 1))::INT + 1] AS min_similarity FROM r""")
def min_similarity(spark, sf_dir):
    from vetra.plans.session import cut

    rows = cut(screened(spark, sf_dir).filter(_KNOWN).filter("predicted_class = true_class").select(F.round("top_similarity", 9).alias("x")))
    n = rows.count()
    return A.order_statistic(rows, "x", A.lower_quantile_place(1.0 - 0.95, n)).select(F.lit(n).cast("long").alias("n"), F.col("x").alias("min_similarity"))


def measured(spark, sf_dir):
    """side, sharpness, brightness, clipped, tiles of every canvas, rounded."""
    c = F.col("c")
    tiles = F.transform(C.tile_sharpness(c, 8, 8, 3), lambda x: F.round(x, 6))
    return canvases(spark, sf_dir).select("vec_id", F.lit(8).alias("side"), F.round(C.laplacian_variance(c, 8, 8), 6).alias("sharpness"), F.round(C.brightness(c), 8).alias("brightness"), C.clipped_fraction(c).alias("clipped"), tiles.alias("tiles"))


_M_SQL = f"""WITH {P_SQL}, lv AS (SELECT vec_id, {_laplacian_sql('c', 8, 8)} AS w FROM p), tl AS ({' UNION ALL '.join(_tile_sql(k) for k in range(9))}),
    tv AS (SELECT vec_id, tile, round(list_var_pop(w), 6) AS t FROM tl),
    me AS MATERIALIZED (SELECT p.vec_id, 8 AS side, round(list_var_pop(w), 6) AS sharpness, round(list_sum(c) / 64 / 255, 8) AS brightness, len([x FOR x IN c IF x = 0 OR x = 255])::DOUBLE / 64 AS clipped FROM p JOIN lv USING (vec_id)) """
_B_SQL = _M_SQL + """, fl AS (SELECT quantile_cont(t, 0.1) AS tile_floor FROM tv), cv AS (SELECT vec_id, count(*) FILTER (t >= tile_floor)::DOUBLE / count(*) AS coverage FROM tv, fl GROUP BY vec_id) """


@query(_B_SQL + """SELECT (SELECT round(quantile_cont(sharpness, 0.01), 6) FROM me) AS sharpness_min, (SELECT round(quantile_cont(brightness, 0.01), 8) FROM me) AS brightness_min,
    (SELECT round(quantile_cont(brightness, 0.99), 8) FROM me) AS brightness_max, (SELECT round(quantile_cont(clipped, 0.99), 8) FROM me) AS clipped_max,
    (SELECT round(tile_floor, 6) FROM fl) AS tile_floor, (SELECT round(quantile_cont(coverage, 0.01), 8) FROM cv) AS coverage_min""")
def quality_bounds(spark, sf_dir):
    digits = {"sharpness_min": 6, "tile_floor": 6}
    from vetra.plans.session import cut

    out = A.quality_bounds(cut(measured(spark, sf_dir)), C.coverage)
    return out.select(*[F.round(c, digits.get(c, 8)).alias(c) for c in out.columns])


_SIGNALS = {"sharpness": "me", "brightness": "me", "clipped": "me", "coverage": "cv"}


@query(_B_SQL + " UNION ALL ".join(f"SELECT '{s}' AS signal, " + ", ".join(f"round(quantile_cont({s}, {p / 100}), 6) AS p{p}" for p in (1, 5, 50, 95, 99)) + f" FROM {t}" for s, t in _SIGNALS.items()))
def quality_distribution(spark, sf_dir):
    """All four signals by one selection each of values and of coverage, a row a signal."""
    from vetra.plans.session import cut

    points = (1, 5, 50, 95, 99)
    q, _ = A.signal_percentiles(cut(measured(spark, sf_dir)), C.coverage, {s: [p / 100 for p in points] for s in _SIGNALS})
    rows = [(s, *[q[s, p / 100] for p in points]) for s in _SIGNALS]
    return spark.createDataFrame(rows, "signal string, " + ", ".join(f"p{p} double" for p in points)).select("signal", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in points])


BOUNDS = {"min_side": 8, "sharpness_min": 30000.0, "brightness_min": 0.48, "brightness_max": 0.53, "clipped_max": 0.1, "coverage_min": 0.8}
_CHECKS = {"resolution": "side >= 8", "focus": "sharpness >= 30000", "too_dark": "brightness >= 0.48::DOUBLE", "too_bright": "brightness <= 0.53::DOUBLE", "clipping": "clipped <= 0.1::DOUBLE", "detail": "coverage >= 0.8::DOUBLE"}
_Q_SQL = _M_SQL + ", qc AS (SELECT me.*, cov.coverage FROM me JOIN (SELECT vec_id, count(*) FILTER (t >= 9000)::DOUBLE / count(*) AS coverage FROM tv GROUP BY vec_id) cov USING (vec_id)) "


def _checked(spark, sf_dir):
    rows = measured(spark, sf_dir).withColumn("coverage", C.coverage(F.col("tiles"), F.lit(9000.0)))
    return rows.withColumn("checks", A.quality_checks(BOUNDS))


@query(_Q_SQL + "SELECT vec_id, " + ", ".join(f"{v} AS {k}" for k, v in _CHECKS.items()) + " FROM qc")
def quality_checks(spark, sf_dir):
    return _checked(spark, sf_dir).select("vec_id", *[F.col("checks")[i]["passed"].alias(n) for i, n in enumerate(_CHECKS)])


@query(_Q_SQL + ", n AS (SELECT vec_id, " + " + ".join(f"({v})::INT" for v in _CHECKS.values()) + " AS n FROM qc) SELECT vec_id, CASE WHEN n = 6 THEN 'ACCEPTABLE' ELSE 'DEGRADED' END AS status, n / 6::DOUBLE AS passed_fraction FROM n")
def quality_status(spark, sf_dir):
    passed = lambda c: c["passed"]
    fraction = F.size(F.filter("checks", passed)) / F.size("checks").cast("double")
    return _checked(spark, sf_dir).select("vec_id", F.when(F.forall("checks", passed), "ACCEPTABLE").otherwise("DEGRADED").alias("status"), fraction.alias("passed_fraction"))


@query("SELECT label AS class_label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT 'c' || label AS label FROM embeddings)")
def label_encode(spark, sf_dir):
    from pyspark.sql import Window as W

    classes = embeddings(spark, sf_dir).select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("class_label")).distinct()
    return classes.withColumn("code", (F.dense_rank().over(W.orderBy("class_label")) - 1).cast("long"))


@query(S_SQL + ", t AS (SELECT pr.p FROM qq JOIN pr USING (vec_id) WHERE cls = true_class) SELECT count(*) AS n, round(avg(-ln(greatest(p, 1e-15::DOUBLE))), 8) AS log_loss FROM t")
def log_loss(spark, sf_dir):
    rows = S.classify(samples(spark, sf_dir), weights(spark, sf_dir), 100, 10.0).select("true_class", F.explode("top_k").alias("t")).filter("t.class_name = true_class")
    return A.log_loss(rows, F.col("t.probability")).select(F.lit(rows.count()).cast("long").alias("n"), F.round("log_loss", 8).alias("log_loss"))


@query(S_SQL + "SELECT true_class AS class_name, split, count(*) AS images FROM s GROUP BY ALL")
def train_counts(spark, sf_dir):
    return samples(spark, sf_dir).groupBy(F.col("true_class").alias("class_name"), "split").agg(F.count(F.lit(1)).alias("images"))


_GRID = [(0.1, 0.52), (1.0, 0.48), (10.0, 0.48), (100.0, 0.61)]


@query("SELECT min(struct_pack(loss := l, c := c)).c AS c, min(l) AS log_loss FROM (VALUES " + ", ".join(f"({c}::DOUBLE, {v}::DOUBLE)" for c, v in _GRID) + ") AS g(c, l)")
def select_min_struct(spark, sf_dir):
    return spark.createDataFrame(_GRID, "c double, log_loss double").agg(F.min(F.struct("log_loss", "c")).alias("m")).select("m.c", "m.log_loss")


def _training(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    return embeddings(spark, sf_dir).filter("label < 6").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector("v").alias("x"))


@query()
def logreg_train_score(spark, sf_dir):
    """Fitted on two thirds of the labelled vectors, until the fit settles; the predictions for the other third."""
    rows = _training(spark, sf_dir)
    return A.fit_logistic(rows.filter("vec_id % 3 <> 0"), "x", "label", 1.0, 5_000).transform(rows.filter("vec_id % 3 = 0")).select("vec_id", "prediction")


@query()
def select_c(spark, sf_dir):
    """The strength of least log-loss on the held-out third, of the whole grid."""
    from vetra.operators import crossvalidation as X
    from vetra.queries.evaluation import GRID

    rows = embeddings(spark, sf_dir).filter("label < 6").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), "v", F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1).alias("fold"))
    return X.best(X.by_strength(X.out_of_fold(rows, 1, GRID, 6))).select("c", "log_loss")


def calibrated(spark, sf_dir):
    """Calibration and policy of the screening chain, fitted on its validation and out-of-distribution sets."""
    from vetra.plans.session import cut
    from vetra.queries.screening import POL

    rows = cut(screened(spark, sf_dir).filter(f"{_KNOWN} OR {_OOD}").select("split", "distance", "top_similarity", F.round("confidence", 6).alias("confidence"), (F.col("predicted_class") == F.col("true_class")).alias("ok")))
    known, outside = rows.filter(_KNOWN), rows.filter(_OOD)
    limit = A.select_threshold(known, outside, 0.95).first()
    intercept, slope = A.fit_risk(rows.select("distance", F.expr(f"CAST({_OOD} AS double)").alias("unknown")))
    c = S.Calibration(CAL.k, limit["threshold"], limit["boundary"], intercept, slope)
    right = known.filter("ok").select(F.col("top_similarity").alias("x"))
    similarity = A.order_statistic(right, "x", A.lower_quantile_place(1.0 - 0.95, right.count())).first()["x"]
    confidence = A.select_min_confidence(known.select("confidence", "ok"), 0.25).first()["min_confidence"]
    most = spark.range(1).select(S.risk(F.lit(c.boundary), c)).first()[0]
    return c, S.Policy(confidence, POL.min_similarity if similarity is None else similarity, most)


@query()
def screen_calibrated(spark, sf_dir):
    """The screening chain on thresholds that its own calibration sets give."""
    from vetra.queries.screening import references

    c, p = calibrated(spark, sf_dir)
    out = S.screen(samples(spark, sf_dir), references(spark, sf_dir), weights(spark, sf_dir), c, p)
    return out.select("vec_id", "split", "true_class", "predicted_class", "distance", "unknown_status", "unknown_risk", "agreement", "strength", "decision")
