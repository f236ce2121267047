"""Retrieval, classification, unknown detection, evidence and decision queries over ``embeddings``.

References are the first five vectors of each of the labels 0 to 5, class weights the first one; labels
6 and 7 stand for out-of-distribution calibration, 8 and 9 for its evaluation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from vetra.functions import canvas as C
from vetra.operators import retrieval as R
from vetra.operators import screening as S
from vetra.operators.clustering import kmeans_references as kmeans_references_of
from vetra.queries.base import E_SQL, embeddings, query

CAL, POL = S.Calibration(k=3, threshold=0.84, boundary=0.78, risk_intercept=-19.5), S.Policy(0.3, 0.22, 0.8)
MIN_BRIGHTNESS, MAX_CLIPPED = 0.49, 0.1


def references(spark, sf_dir):
    rows = R.first_per_class(embeddings(spark, sf_dir).filter("label < 6"), 5)
    name = F.concat(F.lit("c"), F.col("label").cast("string"))
    return rows.select(F.col("vec_id").alias("reference_id"), name.alias("class_name"), F.concat(F.lit("f"), (F.col("vec_id") % 4).cast("string")).alias("fragment_type"), "v")


def weights(spark, sf_dir):
    rows = R.first_per_class(embeddings(spark, sf_dir).filter("label < 6"), 1)
    return rows.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("class_name"), F.col("v").alias("w"))


def pixels():
    return F.transform("v", lambda x: F.least(F.greatest(F.round(x * 512 + 128), F.lit(0.0)), F.lit(255.0)))


def quality_passed(c):
    return [C.brightness(c) >= MIN_BRIGHTNESS, C.clipped_fraction(c) <= MAX_CLIPPED]


def samples(spark, sf_dir):
    """Vectors that are no references, with split, true class, fragment and quality."""
    refs = references(spark, sf_dir).select(F.col("reference_id").alias("vec_id"))
    rows = embeddings(spark, sf_dir).join(F.broadcast(refs), "vec_id", "left_anti")  # five a class
    split = F.when(F.col("label") >= 8, "ood_evaluation").when(F.col("label") >= 6, "ood_calibration")
    split = split.when(F.col("vec_id") % 3 == 0, "validation").when(F.col("vec_id") % 3 == 1, "test").otherwise("heldout_known")
    rows = rows.withColumns({
        "split": split, "true_class": F.concat(F.lit("c"), F.col("label").cast("string")),
        "fragment_type": F.concat(F.lit("f"), (F.col("vec_id") % 4).cast("string")), "c": pixels(),
    })
    passed = quality_passed(F.col("c"))
    fraction = reduce(lambda a, b: a + b, [F.when(p, 0.5).otherwise(0.0) for p in passed])
    failed = F.concat_ws(", ", *[F.when(~p, n) for p, n in zip(passed, ("brightness", "clipping"))])
    rows = rows.withColumns({"quality_fraction": fraction, "quality_failed": failed})
    return rows.withColumn("quality_status", F.when(F.col("quality_fraction") == 1.0, "ACCEPTABLE").otherwise("DEGRADED")).drop("c")


def screened(spark, sf_dir):
    return S.screen(samples(spark, sf_dir), references(spark, sf_dir), weights(spark, sf_dir), CAL, POL)


_SIG = f"(distance * {CAL.risk_slope}::DOUBLE + {CAL.risk_intercept}::DOUBLE)"
#: CTEs up to s: one row a sample with everything that is scored.
S_SQL = f"""WITH {E_SQL},
    refs AS (SELECT vec_id AS reference_id, 'c' || label AS cls, 'f' || (vec_id % 4) AS frag, v AS r, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS nth
        FROM e WHERE label < 6 QUALIFY nth <= 5),
    q AS (SELECT vec_id, v, label, CASE WHEN label >= 8 THEN 'ood_evaluation' WHEN label >= 6 THEN 'ood_calibration' WHEN vec_id % 3 = 0 THEN 'validation'
        WHEN vec_id % 3 = 1 THEN 'test' ELSE 'heldout_known' END AS split, 'c' || label AS true_class, 'f' || (vec_id % 4) AS fragment_type,
        [least(greatest(round(x * 512 + 128), 0.0::DOUBLE), 255.0::DOUBLE) FOR x IN v] AS c FROM e WHERE vec_id NOT IN (SELECT reference_id FROM refs)),
    qq AS (SELECT * EXCLUDE (c), concat_ws(', ', CASE WHEN list_sum(c) / 64 / 255 < {MIN_BRIGHTNESS}::DOUBLE THEN 'brightness' END, CASE WHEN len([x FOR x IN c IF x = 0 OR x = 255]) / 64::DOUBLE > {MAX_CLIPPED}::DOUBLE THEN 'clipping' END) AS quality_failed, (list_sum(c) / 64 / 255 >= {MIN_BRIGHTNESS}::DOUBLE)::INT * 0.5::DOUBLE + (len([x FOR x IN c IF x = 0 OR x = 255]) / 64::DOUBLE <= {MAX_CLIPPED}::DOUBLE)::INT * 0.5::DOUBLE AS quality_fraction FROM q),
    nn AS (SELECT vec_id, reference_id, cls, frag, list_inner_product(v, r) AS sim, row_number() OVER (PARTITION BY vec_id ORDER BY list_inner_product(v, r) DESC, reference_id) AS rank
        FROM qq, refs QUALIFY rank <= {CAL.k}),
    tot AS (SELECT vec_id, list_reduce(list(greatest(sim, 0) ORDER BY rank), lambda a, b: a + b) AS whole, list_reduce(list(sim ORDER BY rank), lambda a, b: a + b) AS sims,
        max(sim) AS top_similarity, arg_min(cls, rank) AS best, list(cls ORDER BY rank) AS classes FROM nn GROUP BY vec_id),
    sup AS (SELECT vec_id, cls, count(*) AS n, CASE WHEN any_value(whole) > 0 THEN list_reduce(list(greatest(sim, 0) ORDER BY rank), lambda a, b: a + b) / any_value(whole) ELSE 0 END AS share,
        cls <> any_value(best) AS other FROM nn JOIN tot USING (vec_id) GROUP BY vec_id, cls),
    sup2 AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY share DESC, other, cls) AS place FROM sup),
    lg AS (SELECT vec_id, cls, list_inner_product(v, r) * 10 AS z FROM qq, refs WHERE nth = 1),
    pr0 AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS p FROM lg),
    pr AS (SELECT vec_id, cls, p / sum(p) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, cls) AS place FROM pr0),
    s0 AS (SELECT qq.*, pr.cls AS predicted_class, pr.p AS confidence, sup2.cls AS retrieved_class, top_similarity, classes,
        1 - sims / {CAL.k} AS distance, coalesce(own.share, 0) AS reference_support
        FROM qq JOIN tot USING (vec_id) JOIN sup2 ON sup2.vec_id = qq.vec_id AND sup2.place = 1 JOIN pr ON pr.vec_id = qq.vec_id AND pr.place = 1
        LEFT JOIN sup own ON own.vec_id = qq.vec_id AND own.cls = pr.cls),
    s1 AS (SELECT *, CASE WHEN distance > {CAL.threshold}::DOUBLE THEN 'UNKNOWN' WHEN distance > {CAL.boundary}::DOUBLE THEN 'UNCERTAIN' ELSE 'KNOWN' END AS unknown_status,
        CASE WHEN {_SIG} >= 0 THEN 1 / (1 + exp(-{_SIG})) ELSE exp({_SIG}) / (1 + exp({_SIG})) END AS unknown_risk,
        CASE WHEN predicted_class <> retrieved_class THEN 'LOW' WHEN len([x FOR x IN classes IF x <> predicted_class]) = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS agreement,
        CASE WHEN quality_fraction = 1 THEN 'ACCEPTABLE' ELSE 'DEGRADED' END AS quality_status FROM s0),
    s2 AS (SELECT *, CASE WHEN least(confidence, reference_support, 1 - unknown_risk, quality_fraction) <= 0 THEN 0
        ELSE exp((ln(confidence) + ln(reference_support) + ln(1 - unknown_risk) + ln(quality_fraction)) / 4) END AS strength,
        confidence >= {POL.min_confidence}::DOUBLE AS ok_confidence, top_similarity >= {POL.min_similarity}::DOUBLE AS ok_similarity, unknown_risk <= {POL.max_risk}::DOUBLE AS ok_risk,
        agreement = 'HIGH' AS ok_agreement, quality_status = 'ACCEPTABLE' AS ok_quality FROM s1),
    s AS (SELECT *, CASE WHEN unknown_status = 'UNKNOWN' THEN 'UNKNOWN' WHEN ok_confidence AND ok_similarity AND ok_risk AND ok_agreement AND ok_quality THEN 'PASS' ELSE 'REVIEW' END AS decision FROM s2)
"""


@query(S_SQL + """SELECT vec_id, split, true_class, predicted_class, round(confidence, 8) AS confidence, retrieved_class, round(top_similarity, 8) AS top_similarity,
    round(distance, 8) AS distance, unknown_status, round(unknown_risk, 8) AS unknown_risk, agreement, round(strength, 8) AS strength, decision FROM s""")
def screen(spark, sf_dir):
    r = lambda c: F.round(c, 8).alias(c)
    return screened(spark, sf_dir).select("vec_id", "split", "true_class", "predicted_class", r("confidence"), "retrieved_class", r("top_similarity"), r("distance"), "unknown_status", r("unknown_risk"), "agreement", r("strength"), "decision")


@query(S_SQL + """SELECT vec_id, split, true_class, fragment_type, predicted_class, round(confidence, 8) AS confidence, retrieved_class, round(top_similarity, 8) AS top_similarity,
    array_to_string(classes, '|') AS reference_classes, agreement, round(distance, 8) AS distance, round(unknown_risk, 8) AS unknown_risk, unknown_status, quality_status, round(strength, 8) AS strength, decision FROM s""")
def scored(spark, sf_dir):
    """The fact table of evaluation."""
    r = lambda c: F.round(c, 8).alias(c)
    classes = F.array_join(F.transform("matches", lambda m: m["class_name"]), "|").alias("reference_classes")
    return screened(spark, sf_dir).select("vec_id", "split", "true_class", "fragment_type", "predicted_class", r("confidence"), "retrieved_class", r("top_similarity"), classes, "agreement", r("distance"), r("unknown_risk"), "unknown_status", "quality_status", r("strength"), "decision")


@query(S_SQL + "SELECT vec_id, rank::INT AS rank, reference_id, cls AS class_name, sim AS similarity FROM nn")
def knn_topk(spark, sf_dir):
    found = R.search(samples(spark, sf_dir), references(spark, sf_dir), CAL.k).select("vec_id", F.explode("matches").alias("m"))
    return found.select("vec_id", "m.rank", "m.reference_id", "m.class_name", "m.similarity")


@query(S_SQL + "SELECT vec_id, retrieved_class, round(top_similarity, 8) AS top_similarity, round(share, 8) AS weighted_share, n::INT AS n FROM s JOIN sup2 USING (vec_id) WHERE place = 1")
def class_vote(spark, sf_dir):
    rows = R.search(samples(spark, sf_dir), references(spark, sf_dir), CAL.k).select("vec_id", "matches", R.class_support(F.col("matches")).alias("s"))
    best = F.col("s")[0]
    return rows.select("vec_id", best["class_name"].alias("retrieved_class"), F.round(F.col("matches")[0]["similarity"], 8).alias("top_similarity"), F.round(best["weighted_share"], 8).alias("weighted_share"), best["count"].alias("n"))


@query(S_SQL + "SELECT vec_id, (place - 1)::INT AS place, cls AS class_name, n::INT AS n, round(share, 8) AS weighted_share FROM sup2")
def class_support(spark, sf_dir):
    rows = R.search(samples(spark, sf_dir), references(spark, sf_dir), CAL.k).select("vec_id", F.posexplode(R.class_support(F.col("matches"))).alias("place", "s"))
    return rows.select("vec_id", "place", "s.class_name", F.col("s.count").alias("n"), F.round("s.weighted_share", 8).alias("weighted_share"))


@query(S_SQL + "SELECT vec_id, (place - 1)::INT AS place, cls AS class_name, round(p, 8) AS probability FROM pr WHERE place <= 3")
def predict_topk(spark, sf_dir):
    rows = S.classify(samples(spark, sf_dir), weights(spark, sf_dir), 3, 10.0).select("vec_id", F.posexplode("top_k").alias("place", "t"))
    return rows.select("vec_id", "place", "t.class_name", F.round("t.probability", 8).alias("probability"))


def _columns(name: str, sql: str, columns):
    """A query that is a projection of the screened rows; ``columns`` makes the expressions within a session."""

    def run(spark, sf_dir):
        return screened(spark, sf_dir).select("vec_id", *columns())

    run.__name__ = name
    query(S_SQL + f"SELECT vec_id, {sql} FROM s")(run)


def _rounded(name: str):
    return lambda: [F.round(name, 8).alias(name)]


_columns("reference_distance", "round(distance, 8) AS distance", _rounded("distance"))
_columns("unknown_status", "unknown_status", lambda: ["unknown_status"])
_columns("unknown_risk", "round(unknown_risk, 8) AS unknown_risk", _rounded("unknown_risk"))
_columns("agreement", "agreement, predicted_class, retrieved_class", lambda: ["agreement", "predicted_class", "retrieved_class"])
_columns("reference_support", "round(reference_support, 8) AS reference_support", _rounded("reference_support"))
_columns("evidence_strength", "round(strength, 8) AS strength", _rounded("strength"))
_columns("decide", "decision", lambda: ["decision"])
_columns(
    "decision_checks", "ok_confidence, ok_similarity, ok_risk, ok_agreement, ok_quality",
    lambda: [F.col("checks")[i]["passed"].alias(f"ok_{n}") for i, n in enumerate(("confidence", "similarity", "risk", "agreement", "quality"))],
)


@query(S_SQL + """SELECT vec_id, CASE decision WHEN 'UNKNOWN' THEN 'outside the reference library' WHEN 'PASS' THEN 'all checks passed' ELSE
    'failed: ' || array_to_string(list_filter([CASE WHEN NOT ok_confidence THEN 'confidence' END, CASE WHEN NOT ok_similarity THEN 'similarity' END, CASE WHEN NOT ok_risk THEN 'risk' END,
    CASE WHEN NOT ok_agreement THEN 'agreement' END, CASE WHEN NOT ok_quality THEN 'quality' END], lambda x: x IS NOT NULL), ', ') END AS reason FROM s""")
def decision_reason(spark, sf_dir):
    return screened(spark, sf_dir).select("vec_id", "reason")


_SAID = {k: v.replace("'", "''") for k, v in S.SENTENCES.items()}


@query(S_SQL + f"""SELECT vec_id, concat_ws(' ', printf('{_SAID["prediction"]}', predicted_class, round_even(confidence * 100, 0)),
    printf('{_SAID["references"]}', len([x FOR x IN classes IF x = predicted_class]), len(classes), predicted_class, top_similarity),
    CASE WHEN agreement = 'LOW' THEN printf('{_SAID["conflict"]}', retrieved_class) ELSE printf('{_SAID["agreement"]}', lower(agreement)) END,
    CASE unknown_status WHEN 'UNKNOWN' THEN '{_SAID["UNKNOWN"]}' WHEN 'UNCERTAIN' THEN '{_SAID["UNCERTAIN"]}' ELSE '{_SAID["KNOWN"]}' END,
    CASE WHEN quality_status <> 'ACCEPTABLE' THEN printf('{_SAID["quality"]}', quality_failed) END) AS summary FROM s""")
def evidence_summary(spark, sf_dir):
    return screened(spark, sf_dir).select("vec_id", S.summary().alias("summary"))


_SHOWN = {"confidence": ("printf('%.3f', confidence)", f">= {POL.min_confidence:.3f}"), "similarity": ("printf('%.3f', top_similarity)", f">= {POL.min_similarity:.3f}"), "risk": ("printf('%.3f', unknown_risk)", f"<= {POL.max_risk:.3f}"), "agreement": ("agreement", "HIGH"), "quality": ("quality_status", "ACCEPTABLE")}


@query(S_SQL + " UNION ALL ".join(f"SELECT vec_id, '{k}' AS name, ok_{k} AS passed, {o} AS observed, '{r}' AS required FROM s" for k, (o, r) in _SHOWN.items()))
def decision_check_values(spark, sf_dir):
    """What each check observed and required."""
    return screened(spark, sf_dir).select("vec_id", F.explode("checks").alias("c")).select("vec_id", "c.name", "c.passed", "c.observed", "c.required")


@query()
def analysis_document(spark, sf_dir):
    """The nested response document of each sample."""
    doc = F.to_json(F.struct("vec_id", "decision", "reason", F.struct("predicted_class", "confidence", "top_k").alias("classifier"), F.struct("retrieved_class", "matches", "class_support").alias("retrieval"), F.struct("distance", "unknown_status", "unknown_risk").alias("unknown")))
    return screened(spark, sf_dir).select("vec_id", doc.alias("document"))


@query(S_SQL + "SELECT 'REF' || lpad((row_number() OVER (ORDER BY cls, reference_id))::VARCHAR, 4, '0') AS reference_id, row_number() OVER (ORDER BY cls, reference_id) - 1 AS vector_id, cls AS class_name, reference_id AS image_id FROM refs")
def reference_ids(spark, sf_dir):
    rows = references(spark, sf_dir).select(F.col("reference_id").alias("image_id"), "class_name")
    return R.number_references(rows).select("reference_id", "vector_id", "class_name", "image_id")


@query(S_SQL + """, m AS (SELECT label AS cluster, pos, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY ALL),
    g AS (SELECT cluster, list(x ORDER BY pos) AS centre FROM m GROUP BY cluster)
    SELECT label AS cluster, vec_id AS id, round(list_inner_product(v, centre), 9) AS score FROM e JOIN g ON label = cluster
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1""")
def medoid_per_cluster(spark, sf_dir):
    return R.medoids(embeddings(spark, sf_dir).select(F.col("label").alias("cluster"), F.col("vec_id").alias("id"), "v"))


@query()
def kmeans_references(spark, sf_dir):
    """Medoids of every class, of acceptable quality."""
    rows = embeddings(spark, sf_dir).filter("label < 6").withColumn("c", pixels())
    rows = rows.select(F.col("vec_id").alias("image_id"), F.col("label").cast("string").alias("class_name"), "v", reduce(lambda a, b: a & b, quality_passed(F.col("c"))).alias("acceptable"))
    return kmeans_references_of(rows, 4, acceptable=F.col("acceptable"))


@query(S_SQL + "SELECT cls AS class_name, frag AS fragment_type, count(*) AS n FROM refs GROUP BY ALL")
def selection_stats(spark, sf_dir):
    return references(spark, sf_dir).groupBy("class_name", "fragment_type").agg(F.count(F.lit(1)).alias("n"))


@query(S_SQL + "SELECT count(*) AS n, count(*) FILTER (retrieved_class = true_class)::DOUBLE / count(*) AS accuracy FROM s WHERE split = 'validation'")
def retrieval_accuracy(spark, sf_dir):
    rows = screened(spark, sf_dir).filter("split = 'validation'")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.count_if(F.col("retrieved_class") == F.col("true_class")), F.count(F.lit(1))).alias("accuracy"))


@query(S_SQL + ", n AS (SELECT 'REF' || lpad((row_number() OVER (ORDER BY cls, reference_id))::VARCHAR, 4, '0') AS rid, cls AS class_name, reference_id AS image_id FROM refs) SELECT rid AS reference_id, class_name, image_id FROM n WHERE rid = 'REF0007'")
def reference_lookup(spark, sf_dir):
    rows = references(spark, sf_dir).select(F.col("reference_id").alias("image_id"), "class_name")
    return R.number_references(rows).filter("reference_id = 'REF0007'").select("reference_id", "class_name", "image_id")
