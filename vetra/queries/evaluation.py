"""Evaluation, experiment, history and release queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vetra.operators import evaluation as V
from vetra.operators import folds as D
from vetra.operators import release as L
from vetra.queries.base import E_SQL, INV_SQL, embeddings, inventory_rows, query
from vetra.queries.screening import S_SQL, references, screened
from vetra.sources.tables import read

LABELS = [f"c{i}" for i in range(6)]
_LIST = ", ".join(f"'{x}'" for x in LABELS)
_HIT = "predicted_class = true_class"
_METRICS = f""", pc AS (SELECT lab AS label, count(*) FILTER (true_class = lab AND predicted_class = lab) AS hit, count(*) FILTER (predicted_class = lab) AS said, count(*) FILTER (true_class = lab) AS support
        FROM s, (SELECT unnest([{_LIST}]) AS lab) WHERE split = 'test' GROUP BY lab),
    pm AS (SELECT label, support, coalesce(hit::DOUBLE / nullif(said, 0), 0) AS precision, coalesce(hit::DOUBLE / nullif(support, 0), 0) AS recall FROM pc),
    pf AS (SELECT *, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM pm) """


@query(S_SQL + _METRICS + "SELECT * FROM pf")
def classification_metrics(spark, sf_dir):
    out = V.per_class_metrics(screened(spark, sf_dir).filter("split = 'test'"), LABELS)
    return out.select("label", F.col("support").cast("long").alias("support"), "precision", "recall", "f1")


@query(S_SQL + _METRICS + f"SELECT (SELECT count(*) FILTER ({_HIT})::DOUBLE / count(*) FROM s WHERE split = 'test') AS accuracy, round(avg(f1), 8) AS macro_f1 FROM pf")
def macro_metrics(spark, sf_dir):
    rows = screened(spark, sf_dir).filter("split = 'test'")
    f1 = V.per_class_metrics(rows, LABELS).agg(F.round(F.avg("f1"), 8).alias("macro_f1"))
    return rows.agg(V.rate(F.expr(_HIT)).alias("accuracy")).join(F.broadcast(f1))


@query(S_SQL + f"SELECT lab AS true_class, {', '.join(f'count(*) FILTER (predicted_class = {x!r}) AS {x}' for x in LABELS)} FROM (SELECT unnest([{_LIST}]) AS lab) LEFT JOIN s ON true_class = lab AND split = 'test' GROUP BY lab")
def confusion_matrix(spark, sf_dir):
    return V.confusion(screened(spark, sf_dir).filter("split = 'test'").select("true_class", "predicted_class"), LABELS)


@query(S_SQL + "SELECT split, " + ", ".join(f"count(*) FILTER (list_contains(classes[1:{n}], true_class))::DOUBLE / count(*) AS hit_{n}" for n in (1, 3, 5)) + ", count(*) FILTER (retrieved_class = true_class)::DOUBLE / count(*) AS retrieved_accuracy FROM s WHERE label < 6 GROUP BY split")
def retrieval_metrics(spark, sf_dir):
    classes = F.transform("matches", lambda m: m["class_name"])
    hits = [V.rate(F.array_contains(F.slice(classes, 1, n), F.col("true_class"))).alias(f"hit_{n}") for n in (1, 3, 5)]
    return screened(spark, sf_dir).filter("label < 6").groupBy("split").agg(*hits, V.rate(F.col("retrieved_class") == F.col("true_class")).alias("retrieved_accuracy"))


def _rates(name: str, rates: dict[str, str], extra: str = ""):
    """A query of conditional rates by split: one aggregation."""

    def run(spark, sf_dir):
        return screened(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"), *[V.rate(F.expr(v)).alias(k) for k, v in rates.items()])

    run.__name__ = name
    query(S_SQL + "SELECT split, count(*) AS n, " + ", ".join(f"count(*) FILTER ({v})::DOUBLE / count(*) AS {k}" for k, v in rates.items()) + " FROM s GROUP BY split")(run)


_rates("unknown_metrics", {"acceptance": "unknown_status <> 'UNKNOWN'", "rejection": "unknown_status = 'UNKNOWN'", "uncertain": "unknown_status = 'UNCERTAIN'", "known": "unknown_status = 'KNOWN'"})
_rates("agreement_quality_rates", {"high": "agreement = 'HIGH'", "medium": "agreement = 'MEDIUM'", "low": "agreement = 'LOW'", "degraded": "quality_status <> 'ACCEPTABLE'"})

_DECISIONS = ("PASS", "REVIEW", "UNKNOWN")


@query(S_SQL + "SELECT split, " + ", ".join(f"count(*) FILTER (decision = '{d}') AS {d.lower()}" for d in _DECISIONS) + " FROM s GROUP BY split")
def decision_counts(spark, sf_dir):
    out = screened(spark, sf_dir).groupBy("split").pivot("decision", list(_DECISIONS)).count().na.fill(0)
    return out.select("split", *[F.col(d).alias(d.lower()) for d in _DECISIONS])


_OUTCOMES = {
    "passed_right": f"decision = 'PASS' AND {_HIT}", "passed_wrong": f"decision = 'PASS' AND NOT {_HIT}", "reviewed_right": f"decision = 'REVIEW' AND {_HIT}",
    "reviewed_wrong": f"decision = 'REVIEW' AND NOT {_HIT}", "unknown_right": f"decision = 'UNKNOWN' AND {_HIT}", "unknown_wrong": f"decision = 'UNKNOWN' AND NOT {_HIT}",
}


@query(S_SQL + "SELECT split, " + ", ".join(f"count(*) FILTER ({v}) AS {k}" for k, v in _OUTCOMES.items()) + " FROM s GROUP BY split")
def decision_outcomes(spark, sf_dir):
    return screened(spark, sf_dir).groupBy("split").agg(*[F.count_if(F.expr(v)).alias(k) for k, v in _OUTCOMES.items()])


_SETS = {
    ("known_material", "correct_pass"): f"known AND decision = 'PASS' AND {_HIT}", ("known_material", "false_pass_wrong_class"): f"known AND decision = 'PASS' AND NOT {_HIT}",
    ("known_material", "review_when_classifier_wrong"): f"known AND decision = 'REVIEW' AND NOT {_HIT}", ("known_material", "review_when_classifier_right"): f"known AND decision = 'REVIEW' AND {_HIT}",
    ("known_material", "false_unknown"): "known AND decision = 'UNKNOWN'", ("known_material", "samples"): "known",
    ("ood", "correct_unknown"): "NOT known AND decision = 'UNKNOWN'", ("ood", "false_pass"): "NOT known AND decision = 'PASS'", ("ood", "review"): "NOT known AND decision = 'REVIEW'", ("ood", "samples"): "NOT known",
}
_POOLED = "SELECT *, split IN ('test', 'heldout_known') AS known FROM s WHERE split IN ('test', 'heldout_known', 'ood_evaluation')"


@query(S_SQL + f", pooled AS ({_POOLED}) " + " UNION ALL ".join(f"SELECT '{a}' AS material, '{b}' AS outcome, count(*) FILTER ({v}) AS n FROM pooled" for (a, b), v in _SETS.items()))
def outcome_sets(spark, sf_dir):
    """Outcomes of known material, pooled, and of what lies outside: one pass, then turned into rows."""
    rows = screened(spark, sf_dir).filter("split IN ('test', 'heldout_known', 'ood_evaluation')").withColumn("known", F.col("split") != "ood_evaluation")
    counted = rows.agg(*[F.count_if(F.expr(v)).alias(f"n{i}") for i, v in enumerate(_SETS.values())])
    turned = F.array(*[F.struct(F.lit(a).alias("material"), F.lit(b).alias("outcome"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(_SETS)])
    return counted.select(F.explode(turned).alias("r")).select("r.*")


_CUTS = (5, 25, 50, 75, 95)


@query(S_SQL + "SELECT split, count(*) AS n, count(*) FILTER (unknown_status <> 'UNKNOWN')::DOUBLE / count(*) AS accepted, round(avg(distance), 8) AS mean, round(min(distance), 8) AS least, round(max(distance), 8) AS most, " + ", ".join(f"round(quantile_cont(distance, {p / 100}), 8) AS p{p}" for p in _CUTS) + " FROM s GROUP BY split")
def distance_distributions(spark, sf_dir):
    """Distances of every set, and what is accepted of it; outside known sets that is false acceptance."""
    from vetra.operators.selection import percentiles
    from vetra.plans.session import cut

    rows = cut(screened(spark, sf_dir).select("split", "unknown_status", "distance"))
    stats = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), V.rate(F.col("unknown_status") != "UNKNOWN").alias("accepted"), F.avg("distance").alias("mean"), F.min("distance").alias("least"), F.max("distance").alias("most"))
    splits = [r["split"] for r in stats.select("split").collect()]
    q = percentiles(rows.select(F.col("split").alias("key"), F.col("distance").alias("x")), {k: [p / 100 for p in _CUTS] for k in splits})
    cuts = spark.createDataFrame([(k, *[q[k, p / 100] for p in _CUTS]) for k in splits], "split string, " + ", ".join(f"p{p} double" for p in _CUTS))
    rounded = [F.round(c, 8).alias(c) for c in ("mean", "least", "most", *[f"p{p}" for p in _CUTS])]
    return stats.join(F.broadcast(cuts), "split").select("split", "n", "accepted", *rounded)  # one row a split


_OK = ("confidence", "similarity", "risk", "agreement", "quality")
_SYSTEMS = {"A": "true", "B": "ok_confidence", "C": "ok_confidence AND unknown_status <> 'UNKNOWN'", "D": "decision = 'PASS'"}


@query(S_SQL + " UNION ALL ".join(f"SELECT '{k}' AS system, split, count(*) FILTER ({v})::DOUBLE / count(*) AS acceptance, count(*) FILTER (({v}) AND {_HIT})::DOUBLE / nullif(count(*) FILTER ({v}), 0) AS precision, count(*) FILTER (({v}) AND NOT {_HIT}) AS wrong_accepted FROM s GROUP BY split" for k, v in _SYSTEMS.items()))
def ablation(spark, sf_dir):
    rows = screened(spark, sf_dir).withColumn("ok_confidence", F.col("checks")[0]["passed"])
    return V.ablation(rows, {k: F.expr(v) for k, v in _SYSTEMS.items()})


@query(S_SQL + f"""SELECT split, count(*) FILTER (fragment_type IN (SELECT frag FROM refs)) AS covered, count(*) AS n, count(*) FILTER (decision = 'PASS' AND {_HIT})::DOUBLE / nullif(count(*) FILTER (decision = 'PASS'), 0) AS pass_precision,
    count(*) FILTER (decision <> 'PASS' AND NOT {_HIT}) AS stopped_wrong FROM s GROUP BY split""")
def findings_numbers(spark, sf_dir):
    known = references(spark, sf_dir).select(F.col("fragment_type")).distinct().withColumn("in_library", F.lit(True))
    rows = screened(spark, sf_dir).join(F.broadcast(known), "fragment_type", "left")
    hit = F.expr(_HIT)
    passed = F.col("decision") == "PASS"
    return rows.groupBy("split").agg(F.count_if(F.col("in_library")).alias("covered"), F.count(F.lit(1)).alias("n"), F.try_divide(F.count_if(passed & hit), F.count_if(passed)).alias("pass_precision"), F.count_if(~passed & ~hit).alias("stopped_wrong"))


@query(S_SQL + """SELECT 'strongest_pass' AS "case", vec_id, decision FROM (SELECT * FROM s WHERE decision = 'PASS' ORDER BY round(strength, 9) DESC, vec_id LIMIT 1)
    UNION ALL SELECT 'most_confident_conflict', vec_id, decision FROM (SELECT * FROM s WHERE agreement = 'LOW' ORDER BY round(confidence, 9) DESC, vec_id LIMIT 1)
    UNION ALL SELECT 'least_similar_unknown', vec_id, decision FROM (SELECT * FROM s WHERE decision = 'UNKNOWN' ORDER BY round(distance, 9) DESC, vec_id LIMIT 1)""")
def demo_cases(spark, sf_dir):
    rows = screened(spark, sf_dir)
    down = lambda c: F.desc(F.round(c, 9))
    cases = [
        V.pick(rows, "strongest_pass", F.col("decision") == "PASS", down("strength"), F.col("vec_id")),
        V.pick(rows, "most_confident_conflict", F.col("agreement") == "LOW", down("confidence"), F.col("vec_id")),
        V.pick(rows, "least_similar_unknown", F.col("decision") == "UNKNOWN", down("distance"), F.col("vec_id")),
    ]
    return cases[0].unionByName(cases[1]).unionByName(cases[2]).select("case", "vec_id", "decision")


# Experiments


FOLDS, GRID = 5, (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)
#: CTEs up to fo(group_id, fold): groups of labelled vectors (ids in runs of three), with their first class.
_FOLDS = f"""WITH {E_SQL}, dv AS (SELECT vec_id, v, label, 'g' || (vec_id // 3) AS group_id FROM e WHERE label < 6),
    gp AS (SELECT group_id, min('c' || label) AS class_name, count(*) AS size FROM dv GROUP BY group_id),
    od AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY size DESC, md5('cv' || group_id), group_id) - 1 AS nth FROM gp),
    fo AS (SELECT group_id, (CASE WHEN (nth // {FOLDS}) % 2 = 0 THEN nth % {FOLDS} ELSE {FOLDS} - 1 - nth % {FOLDS} END)::INT AS fold FROM od) """


def _development(spark, sf_dir):
    rows = embeddings(spark, sf_dir).filter("label < 6")
    return rows.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), "v", F.concat(F.lit("g"), F.floor(F.col("vec_id") / 3).cast("string")).alias("group_id"))


def _folds(spark, sf_dir):
    name = F.concat(F.lit("c"), F.col("label").cast("string"))
    return V.group_folds(_development(spark, sf_dir).groupBy("group_id").agg(F.min(name).alias("class_name"), F.count(F.lit(1)).alias("size")), FOLDS)


@query(_FOLDS + "SELECT group_id, fold FROM fo")
def group_kfold(spark, sf_dir):
    return _folds(spark, sf_dir)


@query(_FOLDS + "SELECT fold, label::BIGINT AS label, count(*) AS images, count(DISTINCT group_id) AS groups FROM dv JOIN fo USING (group_id) GROUP BY ALL")
def group_kfold_balance(spark, sf_dir):
    """Images and groups of every class in every fold."""
    rows = _development(spark, sf_dir).join(_folds(spark, sf_dir), "group_id")
    return rows.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("images"), F.count_distinct("group_id").alias("groups"))


#: CTEs up to sg(group_id, fold): groups of equal class counts dealt evenly, the others placed one by one.
_GREEDY = f"""WITH RECURSIVE {E_SQL}, dv AS (SELECT vec_id, label, 'g' || (vec_id // 3) AS group_id FROM e WHERE label < 6),
    gc AS (SELECT group_id, [{", ".join(f"count(*) FILTER (label = {k})" for k in range(6))}] AS counts, count(*) AS size FROM dv GROUP BY group_id),
    nb AS (SELECT *, row_number() OVER (PARTITION BY counts ORDER BY md5('cv' || group_id), group_id) - 1 AS nth, count(*) OVER (PARTITION BY counts) AS m FROM gc),
    tt AS (SELECT [{", ".join(f"(SELECT 1.0::DOUBLE / nullif(count(*) * count(*), 0) FROM dv WHERE label = {k})" for k in range(6))}] AS w),
    lf AS MATERIALIZED (SELECT group_id, counts, size, w, row_number() OVER (ORDER BY 6 * list_sum([x * x FOR x IN counts]) - list_sum(counts) ** 2 DESC, size DESC, md5('cv' || group_id), group_id) AS place
        FROM nb, tt WHERE nth >= greatest(m // {FOLDS} - 8, 0) * {FOLDS}),
    st(place, filled, sizes, group_id, fold) AS (SELECT 0::BIGINT, [[0::BIGINT FOR j IN range(6)] FOR k IN range({FOLDS})], [0::BIGINT FOR k IN range({FOLDS})], NULL::VARCHAR, NULL::INT
        UNION ALL SELECT place, [[filled[k + 1][j + 1] + CASE WHEN k = best THEN counts[j + 1] ELSE 0 END FOR j IN range(6)] FOR k IN range({FOLDS})],
            [sizes[k + 1] + CASE WHEN k = best THEN size ELSE 0 END FOR k IN range({FOLDS})], group_id, best::INT
        FROM (SELECT lf.place, lf.counts, lf.size, lf.group_id, filled, sizes,
            list_min([{{'cost': round({" + ".join(f"coalesce(filled[k + 1][{j}] * counts[{j}] * w[{j}], 0)" for j in range(1, 7))}, 12), 'size': sizes[k + 1], 'fold': k}} FOR k IN range({FOLDS})]).fold AS best
            FROM st JOIN lf ON lf.place = st.place + 1)),
    sg AS (SELECT group_id, (nth % {FOLDS})::INT AS fold FROM nb WHERE nth < greatest(m // {FOLDS} - 8, 0) * {FOLDS} UNION ALL SELECT group_id, fold FROM st WHERE place > 0) """


def _stratified(spark, sf_dir):
    return D.stratified_group_folds(_development(spark, sf_dir), 6, FOLDS)


@query(_GREEDY + "SELECT group_id, fold FROM sg")
def stratified_group_kfold(spark, sf_dir):
    """Folds of whole groups by their class counts."""
    return _stratified(spark, sf_dir)


@query(_GREEDY + """, n AS (SELECT fold, label::BIGINT AS label, count(*) AS n FROM dv JOIN sg USING (group_id) GROUP BY ALL)
    SELECT label, sum(n)::BIGINT AS images, CASE WHEN count(*) < """ + str(FOLDS) + """ THEN 0 ELSE min(n) END AS least, max(n) AS most FROM n GROUP BY label""")
def stratified_spread(spark, sf_dir):
    """Fewest and most images of each class in a fold."""
    return D.class_spread(_development(spark, sf_dir), _stratified(spark, sf_dir), 6, FOLDS)


def _predictions(spark, sf_dir, grid=GRID):
    from vetra.operators import crossvalidation as X

    return X.out_of_fold(_development(spark, sf_dir).join(_stratified(spark, sf_dir), "group_id"), FOLDS, grid, 6)


@query()
def cross_validate_views(spark, sf_dir):
    """The same, learned on the four quarter turns of each vector as an 8 x 8 square, predicted on their mean."""
    from vetra.functions import canvas as C
    from vetra.operators import crossvalidation as X

    turns = F.array(*[C.take(F.col("v"), places) for places in C.dihedral_places(8)[:4]])
    rows = _development(spark, sf_dir).withColumn("views", turns)
    middle = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.aggregate("views", F.lit(0.0), lambda a, w: a + F.get(w, i)) / 4)
    rows = rows.withColumn("v", middle).join(_stratified(spark, sf_dir), "group_id")
    return X.best(X.by_strength(X.out_of_fold(rows, FOLDS, (0.1, 10.0, 1000.0), 6, on_views=True)))


@query()
def cv_scores(spark, sf_dir):
    """Fold accuracies, pooled accuracy and log-loss of out-of-fold predictions, for every strength of the grid."""
    from vetra.operators import crossvalidation as X

    return X.by_strength(_predictions(spark, sf_dir))


@query()
def cross_validate(spark, sf_dir):
    """The strength of least out-of-fold log-loss, with its scores."""
    from vetra.operators import crossvalidation as X

    return X.best(X.by_strength(_predictions(spark, sf_dir)))


@query(S_SQL + f"SELECT fragment_type, count(*) AS images, count(*) FILTER (NOT {_HIT}) AS errors FROM s WHERE label < 6 GROUP BY fragment_type")
def errors_by_fragment(spark, sf_dir):
    return screened(spark, sf_dir).filter("label < 6").groupBy("fragment_type").agg(F.count(F.lit(1)).alias("images"), F.count_if(~F.expr(_HIT)).alias("errors"))


RUNGS = [(1, 0.81, 0.60, 800.0), (2, 0.86, 0.52, 1400.0), (3, 0.86, 0.49, 1600.0), (4, 0.95, 0.30, 3700.0), (5, 0.91, 0.40, 2600.0), (6, 0.90, 0.35, 900.0), (7, 0.95, 0.29, 2900.0)]
_RUNGS = "r(rung, accuracy, loss, latency) AS (VALUES " + ", ".join(f"({a}::BIGINT, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in RUNGS) + ")"
_LADDER = f"""WITH RECURSIVE {_RUNGS}, f(rung, best, loss, adopted) AS (SELECT 0::BIGINT, -1::DOUBLE, 'inf'::DOUBLE, false
    UNION ALL SELECT r.rung, CASE WHEN y THEN accuracy ELSE best END, CASE WHEN y THEN r_loss ELSE loss END, y FROM (SELECT f.best, f.loss, r.rung, r.accuracy, r.loss AS r_loss,
        r.latency <= 3000 AND (r.accuracy > f.best OR (r.accuracy = f.best AND r.loss < f.loss)) AS y FROM f JOIN r ON r.rung = f.rung + 1) AS r) """


def _rungs(spark):
    return spark.createDataFrame(RUNGS, "rung long, accuracy double, loss double, latency double")


@query(f"WITH {_RUNGS} SELECT a.rung, b.rung AS against, a.latency <= 3000 AND (a.accuracy > b.accuracy OR (a.accuracy = b.accuracy AND a.loss < b.loss)) AS adopted FROM r a JOIN r b ON b.rung = a.rung - 1")
def adoption_rule(spark, sf_dir):
    a, b = _rungs(spark).alias("a"), _rungs(spark).alias("b")
    rule = V.adopts(F.col("a.accuracy"), F.col("a.loss"), F.col("b.accuracy"), F.col("b.loss"), F.col("a.latency"), 3000.0)
    return a.join(b, F.col("b.rung") == F.col("a.rung") - 1).select(F.col("a.rung").alias("rung"), F.col("b.rung").alias("against"), rule.alias("adopted"))


@query(_LADDER + "SELECT rung, adopted, best AS best_accuracy FROM f WHERE rung > 0")
def ladder_fold(spark, sf_dir):
    return V.ladder(_rungs(spark), 3000.0)


@query(_LADDER + ", m(goal) AS (VALUES (0.9::DOUBLE), (0.95::DOUBLE)) SELECT goal, min(rung) AS rung FROM m LEFT JOIN f ON adopted AND best >= goal GROUP BY goal")
def milestones(spark, sf_dir):
    goals = spark.createDataFrame([(0.9,), (0.95,)], "goal double")
    found = V.ladder(_rungs(spark), 3000.0).filter("adopted")
    return goals.join(F.broadcast(found), F.col("best_accuracy") >= F.col("goal"), "left").groupBy("goal").agg(F.min("rung").alias("rung"))


# History

_HIST = "h AS (SELECT event_id AS id, ts AS created_at, event_type AS decision_status, value AS confidence, props AS result_json FROM events)"


def history(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("decision_status"), F.col("value").alias("confidence"), F.col("props").alias("result_json"))


@query(f"WITH {_HIST} SELECT id, decision_status, (result_json::JSON ->> 'k')::BIGINT AS k FROM h WHERE id = 7")
def history_get(spark, sf_dir):
    return history(spark, sf_dir).filter("id = 7").select("id", "decision_status", F.from_json("result_json", "k long")["k"].alias("k"))


_RECENT = f"WITH {_HIST}, r AS (SELECT * FROM h ORDER BY created_at DESC, id DESC LIMIT 100) "


@query(_RECENT + "SELECT id, decision_status, confidence, '/analyses/' || id || '/image' AS image_url FROM r")
def history_recent(spark, sf_dir):
    url = F.concat(F.lit("/analyses/"), F.col("id").cast("string"), F.lit("/image"))
    return V.recent(history(spark, sf_dir), 100).select("id", "decision_status", "confidence", url.alias("image_url"))


@query(_RECENT + "SELECT id, decision_status FROM r WHERE decision_status = 'click'")
def history_filtered(spark, sf_dir):
    """The filter holds for the fetched page, after the limit."""
    return V.recent(history(spark, sf_dir), 100).filter("decision_status = 'click'").select("id", "decision_status")


@query(_RECENT + "SELECT decision_status, count(*) AS n FROM r GROUP BY decision_status")
def history_counts(spark, sf_dir):
    return V.recent(history(spark, sf_dir), 100).groupBy("decision_status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN (n_chars // 1024) || ' KB' ELSE (n_chars // 1048576) || ' MB' END AS size FROM documents")
def format_bytes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", V.format_bytes(F.col("n_chars")).alias("size"))


@query("SELECT event_id, round(least(greatest(value, 0::DOUBLE), 50::DOUBLE) / 50, 8) AS place FROM events")
def gauge_position(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.round(V.gauge(F.col("value"), 50.0), 8).alias("place"))


# Release


_REFS = f"WITH {E_SQL}, rf AS (SELECT vec_id, 'c' || label AS class_name, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS nth FROM e WHERE label < 6) "
_VERSION = "(SELECT md5(string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id)) FROM rf WHERE nth <= {n})"
_SAME = f"{_VERSION.format(n=5)} = {_VERSION.format(n='{n}')}"


@query(_REFS + f"""SELECT * FROM (VALUES
    ('as_released', 'fingerprints', (SELECT count(DISTINCT len(v)) = 1 FROM rf)), ('as_released', 'index_version', {_SAME.format(n=5)}), ('as_released', 'index_classes', true),
    ('newer_index', 'fingerprints', (SELECT count(DISTINCT len(v)) = 1 FROM rf)), ('newer_index', 'index_version', {_SAME.format(n=6)}), ('newer_index', 'index_classes', true),
    ('other_encoder', 'fingerprints', (SELECT count(DISTINCT len(x)) = 1 FROM (SELECT v AS x FROM rf UNION ALL SELECT v[1:32] FROM rf))), ('other_encoder', 'index_version', {_SAME.format(n=5)}),
    ('other_encoder', 'index_classes', (SELECT count(*) = 0 FROM rf WHERE class_name NOT IN (SELECT class_name FROM rf WHERE class_name <> 'c5')))) AS t(release, "check", passed)""")
def consistency_check(spark, sf_dir):
    """Three releases: as made; with an index of more references than the calibration saw; with a classifier of other vectors and one class less."""
    refs = embeddings(spark, sf_dir).filter("label < 6").select("vec_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("class_name"), "v", "label")
    nth = F.row_number().over(W.partitionBy("label").orderBy("vec_id"))
    refs = refs.withColumn("nth", nth).filter("nth <= 6")
    made_of = lambda part, width: refs.select(F.lit(part).alias("part"), F.concat(F.lit("unit-"), width.cast("string")).alias("fingerprint")).distinct()
    version = lambda n: F.md5(F.array_join(F.array_sort(F.collect_list(F.when(F.col("nth") <= n, F.col("vec_id")))), ",").cast("binary"))
    full, half = F.size("v"), F.size(F.slice("v", 1, 32))
    names = refs.select("class_name").distinct()
    out = None
    for release, width, loaded, known in (("as_released", full, 5, names), ("newer_index", full, 6, names), ("other_encoder", half, 5, names.filter("class_name <> 'c5'"))):
        parts = made_of("encoder", full).union(made_of("index", full)).union(made_of("unknown calibration", full)).union(made_of("classifier", width))
        found = L.consistency(parts, refs.agg(version(5).alias("calibrated_on"), version(loaded).alias("loaded")), names, known).withColumn("release", F.lit(release))
        out = found if out is None else out.unionByName(found)
    return out.select("release", "check", "passed")


@query(f"""WITH {INV_SQL}, m AS (SELECT 'role' || image_id AS role, sha256 FROM inv), a AS (SELECT 'role' || image_id AS role, CASE WHEN image_id % 5 = 0 THEN sha256(sha256) ELSE sha256 END AS found FROM inv WHERE fragment_type <> 'src3')
    SELECT role, CASE WHEN found IS NULL THEN 'missing' ELSE 'changed' END AS state FROM m LEFT JOIN a USING (role) WHERE found IS NULL OR found <> m.sha256""")
def manifest_diff(spark, sf_dir):
    """Every document is a role; those of one source are missing, every fifth of the others has changed."""
    rows = inventory_rows(spark, sf_dir)
    role = F.concat(F.lit("role"), F.col("image_id").cast("string")).alias("role")
    changed = F.when(F.col("image_id") % 5 == 0, F.sha2(F.col("sha256").cast("binary"), 256)).otherwise(F.col("sha256")).alias("sha256")
    return L.manifest_diff(rows.select(role, "sha256"), rows.filter("fragment_type <> 'src3'").select(role, changed))


@query("SELECT array_to_string(list_sort(list(DISTINCT lang)), ', ') AS datasets, array_to_string(list_sort(list(DISTINCT source)), ', ') AS fragments FROM documents")
def limitations_lists(spark, sf_dir):
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    return read(spark, sf_dir, "documents").agg(listed("lang").alias("datasets"), listed("source").alias("fragments"))
