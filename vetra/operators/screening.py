"""Classification, unknown detection, evidence, decision: one chain of columns over a batch of vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetra.functions.vectors import dot, let, sigmoid, total
from vetra.operators.retrieval import class_support, mean_similarity, search


@dataclass(frozen=True)
class Calibration:
    """Distances over ``threshold`` are unknown, over ``boundary`` uncertain; risk is logistic in distance."""

    k: int = 5
    threshold: float = 0.86
    boundary: float = 0.80
    risk_intercept: float = -20.0
    risk_slope: float = 25.0


@dataclass(frozen=True)
class Policy:
    min_confidence: float = 0.5
    min_similarity: float = 0.2
    max_risk: float = 0.5


def class_probabilities(v: Column, weights: Column, sharpness: float) -> Column:
    """Softmax over class weights (array of class_name, w, in name order), most probable first; ties in name order."""
    logits = let(v, lambda own: F.transform(weights, lambda c: F.struct(c["class_name"].alias("class_name"), (dot(own, c["w"]) * sharpness).alias("z"))))

    def soft(zs: Column) -> Column:
        top = F.array_max(F.transform(zs, lambda c: c["z"]))
        powers = let(top, lambda m: F.transform(zs, lambda c: F.struct(c["class_name"].alias("class_name"), F.exp(c["z"] - m).alias("p"))))
        whole = lambda ps: total(F.transform(ps, lambda c: c["p"]))
        return let(powers, lambda ps: let(whole(ps), lambda s: F.transform(ps, lambda c: F.struct((-c["p"] / s).alias("order"), c["class_name"].alias("class_name")))))

    ordered = F.array_sort(let(logits, soft))
    return F.transform(ordered, lambda c: F.struct(c["class_name"].alias("class_name"), (-c["order"]).alias("probability")))


def classify(rows: DataFrame, weights: DataFrame, top: int, sharpness: float) -> DataFrame:
    """Add top_k, predicted_class, confidence. ``weights`` (class_name, w) has one row a class."""
    packed = weights.agg(F.array_sort(F.collect_list(F.struct("class_name", "w"))).alias("weights"))
    found = rows.join(F.broadcast(packed)).withColumn("top_k", F.slice(class_probabilities(F.col("v"), F.col("weights"), sharpness), 1, top)).drop("weights")
    return found.withColumn("predicted_class", F.col("top_k")[0]["class_name"]).withColumn("confidence", F.col("top_k")[0]["probability"])


def status(distance: Column, c: Calibration) -> Column:
    return F.when(distance > c.threshold, "UNKNOWN").when(distance > c.boundary, "UNCERTAIN").otherwise("KNOWN")


def risk(distance: Column, c: Calibration) -> Column:
    return sigmoid(distance * c.risk_slope + c.risk_intercept)


def agreement(predicted: Column, retrieved: Column, matches: Column) -> Column:
    unanimous = F.forall(matches, lambda m: m["class_name"] == predicted)
    return F.when(predicted != retrieved, "LOW").when(unanimous, "HIGH").otherwise("MEDIUM")


def support_of(predicted: Column, support: Column) -> Column:
    own = F.filter(support, lambda s: s["class_name"] == predicted)
    return F.coalesce(F.try_element_at(own, F.lit(1))["weighted_share"], F.lit(0.0))


def strength(*parts: Column) -> Column:
    """Geometric mean; 0 if any part is not over 0."""
    logs = F.ln(parts[0])
    for p in parts[1:]:
        logs = logs + F.ln(p)
    return F.when(F.least(*parts) <= 0, 0.0).otherwise(F.exp(logs / len(parts)))


def checks(p: Policy) -> Column:
    """The five checks in order: name, passed, and what was observed and required, as text."""
    number = lambda c: F.format_string("%.3f", c)
    rows = [
        ("confidence", F.col("confidence") >= p.min_confidence, number(F.col("confidence")), F.lit(f">= {p.min_confidence:.3f}")),
        ("similarity", F.col("top_similarity") >= p.min_similarity, number(F.col("top_similarity")), F.lit(f">= {p.min_similarity:.3f}")),
        ("risk", F.col("unknown_risk") <= p.max_risk, number(F.col("unknown_risk")), F.lit(f"<= {p.max_risk:.3f}")),
        ("agreement", F.col("agreement") == "HIGH", F.col("agreement"), F.lit("HIGH")),
        ("quality", F.col("quality_status") == "ACCEPTABLE", F.col("quality_status"), F.lit("ACCEPTABLE")),
    ]
    return F.array(*[F.struct(F.lit(n).alias("name"), c.alias("passed"), o.alias("observed"), r.alias("required")) for n, c, o, r in rows])


# The sentences of a summary.
SENTENCES = {
    "prediction": "The classifier predicts %s with %.0f%% confidence.",
    "references": "%d of the %d most similar reference images are %s; the best reference match has cosine similarity %.3f.",
    "conflict": "Reference retrieval favours %s, so the two analyses of the same visual representation disagree.",
    "agreement": "Classifier and reference retrieval agree (%s agreement); they are complementary analyses of the same visual representation, not independent tests.",
    "UNKNOWN": "The sample lies outside the calibrated reference distribution.",
    "UNCERTAIN": "The sample is atypical compared with validated reference material.",
    "KNOWN": "The sample lies within the calibrated reference distribution.",
    "quality": "Image quality is degraded (%s).",
}


def summary() -> Column:
    """The evidence in sentences, over the columns of ``screen`` and quality_failed (the failed quality checks, comma-joined)."""
    said = SENTENCES
    same = F.size(F.filter("matches", lambda m: m["class_name"] == F.col("predicted_class")))
    agree = F.format_string(said["agreement"], F.lower("agreement"))
    parts = [
        F.format_string(said["prediction"], "predicted_class", F.bround(F.col("confidence") * 100, 0)),
        F.format_string(said["references"], same, F.size("matches"), "predicted_class", "top_similarity"),
        F.when(F.col("agreement") == "LOW", F.format_string(said["conflict"], "retrieved_class")).otherwise(agree),
        F.when(F.col("unknown_status") == "UNKNOWN", said["UNKNOWN"]).when(F.col("unknown_status") == "UNCERTAIN", said["UNCERTAIN"]).otherwise(said["KNOWN"]),
        F.when(F.col("quality_status") != "ACCEPTABLE", F.format_string(said["quality"], "quality_failed")),
    ]
    return F.concat_ws(" ", *parts)


def decide(status_col: Column, checks_col: Column) -> Column:
    """UNKNOWN stands before all; PASS needs every check; the rest is for review."""
    return F.when(status_col == "UNKNOWN", "UNKNOWN").when(F.forall(checks_col, lambda c: c["passed"]), "PASS").otherwise("REVIEW")


def reason(decision: Column, checks_col: Column) -> Column:
    failed = F.array_join(F.transform(F.filter(checks_col, lambda c: ~c["passed"]), lambda c: c["name"]), ", ")
    return F.when(decision == "UNKNOWN", "outside the reference library").when(decision == "PASS", "all checks passed").otherwise(F.concat(F.lit("failed: "), failed))


def screen(rows: DataFrame, refs: DataFrame, weights: DataFrame, c: Calibration, p: Policy, top: int = 3, sharpness: float = 10.0) -> DataFrame:
    """The whole chain over ``rows`` (v, quality_status, quality_fraction, ...): narrow, without a shuffle of the rows."""
    out = classify(search(rows, refs, c.k), weights, top, sharpness)
    out = out.withColumn("class_support", class_support(F.col("matches")))
    out = out.withColumns({
        "retrieved_class": F.col("class_support")[0]["class_name"],
        "top_similarity": F.col("matches")[0]["similarity"],
        "distance": 1 - mean_similarity(F.col("matches"), c.k),
    })
    out = out.withColumns({"unknown_status": status(F.col("distance"), c), "unknown_risk": risk(F.col("distance"), c)})
    out = out.withColumns({
        "agreement": agreement(F.col("predicted_class"), F.col("retrieved_class"), F.col("matches")),
        "reference_support": support_of(F.col("predicted_class"), F.col("class_support")),
    })
    out = out.withColumn("strength", strength(F.col("confidence"), F.col("reference_support"), 1 - F.col("unknown_risk"), F.col("quality_fraction")))
    out = out.withColumn("checks", checks(p))
    out = out.withColumn("decision", decide(F.col("unknown_status"), F.col("checks")))
    return out.withColumn("reason", reason(F.col("decision"), F.col("checks")))
