"""Stored artifacts: a table beside a one-row document that says what it is, checked when it is loaded."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ArtifactMismatch(ValueError):
    """A stored artifact is not what its document or its reader says."""


def save_artifact(rows: DataFrame, path: str, version: str, fingerprint: str, mode: str = "errorifexists", **provenance) -> None:
    """Write ``rows`` and their document {version, fingerprint, rows, ...} under ``path``."""
    rows.write.mode(mode).parquet(f"{path}/rows")
    spark = rows.sparkSession
    document = {"version": version, "fingerprint": fingerprint, "rows": spark.read.parquet(f"{path}/rows").count(), **provenance}
    spark.createDataFrame([(json.dumps(document, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/document")


def load_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/document").first()["value"])


def load_artifact(spark: SparkSession, path: str, fingerprint: str | None = None) -> tuple[DataFrame, dict]:
    """The rows and the document; raises where their number or the expected fingerprint differs."""
    rows, document = spark.read.parquet(f"{path}/rows"), load_document(spark, path)
    if (found := rows.count()) != document["rows"]:
        raise ArtifactMismatch(f"{found} rows are stored, the document says {document['rows']}")
    if fingerprint is not None and document["fingerprint"] != fingerprint:
        raise ArtifactMismatch(f"made with {document['fingerprint']}, not {fingerprint}")
    return rows, document


def save_classifier(weights: DataFrame, path: str, version: str, fingerprint: str, config: dict) -> None:
    """``weights`` (class_name, w): classes are numbered in name order; their names and the configuration go with the document."""
    classes = [r[0] for r in weights.select("class_name").distinct().orderBy("class_name").collect()]  # one row a class
    save_artifact(weights, path, version, fingerprint, classes=classes, config=config)


def load_classifier(spark: SparkSession, path: str, fingerprint: str | None = None) -> tuple[DataFrame, dict]:
    weights, document = load_artifact(spark, path, fingerprint)
    stored = [r[0] for r in weights.select("class_name").distinct().orderBy("class_name").collect()]
    if stored != document["classes"]:
        raise ArtifactMismatch(f"weights are of {stored}, the document lists {document['classes']}")
    return weights, document


def save_scored(scored: DataFrame, path: str) -> dict[str, str]:
    """One Parquet folder a split, and where each is."""
    scored.write.partitionBy("split").parquet(path)
    return {r[0]: f"{path}/split={r[0]}" for r in scored.sparkSession.read.parquet(path).select(F.col("split")).distinct().collect()}  # one row a split
