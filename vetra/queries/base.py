"""Shared inputs of the registered queries and the SQL for the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetra.functions.vectors import doubles
from vetra.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with DuckDB SQL where there is some."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", doubles("embedding").alias("v"), "label")


#: CTE e(vec_id, v, label).
E_SQL = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def canvases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 components as an 8 x 8 canvas of intensities 0..255, rounded so that some clip."""
    pixel = lambda x: F.least(F.greatest(F.round(x * 512 + 128), F.lit(0.0)), F.lit(255.0))
    return embeddings(spark, sf_dir).select("vec_id", "label", F.transform("v", pixel).alias("c"))


#: CTEs e and p(vec_id, label, c).
P_SQL = E_SQL + ", p AS (SELECT vec_id, label, [least(greatest(round(x * 512 + 128), 0.0::DOUBLE), 255.0::DOUBLE) FOR x IN v] AS c FROM e)"


def inventory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as an inventory of files."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image_id"), F.format_string("%012d", F.col("doc_id")).alias("path"), "text",
        F.col("lang").alias("class_name"), F.col("source").alias("fragment_type"), F.col("n_chars").alias("file_size"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
    )


#: CTE inv, the same.
INV_SQL = """inv AS (SELECT doc_id AS image_id, lpad(doc_id::VARCHAR, 12, '0') AS path, text, lang AS class_name,
    source AS fragment_type, n_chars AS file_size, sha256(text) AS sha256 FROM documents)"""
