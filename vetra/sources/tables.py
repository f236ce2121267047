"""Table scans and the file formats of artifacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def directory_inventory(spark: SparkSession, root: str) -> DataFrame:
    """One row a file below root/<class>/: path, filename, class_name, file_size, sha256; dot-files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    return (
        files.select("path", F.element_at(parts, -1).alias("filename"), F.element_at(parts, -2).alias("class_name"), F.col("length").alias("file_size"), F.sha2("content", 256).alias("sha256"))
        .filter(~F.col("filename").startswith(".") & ~F.col("class_name").startswith("."))
    )


def read_csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, every column a string, empty fields kept as empty strings."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", "true").csv(path).na.fill("")


def write_splits(rows: DataFrame, path: str, role: str = "role", order: str = "path") -> None:
    """One CSV folder a role, rows ordered within files."""
    rows.repartition(role).sortWithinPartitions(role, order).write.mode("overwrite").option("header", "true").partitionBy(role).csv(path)


def label_names(values: DataFrame, label: str, names: dict[int, str]) -> DataFrame:
    """Add class_name from embedded label names; an unknown label has none."""
    pairs = F.create_map(*[x for k, v in sorted(names.items()) for x in (F.lit(k), F.lit(v))])
    return values.withColumn("class_name", F.try_element_at(pairs, F.col(label)))


def load_artifact(text: str, fields: dict[str, type]) -> dict:
    """A JSON artifact's known fields; extra ones are ignored, a missing one is an error."""
    found = json.loads(text)
    if missing := sorted(fields.keys() - found.keys()):
        raise ValueError(f"artifact lacks {', '.join(missing)}")
    return {k: kind(found[k]) for k, kind in fields.items()}


def misaligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has; empty where two tables are aligned."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only = lambda x, y, side: x.join(y, key, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "right"))
