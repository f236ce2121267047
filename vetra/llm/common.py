"""Helpers that the training-data operators share: shared folder, lineage cuts, text normalisation."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: For str.translate: lower-cases A-Z and nothing else.
LOWER_TABLE = str.maketrans(ASCII_UPPER, ASCII_LOWER)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where a session on one machine sets none (tests) a temporary folder is chosen and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
            root = "file://" + tempfile.mkdtemp(prefix="vetra-shared-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/vetra-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    root = shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Have this session send at most ``rows`` texts to Python at a time: buffers on both sides stay small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Return free memory to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run):
    """``run``, a function of Arrow batches, with free memory given back once a partition is done."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def trimmed_group(run):
    """``run``, a function of a group's key and table, with free memory given back after each group."""

    def whole(key, tab):
        try:
            return run(key, tab)
        finally:
            give_back()

    return whole


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all but the ``used`` columns in one struct, where no name of theirs can clash; and what to select to get them back."""
    others = [c for c in docs.columns if c not in used]
    packed = docs.select(*used, F.struct(*[F.col(f"`{c}`") for c in others]).alias("__others")) if others else docs
    return packed, [F.col("__others").getField(c).alias(c) if c in others else F.col(c) for c in docs.columns]
