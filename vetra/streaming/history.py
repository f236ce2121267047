"""The history of analyses, appended from a stream: a batch that comes again replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vetra.operators.artifacts import HISTORY

_COLUMNS = [c.split()[0] for c in HISTORY.split(", ")]


def append_batch(rows: DataFrame, batch: int, path: str) -> None:
    """Add ``rows`` (the columns of the history; others are left out) as batch number ``batch``.

    Files lie by day and batch. A batch overwrites just its own partitions, in one commit, so one that is written again
    after a lost driver adds no row. No rows: nothing is written. A null date is a day of its own.
    """
    dated = rows.select(*_COLUMNS, F.substring("created_at", 1, 10).alias("day"), F.lit(batch).cast("long").alias("batch"))
    # rows of a day together: a file a day, more where a day is large
    dated.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The history with day and batch; filters on day prune partitions."""
    return spark.read.schema(f"{HISTORY}, day STRING, batch LONG").parquet(path)


def append_stream(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of analyses; ``trigger`` as for a stream writer, ``availableNow=True`` where none is given."""
    writer = rows.writeStream.foreachBatch(lambda part, batch: append_batch(part, batch, path))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
