"""Screening a stream: vectors arrive, the library and weights are static, no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vetra.operators import screening as S


def screen_stream(rows: DataFrame, refs: DataFrame, weights: DataFrame, c: S.Calibration, p: S.Policy) -> DataFrame:
    """The batch chain over a streaming frame: joins with one static row, so each micro-batch is narrow."""
    return S.screen(rows, refs, weights, c, p)


def write_decisions(screened: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append decisions as Parquet, exactly once, for what has arrived so far."""
    columns = [k for k in screened.columns if k not in ("v", "matches", "class_support", "top_k", "checks")]
    return screened.select(*columns).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
