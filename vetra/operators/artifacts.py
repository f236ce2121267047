"""Configuration, receipts, caches and the history table: what runs on the driver beside the plans."""

from __future__ import annotations

import tarfile
import zipfile
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetra.functions.vectors import POOLING_WIDTH
from vetra.operators.release import sha256_file


@dataclass(frozen=True)
class EncoderSettings:
    """An encoder is any source of vectors; its settings decide which artifacts fit together."""

    name: str
    revision: str
    input_size: int
    views: int = 1
    pooling: str = "cls"

    def __post_init__(self) -> None:
        if not 1 <= self.views <= 8:
            raise ValueError("views must be from 1 to 8")
        if self.input_size < 14 or self.input_size % 14:
            raise ValueError("the input size must be a multiple of 14")
        if self.pooling not in POOLING_WIDTH:
            raise ValueError(f"unknown pooling: {self.pooling}")

    @property
    def fingerprint(self) -> str:
        return f"{self.name}@{self.revision}/{self.input_size}px/{self.views}v/{self.pooling}"

    def width(self, hidden: int) -> int:
        return hidden * POOLING_WIDTH[self.pooling]


@dataclass(frozen=True)
class SplitRatios:
    train: float = 0.7
    validation: float = 0.15
    test: float = 0.15

    def __post_init__(self) -> None:
        parts = (self.train, self.validation, self.test)
        if min(parts) <= 0 or abs(sum(parts) - 1) > 1e-9:
            raise ValueError("ratios must be positive and add up to 1")


@dataclass
class CacheKey:
    """What a cached feature set was made of; it serves any subset of views and fewer layers."""

    ids: list[str]
    revision: str
    views: int
    layers: bool = field(default=False)

    def serves(self, wanted: "CacheKey") -> bool:
        return self.ids == wanted.ids and self.revision == wanted.revision and self.views >= wanted.views and (self.layers or not wanted.layers)


def encode_cost_ms(seconds_per_view: float, views: int) -> float:
    return 1000 * seconds_per_view * views


def needs_download(path: str | Path, sha256: str, receipt: str | None) -> bool:
    """False where the receipt names this checksum and the file is there; a file that differs from it is an error."""
    if receipt == sha256 and Path(path).exists():
        return False
    if Path(path).exists() and sha256_file(path) != sha256:
        raise ValueError(f"{path}: checksum differs")
    return not Path(path).exists()


def extract(archive: str | Path, target: str | Path) -> list[str]:
    """Unpack a zip or tar without the first path component; members that would leave the target are an error."""
    target, out = Path(target).resolve(), []

    def place(name: str) -> Path | None:
        parts = PurePosixPath(name).parts[1:]
        if not parts:
            return None
        to = target.joinpath(*parts).resolve()
        if not to.is_relative_to(target):
            raise ValueError(f"{name} leaves the target folder")
        return to

    def put(name: str, data: bytes) -> None:
        if to := place(name):
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(data)
            out.append(str(to))

    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            for i in z.infolist():
                if not i.is_dir():
                    put(i.filename, z.read(i))
    else:
        with tarfile.open(archive) as t:
            for m in t:
                if m.isfile():
                    put(m.name, t.extractfile(m).read())
    return sorted(out)


HISTORY = "id STRING, created_at STRING, filename STRING, decision_status STRING, predicted_class STRING, confidence DOUBLE, result_json STRING"


def create_history(spark: SparkSession, name: str = "analyses") -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({HISTORY}, day STRING) USING parquet PARTITIONED BY (day)")


def insert_analyses(rows: DataFrame, name: str = "analyses") -> None:
    """Append analyses; partitions by day serve the newest-first reads."""
    columns = [c.split()[0] for c in HISTORY.split(", ")]
    rows.select(*columns, F.substring("created_at", 1, 10).alias("day")).write.mode("append").insertInto(name)


def calibration_document(values: dict) -> str:
    import json

    return json.dumps(values, indent=2, sort_keys=True)


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """A report table; undefined values are dashes."""
    show = lambda v: "–" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows])
