"""Stages that hand over through stored tables, each kept under a key of its input, its settings and those before it.

A stage whose key is stored is read instead of run, so a second run reads everything, a changed setting runs only what
follows it, and a run that was broken off goes on where it stopped. A stage counts as stored once its document stands
beside its table; the document is written last.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetra.sources.store import load_document, save_artifact


@dataclass(frozen=True)
class Stage:
    """``work(rows, **settings)`` gives the next table, or a pair of it and a dict of facts (JSON values) about the run.

    ``version`` is to change with the code of ``work``, as that isn't part of the key.
    """

    name: str
    work: Callable[..., DataFrame | tuple[DataFrame, dict]]
    settings: dict = field(default_factory=dict)
    version: str = "1"


@dataclass(frozen=True)
class Done:
    name: str
    path: str
    reused: bool
    rows: int
    facts: dict


def table_fingerprint(rows: DataFrame) -> str:
    """A digest of the rows as a multiset, of column names and types; the order of rows and partitions doesn't count.

    One aggregation with map-side partials: the number of rows and two sums of differently seeded 64-bit hashes. Null and
    an empty value differ. Columns of maps can't be hashed.
    """
    columns = sorted(rows.columns)
    hashed = [F.xxhash64(F.lit(seed), *[part for c in columns for part in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]).cast("decimal(20,0)") for seed in (1, 2)]
    n, *sums = rows.agg(F.count(F.lit(1)), *[F.sum(h) for h in hashed]).first()
    kinds = [(c, rows.schema[c].dataType.simpleString()) for c in columns]
    return hashlib.sha256(json.dumps([kinds, n, *map(str, sums)]).encode()).hexdigest()


def stage_keys(source: str, stages: list[Stage]) -> list[str]:
    """Each stage's key: a digest of the key before it (at first, of the source), its name, version and settings."""
    keys = []
    for stage in stages:
        source = hashlib.sha256(json.dumps([source, stage.name, stage.version, stage.settings], sort_keys=True).encode()).hexdigest()
        keys.append(source)
    return keys


def stored(spark: SparkSession, path: str, key: str) -> dict | None:
    """The document at ``path`` if it is whole and of ``key``."""
    try:
        document = load_document(spark, path)
    except (AnalysisException, TypeError, ValueError):  # no folder, no line, half a line
        return None
    return document if document.get("fingerprint") == key else None


def run_stages(source: DataFrame, stages: list[Stage], root: str) -> list[Done]:
    """Run what isn't stored below ``root`` (a folder that all executors reach); tables are at <root>/<name>-<key>/rows.

    A table without its document, left by a run that was broken off, is written anew. Two runs at once over one
    folder aren't supported. Nothing is deleted.
    """
    names = [s.name for s in stages]
    if len(set(names)) < len(names):
        raise ValueError("stages need names of their own")
    spark, rows, done = source.sparkSession, source, []
    for stage, key in zip(stages, stage_keys(table_fingerprint(source), stages)):
        path = f"{root.rstrip('/')}/{stage.name}-{key[:16]}"
        document = stored(spark, path, key)
        reused = document is not None
        if not reused:
            made = stage.work(rows, **stage.settings)
            table, facts = made if isinstance(made, tuple) else (made, {})
            save_artifact(table, path, stage.version, key, mode="overwrite", stage=stage.name, settings=stage.settings, facts=facts)
            document = load_document(spark, path)
        rows = spark.read.parquet(f"{path}/rows")
        done.append(Done(stage.name, path, reused, document["rows"], document["facts"]))
    return done
