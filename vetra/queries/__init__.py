"""Registered queries by family: QUERIES maps a name to a callable, ORACLES to DuckDB SQL."""

from vetra.queries import calibration, cascade, curation, evaluation, intake, screening, vectors  # noqa: F401
from vetra.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
