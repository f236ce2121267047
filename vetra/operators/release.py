"""Release integrity, upload checks and consistency of artifacts."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetra.sources.store import ArtifactMismatch


def upload_code(kind: Column, size: Column, allowed: list[str], most: int) -> Column:
    """Status of an upload: the format is judged first, then the size, then the content."""
    return F.when(~kind.isin(*allowed), 415).when(size > most, 413).when(size == 0, 422).otherwise(200)


def manifest_diff(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """role, state (changed, missing) of every manifest role that isn't as recorded. Both have role, sha256."""
    both = manifest.join(actual.withColumnRenamed("sha256", "found"), "role", "left")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed")
    return both.select("role", state.alias("state")).filter("state IS NOT NULL")


def consistency(fingerprints: DataFrame, versions: DataFrame, index_classes: DataFrame, known_classes: DataFrame) -> DataFrame:
    """check, passed: whether artifacts that are loaded together belong together.

    ``fingerprints`` (part, fingerprint) of encoder, classifier, index and unknown calibration must be one;
    ``versions`` (calibrated_on, loaded) of the index must agree; the index has no class that the classifier
    doesn't know (both: class_name).
    """
    one = fingerprints.agg((F.count_distinct(F.coalesce("fingerprint", F.lit("none"))) == 1).alias("passed")).select(F.lit("fingerprints").alias("check"), "passed")
    same = versions.agg(F.coalesce(F.every(F.col("calibrated_on").eqNullSafe(F.col("loaded"))), F.lit(False)).alias("passed")).select(F.lit("index_version").alias("check"), "passed")
    strange = index_classes.select("class_name").distinct().join(known_classes, "class_name", "left_anti")
    subset = strange.agg((F.count(F.lit(1)) == 0).alias("passed")).select(F.lit("index_classes").alias("check"), "passed")
    return one.unionByName(same).unionByName(subset)


def require_consistent(fingerprints: DataFrame, versions: DataFrame, index_classes: DataFrame, known_classes: DataFrame) -> None:
    failed = [r["check"] for r in consistency(fingerprints, versions, index_classes, known_classes).filter("NOT passed").collect()]  # three rows at most
    if failed:
        raise ArtifactMismatch(f"artifacts do not belong together: {', '.join(sorted(failed))}")


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def build_manifest(files: dict[str, str]) -> dict[str, dict[str, str]]:
    """role -> path and checksum of every artifact; a missing file is an error."""
    return {role: {"path": str(p), "sha256": sha256_file(p)} for role, p in sorted(files.items())}


def verify_manifest(manifest: dict[str, dict[str, str]]) -> dict[str, str]:
    """role -> missing or changed, for what isn't as the manifest says."""
    out = {}
    for role, entry in manifest.items():
        if not Path(entry["path"]).exists():
            out[role] = "missing"
        elif sha256_file(entry["path"]) != entry["sha256"]:
            out[role] = "changed"
    return out


def health(ready: bool, problems: list[str]) -> dict:
    return {"status": "ok" if ready and not problems else "degraded", "problems": list(problems)}
