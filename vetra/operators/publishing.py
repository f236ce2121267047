"""Publishing a release: staged, checked and loaded whole, then one pointer is swapped; readers see the old release or the new one."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetra.sources.store import ArtifactMismatch

#: The pointer's name below the root, and where releases lie.
POINTER, RELEASES = "CURRENT", "releases"


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """file (relative to ``folder``), role (its first part), bytes, sha256 of every file; hashed where Spark reads them.

    A file is read whole by one task, so none may have 2 GB or more; tables are written in parts below that.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_replace("path", "^.*?/" + RELEASES + "/[^/]+/artifacts/", "")
    return files.select(name.alias("file"), F.substring_index(name, "/", 1).alias("role"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def differing(spark: SparkSession, release: str) -> DataFrame:
    """file, state (missing, changed, added) of what isn't as the release's manifest says."""
    recorded = spark.read.parquet(f"{release}/manifest").select("file", "sha256")
    found = checksums(spark, f"{release}/artifacts").select("file", F.col("sha256").alias("found"))
    both = recorded.join(found, "file", "full")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "added").when(F.col("found") != F.col("sha256"), "changed")
    return both.select("file", state.alias("state")).filter("state IS NOT NULL")


def verify(spark: SparkSession, release: str) -> None:
    wrong = differing(spark, release).orderBy("file").limit(5).collect()  # enough to name
    if wrong:
        raise ArtifactMismatch("the release is not as its manifest says: " + ", ".join(f"{r.file} {r.state}" for r in wrong))


def stage(spark: SparkSession, root: str, version: str, writers: dict[str, Callable[[str], object]]) -> str:
    """First phase: each role's writer gets a fresh folder; the manifest is written last. Gives the release's path."""
    if not version or "/" in version or not writers:
        raise ValueError("a release needs a version without slashes and at least one artifact")
    release = f"{root}/{RELEASES}/{version}-{uuid.uuid4().hex[:8]}"  # what a crash left is never written to again
    for role, write in writers.items():
        write(f"{release}/artifacts/{role}")
    made = checksums(spark, f"{release}/artifacts").withColumn("version", F.lit(version))
    made.write.parquet(f"{release}/manifest")
    if lacking := sorted(writers.keys() - {r.role for r in spark.read.parquet(f"{release}/manifest").select("role").distinct().collect()}):  # one row a role
        raise ArtifactMismatch(f"nothing was written for {', '.join(lacking)}")
    return release


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write beside, then rename over: whole or not at all."""
    beside = f"{path.rsplit('/', 1)[0]}/.{POINTER}-{uuid.uuid4().hex}"
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        beside, path = (unquote(urlparse(p).path) for p in (beside, path))
        with open(beside, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, path)
        return
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target, source = hadoop.Path(path), hadoop.Path(beside)
    out = target.getFileSystem(conf).create(source, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    over = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri(), conf).rename(source, target, over)


def swap(spark: SparkSession, root: str, release: str) -> None:
    """Second phase: the pointer names ``release`` from now on."""
    _put(spark, f"{root}/{POINTER}", f"{RELEASES}/{release.rstrip('/').rsplit('/', 1)[1]}\n")


def publish(spark: SparkSession, root: str, version: str, writers: dict[str, Callable[[str], object]], load: Callable[[str], object]) -> str:
    """Stage, hold every file against the manifest, ``load`` the staged artifacts (it raises where they don't fit), swap.

    Whatever fails before the swap leaves the release that readers have. Gives the release's path.
    """
    release = stage(spark, root, version, writers)
    verify(spark, release)
    load(f"{release}/artifacts")
    swap(spark, root, release)
    return release


def current(spark: SparkSession, root: str, checked: bool = True) -> str:
    """The path of the published release, held against its manifest unless ``checked`` is false."""
    try:
        named = spark.read.text(f"{root}/{POINTER}").first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        named = None
    if named is None:
        raise ArtifactMismatch("nothing is published")
    release = f"{root}/{named['value'].strip()}"
    if checked:
        verify(spark, release)
    return release
