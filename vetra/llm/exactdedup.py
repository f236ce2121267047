"""Exact deduplication by a stateful stream.

The stream keys its state by the SHA-256 digest of the normalised text. State lives in RocksDB on the
executors' disks, is checkpointed to the shared folder and never expires. For each digest it retains
the count, the stable identifier (largest doc_id, which stays) and a content locator: the file of that
document's row, which with the identifier says where its bytes are. With a ``store`` the state outlives
the call, and later batches are held against everything seen before.

A hit, a digest met more than once, is checked on full bytes: the texts of its rows at hand, and a
text of an earlier batch that its locator names, are grouped by the whole text. Should two texts share a
digest, it is noted as parted, and each of its texts, of all batches, gets its own group.

Digests met more than once are broadcast behind a check of their number, so texts met once are not shuffled.
Only DataFrame operations run. Copies collapse in map-side partial aggregates before any shuffle. Rows
of hot digests (over 1 / ``HOT`` of all rows each, so at most ``HOT`` of them) are dealt by a salt too,
in the check and in the last join where those are shuffles, so no task gets all copies of a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetra.llm.common import ascii_lower, shared_path

#: Session settings while the stream runs. Without the third, each state partition takes 4 MB of disk ahead;
#: without the last two, each has caches of its own.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
#: A digest is hot from this part of all rows.
HOT = 500
SALTS = 64
#: Digests met more than once (about 100 bytes each) that are broadcast at most; beyond, both sides are shuffled.
MOST_BROADCAST = 500_000


def normalised(text: Column) -> Column:
    """What texts are compared by: A-Z lower-cased, null as empty."""
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stream_state(spark: SparkSession, rows: DataFrame, checkpoint: str) -> DataFrame:
    """Run the stream over what ``rows`` (digest, doc_id, locator) has now; the state as a DataFrame.

    A later call with the same ``checkpoint`` reads only new files and goes on from the kept state.
    Returns digest, keep_id, locator, group_size.
    """
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        kept = F.max(F.struct("doc_id", "locator")).alias("kept")
        query = (
            rows.groupBy("digest").agg(kept, F.count(F.lit(1)).alias("group_size"))
            .writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        value = state.schema["value"].dataType.names
        return state.select(
            F.col("key")[state.schema["key"].dataType.names[0]].alias("digest"),
            F.col("value")[value[0]]["doc_id"].alias("keep_id"),
            F.col("value")[value[0]]["locator"].alias("locator"),
            F.col("value")[value[1]].alias("group_size"),
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, store: str | None = None) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and digest; dropped rows too.

    Texts are equal when identical after lower-casing A-Z; the row with the largest doc_id stays. A
    null text counts as empty, and whole texts are compared whatever their length. Among rows that repeat
    a doc_id and its text, each is marked kept if that id stays; a null doc_id never beats another id,
    and a group of null ids only is kept whole. Other columns pass through (those named keep_id,
    group_size, kept or digest are replaced); an empty table gives an empty result.

    ``store``, a folder that all executors reach, keeps the state: a later call with it takes ``docs`` as a
    further batch, and groups span all batches. A hit on an earlier batch is checked on that batch's text, which its
    locator finds: Parquet files of earlier batches must still be there. Rows that came from no file are known by their digest alone.
    """
    spark = docs.sparkSession
    docs = docs.drop("keep_id", "group_size", "kept", "digest")
    base = docs.withColumn("digest", digest(normalised(F.col("text"))))
    # What the stream reads: a digest and a locator for each row, not the texts.
    root = store.rstrip("/") if store else shared_path(spark, "dedup")
    staged = f"{root}/digests"
    earlier, parted = (_kept_table(spark, f"{root}/{k}") if store else None for k in ("digests", "apart"))
    base.select("digest", F.col("doc_id").cast("long").alias("doc_id"), F.input_file_name().alias("locator")).write.mode("append").parquet(staged)
    digests = spark.read.parquet(staged)
    state = stream_state(spark, spark.readStream.schema(digests.schema).parquet(staged), f"{root}/state")
    settled = shared_path(spark, "dedup-state")
    state.write.parquet(settled)  # read several times below
    state = spark.read.parquet(settled)

    hit = state.filter("group_size > 1")
    few = hit.count() <= MOST_BROADCAST
    total = state.agg(F.sum("group_size")).first()[0] or 0
    hot = F.broadcast(state.filter(F.col("group_size") * HOT > total).select("digest", F.lit(True).alias("__dedup_hot")))  # at most HOT rows
    salted = lambda df: df.join(hot, "digest", "left").withColumn("__dedup_salt", F.when(F.col("__dedup_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int")).drop("__dedup_hot")
    every = F.explode(F.when(F.col("group_size") * HOT > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("__dedup_salt")
    whole = normalised(F.col("text")).alias("__dedup_whole")

    def marked(rows: DataFrame, groups: DataFrame) -> DataFrame:
        """``rows`` with keep_id and group_size of their group in ``groups``; rows without one are alone."""
        groups = groups.select("digest", "keep_id", "group_size", F.lit(True).alias("__dedup_met"), *([] if few else [every]))
        met = rows.join(F.broadcast(groups), "digest", "left") if few else salted(rows).join(groups, ["digest", "__dedup_salt"], "left").drop("__dedup_salt")
        own = {"keep_id": F.col("doc_id").cast("long"), "group_size": F.lit(1).cast("long")}
        return met.withColumns({k: F.when(F.col("__dedup_met"), F.col(k)).otherwise(v) for k, v in own.items()}).drop("__dedup_met")

    texts = base.select("digest", F.col("doc_id").cast("long").alias("doc_id"), whole)
    if few:  # only texts that are met again are shuffled
        texts = texts.join(F.broadcast(hit.select("digest")), "digest", "left_semi")
    else:
        texts = salted(texts).join(hit.select("digest", every), ["digest", "__dedup_salt"], "left_semi")
    texts = texts.select("digest", "doc_id", "__dedup_whole")
    seen, own = texts, hit.select("digest").join(base.select("digest"), "digest", "left_semi")
    if earlier is not None:  # one earlier text of each digest: were there several, the digest is known to be parted
        seen = seen.unionByName(_located(spark, earlier.join(own, "digest", "left_semi").groupBy("digest").agg(F.min("locator").alias("locator")), digest))
    apart_path = shared_path(spark, "dedup-apart")
    apart = seen.select("digest", "__dedup_whole").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    (apart if parted is None else apart.unionByName(parted.join(own, "digest", "left_semi").select("digest")).distinct()).write.parquet(apart_path)
    clashing = spark.read.parquet(apart_path)
    if store:
        clashing.write.mode("append").parquet(f"{root}/apart")
    if not clashing.isEmpty() and earlier is not None:  # then all their texts count
        texts = texts.unionByName(_located(spark, earlier.join(clashing, "digest", "left_semi").select("digest", "locator").distinct(), digest))
    checked = texts.groupBy("digest", "__dedup_whole").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    if clashing.isEmpty():
        out = marked(base, hit)
    else:  # different texts under one digest: those digests are resolved by the whole text
        resolved = base.withColumn("__dedup_whole", whole).join(checked.join(clashing, "digest", "left_semi"), ["digest", "__dedup_whole"]).drop("__dedup_whole")
        plain = marked(base.join(clashing, "digest", "left_anti"), hit.join(clashing, "digest", "left_anti"))
        out = plain.unionByName(resolved.select(plain.columns))
    out = out.select(*docs.columns, "digest", "keep_id", "group_size")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()))


def _kept_table(spark: SparkSession, path: str) -> DataFrame | None:
    """What earlier calls wrote there, without what this one will."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # there is none yet
        return None


def _located(spark: SparkSession, where: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """digest, doc_id, whole of all rows with the digests of ``where`` (digest, locator) in the files that its locators name."""
    files = [r[0] for r in where.select("locator").distinct().collect() if r[0]]  # one row a file
    if not files:
        return where.select("digest", F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("__dedup_whole")).limit(0)
    whole = normalised(F.col("text"))
    rows = spark.read.parquet(*files).select(digest(whole).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.input_file_name().alias("locator"), whole.alias("__dedup_whole"))
    return rows.join(where, ["digest", "locator"], "left_semi").select("digest", "doc_id", "__dedup_whole")


def dedup_classes(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    return exact_dedup(docs.select("doc_id", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256")
    )
