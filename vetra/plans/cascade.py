"""The curation of an inventory, from files to splits, as stages that are kept and read again.

``inventory``: image_id, path (one a row), class_name, fragment_type, sha256 and hash (long; null where it couldn't be made),
readable; other columns pass through. The result adds role, exclusion_reason, conflicting_classes and group_id. An empty
inventory gives an empty result. A class with fewer than two fragment types to hold out is refused, or kept whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetra.operators import curation as K
from vetra.operators.distances import close_pairs
from vetra.plans.session import cut
from vetra.plans.stages import Done, Stage, run_stages

ROLES = ("train", "validation", "test", "heldout_known", "ambiguity_probe")


def readable(rows: DataFrame) -> DataFrame:
    return K.assign(K.begin(rows), ~F.coalesce("readable", F.lit(False)), "excluded", "unreadable")


def conflicts(rows: DataFrame) -> tuple[DataFrame, dict]:
    """A probe is a group of its own, named by its hash."""
    out = K.resolve_conflicts(rows)
    probe = F.when(F.col("role") == "ambiguity_probe", K.derive_id("conflict-", F.col("sha256")))
    found = K.conflict_hashes(rows.filter("role IS NULL AND sha256 IS NOT NULL")).count()
    return out.withColumn("group_id", probe), {"label_conflict_hashes": found}


def _pending(rows: DataFrame) -> DataFrame:
    return rows.filter("role IS NULL")


def near_groups(rows: DataFrame, percentile: float, bits: int) -> tuple[DataFrame, dict]:
    """Pending rows whose hashes are closer than the percentile of cross-class distances are one group; groups of several classes go."""
    pending = cut(_pending(rows).select("image_id", "class_name", "hash"))
    bound, links, close = close_pairs(pending, percentile, bits)
    grouped = cut(K.linked_groups(pending, close, bound > 0))
    sizes = grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("class_name").alias("classes"))
    facts = sizes.agg(F.count_if(F.col("n") > 1).alias("multi_image_groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_group"), F.count_if(F.col("classes") > 1).alias("mixed_groups"))
    mixed = sizes.filter("classes > 1").select("group_id", F.lit(True).alias("mixed"))
    placed = grouped.select("image_id", F.col("group_id").alias("near")).join(mixed, F.col("near") == F.col("group_id"), "left").select("image_id", "near", "mixed")
    out = rows.join(placed, "image_id", "left")
    # the image_id of a row that has a role may be a pending row's, as ids come from hashes
    out = out.withColumn("group_id", F.when(F.col("role").isNull(), F.col("near")).otherwise(F.col("group_id")))
    out = K.assign(out, F.col("mixed"), "excluded", "near-duplicate group spans classes").drop("near", "mixed")
    return out, {"near_duplicate_bound": float(bound), "near_duplicate_links": links, **facts.first().asDict()}


def hold_out(rows: DataFrame, least: int, undersized: str) -> tuple[DataFrame, dict]:
    """``undersized``: "refuse" raises where a class has fewer than two candidates, "keep" holds nothing of it out."""
    if undersized not in ("refuse", "keep"):
        raise ValueError("undersized is refuse or keep")
    pending = _pending(rows)
    if undersized == "keep":
        able = K.type_candidates(pending, least).filter("candidates >= 2").select("class_name")
        types = K.heldout_types(pending.join(able, "class_name", "left_semi"), least)
    else:
        types = K.heldout_types(pending, least)
    types = cut(types)
    groups = K.heldout_groups(pending, types).select("group_id").distinct().withColumn("held", F.lit(True))
    out = K.assign(rows.join(groups, "group_id", "left"), F.col("held"), "heldout_known").drop("held")
    return out, {"heldout_types": {r["class_name"]: r["fragment_type"] for r in types.orderBy("class_name").collect()}}  # one row a class


def split(rows: DataFrame, seed: str) -> DataFrame:
    placed = K.greedy_split(K.strata(_pending(rows)), seed)
    out = rows.join(placed, "group_id", "left")
    return out.withColumn("role", F.coalesce("role", "split")).drop("split")


def cascade(percentile: float = 0.0001, bits: int = 64, bands: int = 8, least: int = 5, undersized: str = "refuse", seed: str = "s") -> list[Stage]:
    """``bands`` is accepted and changes nothing: pairs no longer meet by runs of bits."""
    return [
        Stage("readable", readable),
        Stage("conflicts", conflicts),
        Stage("duplicates", K.exact_duplicates),
        Stage("near_groups", near_groups, {"percentile": percentile, "bits": bits}, version="2"),
        Stage("hold_out", hold_out, {"least": least, "undersized": undersized}),
        Stage("split", split, {"seed": seed}),
    ]


def curate(inventory: DataFrame, root: str, **settings) -> tuple[DataFrame, list[Done]]:
    """The curated inventory, and what each stage did; a second call over the same folder reads what still holds."""
    done = run_stages(inventory, cascade(**settings), root)
    return inventory.sparkSession.read.parquet(f"{done[-1].path}/rows"), done


def split_rows(curated: DataFrame, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """The rows of the splits; a probe carries its conflicting classes, as none of them is right alone."""
    named = F.when(F.col("role") == "ambiguity_probe", F.col("conflicting_classes")).otherwise(F.col("class_name"))
    return curated.filter(F.col("role").isin(*roles)).withColumn("class_name", named).drop("conflicting_classes", "exclusion_reason")
