"""Exact search of a reference library, weighted class votes, and the curation of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vetra.functions.vectors import dot, let, mean, total
from vetra.operators.blocksearch import search_blocks

#: A library up to this size travels as one array to every task; larger ones are searched in blocks.
MOST_REFERENCES = 20_000


def library(refs: DataFrame) -> DataFrame:
    """One row: the whole library as an array of references (reference_id, class_name, fragment_type, v)."""
    item = F.struct("reference_id", "class_name", "fragment_type", F.col("v").alias("r"))
    return refs.agg(F.array_sort(F.collect_list(item)).alias("refs"))


def search(queries: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """``queries`` (with v) plus matches: the k most similar references, best first, ties to the smaller id.

    Every query meets the library within its own task and nothing is shuffled, while the library has at most
    ``MOST_REFERENCES``; beyond, ``blocksearch`` gives the same rows.
    """
    if refs.count() > MOST_REFERENCES:
        return search_blocks(queries, refs, k)[0]
    scored = lambda v: F.transform("refs", lambda r: F.struct((-dot(v, r["r"])).alias("far"), r["reference_id"].alias("reference_id"), r["class_name"].alias("class_name"), r["fragment_type"].alias("fragment_type")))
    best = F.slice(F.array_sort(let(F.col("v"), scored)), 1, k)
    ranked = F.transform(best, lambda m, i: F.struct((i + 1).alias("rank"), (-m["far"]).alias("similarity"), m["reference_id"].alias("reference_id"), m["class_name"].alias("class_name"), m["fragment_type"].alias("fragment_type")))
    return queries.join(F.broadcast(library(refs))).withColumn("matches", ranked).drop("refs")


def class_support(matches: Column) -> Column:
    """Classes among the matches with count and weighted share, best supported first.

    A match weighs its similarity, or nothing if that is negative; weights are summed in rank order.
    Ties go to the best match's class, then by name.
    """
    weight = lambda m: F.greatest(m["similarity"], F.lit(0.0))
    weights = lambda ms: total(F.transform(ms, weight))

    def support(ms: Column, whole: Column) -> Column:
        names = F.array_distinct(F.transform(ms, lambda m: m["class_name"]))

        def one(name: Column) -> Column:
            own = F.filter(ms, lambda m: m["class_name"] == name)
            share = F.when(whole > 0, weights(own) / whole).otherwise(0.0)
            return F.struct((-share).alias("order"), (ms[0]["class_name"] != name).alias("other"), name.alias("class_name"), F.size(own).alias("count"), share.alias("weighted_share"))

        return F.transform(F.array_sort(F.transform(names, one)), lambda s: F.struct(s["class_name"].alias("class_name"), s["count"].alias("count"), s["weighted_share"].alias("weighted_share")))

    return let(matches, lambda ms: let(weights(ms), lambda whole: support(ms, whole)))


def first_per_class(rows: DataFrame, per_class: int) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("label").orderBy("vec_id"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= per_class).drop("nth")


def number_references(rows: DataFrame) -> DataFrame:
    """Dense numbers in class, then id order: vector_id from 0 and reference_id from REF0001.

    Ranks within classes are added to the classes' running sizes, so no task sees more than a class.
    """
    sizes = rows.groupBy("class_name").count()
    offset = F.sum("count").over(W.orderBy("class_name").rowsBetween(W.unboundedPreceding, -1))  # one row a class
    offsets = sizes.select("class_name", F.coalesce(offset, F.lit(0)).alias("offset"))
    nth = F.row_number().over(W.partitionBy("class_name").orderBy("image_id"))
    placed = rows.withColumn("nth", nth).join(offsets, "class_name")
    number = (F.col("offset") + F.col("nth")).cast("long")
    return placed.withColumn("vector_id", number - 1).withColumn("reference_id", F.format_string("REF%04d", number)).drop("nth", "offset")


def medoids(rows: DataFrame) -> DataFrame:
    """For each cluster the member with the largest dot product with the mean; ties to the smaller id. ``rows``: cluster, id, v."""
    parts = rows.select("cluster", F.posexplode("v").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("x"))
    centres = parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centre"))
    scored = rows.join(centres, "cluster").withColumn("score", F.round(dot(F.col("v"), F.col("centre")), 9))
    return scored.groupBy("cluster").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("m")).select("cluster", "m.id", "m.score")


def leaks(references: DataFrame, others: DataFrame) -> DataFrame:
    """Non-training rows whose id is a reference's, or else whose hash is. Both have image_id, sha256."""
    by_id = others.join(references.select("image_id"), "image_id", "left_semi").select("image_id", F.lit("id").alias("by"))
    rest = others.join(references.select("image_id"), "image_id", "left_anti")
    return by_id.unionByName(rest.join(references.select("sha256").distinct(), "sha256", "left_semi").select("image_id", F.lit("sha256").alias("by")))


def refuse_leaks(references: DataFrame, others: DataFrame) -> None:
    """Raises where ``leaks`` finds a row, and names the first few."""
    found = leaks(references, others).orderBy("image_id").limit(5).collect()
    if found:
        raise ValueError("references outside the training rows: " + ", ".join(f"{r['image_id']} (by {r['by']})" for r in found))


def mean_similarity(matches: Column, k: int) -> Column:
    return mean(F.transform(F.slice(matches, 1, k), lambda m: m["similarity"]))
