"""Dataset curation: a cascade of stages, each of which gives roles only to rows that have none yet.

Frames have image_id, path, class_name, fragment_type, sha256, and carry role and exclusion_reason
(null until set).
"""

from __future__ import annotations

import hashlib
import re
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetra.operators.distances import contracted
from vetra.operators.folds import ordered_fold


#: What stands between words.
_APART = re.compile(rb"[^a-z0-9]+")


def begin(rows: DataFrame) -> DataFrame:
    """No row has a role yet."""
    return rows.withColumns({k: F.lit(None).cast("string") for k in ("role", "exclusion_reason")})


def assign(rows: DataFrame, where: Column, role: str, why: str | None = None) -> DataFrame:
    """Give ``role`` to rows that have none and for which ``where`` holds."""
    hit = F.col("role").isNull() & F.coalesce(where, F.lit(False))
    out = rows.withColumn("exclusion_reason", F.when(hit, F.lit(why)).otherwise(F.col("exclusion_reason")))
    return out.withColumn("role", F.when(hit, F.lit(role)).otherwise(F.col("role")))


def derive_id(prefix: str, sha256: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(sha256, 1, 12))


def normalise_name(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Drop a leading crop mark and trailing copy numbers, lower-case, squeeze white space, then apply aliases."""
    out = F.regexp_replace(name, r"(?i)^cropped_", "")
    out = F.regexp_replace(out, r"(\s*\(\d+\)|\s+\d+)+$", "")
    out = F.trim(F.regexp_replace(F.lower(out), r"\s+", " "))
    for k, v in (aliases or {}).items():
        out = F.when(out == k, v).otherwise(out)
    return out


def conflict_hashes(rows: DataFrame) -> DataFrame:
    """sha256 that stand under more than one class, with the classes joined by a pipe in order."""
    classes = F.array_sort(F.collect_set("class_name"))
    return rows.groupBy("sha256").agg(classes.alias("classes")).filter(F.size("classes") > 1).select("sha256", F.array_join("classes", "|").alias("conflicting_classes"))


def _first_paths(rows: DataFrame) -> DataFrame:
    """``rows`` with first_path: the first path of the pending rows of the same hash, where there are several.

    Firsts are aggregated before the shuffle and joined back, which splits a hash that very many rows have.
    """
    pending = rows.filter("role IS NULL AND sha256 IS NOT NULL").groupBy("sha256")
    several = pending.agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    return rows.join(several, "sha256", "left")


def resolve_conflicts(rows: DataFrame) -> DataFrame:
    """The first path of a conflicting hash becomes a probe, the others go. Rows without a hash conflict with none."""
    marked = _first_paths(rows).join(conflict_hashes(rows.filter("role IS NULL")), "sha256", "left")
    marked = assign(marked, F.col("conflicting_classes").isNotNull() & (F.col("path") == F.col("first_path")), "ambiguity_probe")
    marked = assign(marked, F.col("conflicting_classes").isNotNull(), "excluded", "label-conflict duplicate copy")
    return marked.drop("first_path")


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """Within a hash, pending rows after the first by path go. Rows without a hash are copies of none."""
    return assign(_first_paths(rows), F.col("path") > F.col("first_path"), "excluded", "exact duplicate").drop("first_path")


#: Words whose hashes a task remembers.
MEMO = 500_000


def simhash60(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, hash: the 60-bit SimHash of distinct words, hashed by the head of their MD5.

    Each text is counted where it is read, so neither words nor texts are shuffled. ``key`` names a row.
    """

    def run(batches):
        memo: dict[bytes, int] = {}
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int64)
            for i, x in enumerate(batch.column(1)):
                words = set(_APART.split(x.as_py() or b"")) - {b""}
                if len(memo) > MEMO:
                    memo.clear()
                hashes = np.empty(len(words), np.uint64)
                for k, w in enumerate(words):
                    if (h := memo.get(w)) is None:
                        h = memo[w] = int(hashlib.md5(w).hexdigest()[:15], 16)
                    hashes[k] = h
                ones = np.zeros(64, np.int64)
                for at in range(0, len(hashes), 65_536):
                    ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                found[i] = np.packbits(ones * 2 > len(words), bitorder="little").view(np.int64)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=[key, "hash"])

    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("hash", T.LongType())])
    return rows.select(key, F.lower(text).cast("binary").alias("text")).mapInArrow(run, schema)


def percentile_of_histogram(histogram: DataFrame, p: float) -> DataFrame:
    """One row: the percentile of distances by their numbers; a histogram has at most 65 rows."""
    return histogram.agg(F.percentile("distance", F.lit(p), F.col("n")).alias("bound"))


def near_links(rows: DataFrame, below: float, bands: int = 8, bits: int = 64) -> DataFrame:
    """Pairs a < b (image_id) whose hashes differ in fewer than ``below`` bits.

    Hashes that close agree in at least one of as many runs of bits as the bound, so an equi-join on
    runs finds every pair.
    """
    runs = max(bands, ceil(below))
    if runs > bits:
        raise ValueError(f"hashes of {bits} bits have no {runs} runs")
    edges = [i * bits // runs for i in range(runs + 1)]
    run = lambda lo, hi: F.call_function("shiftrightunsigned", F.col("hash"), F.lit(lo)).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1).cast("long"))
    keyed = rows.select("image_id", "hash", F.posexplode(F.array(*[run(lo, hi) for lo, hi in zip(edges, edges[1:])])).alias("band", "bits"))
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.image_id") < F.col("b.image_id")))
    distance = F.bit_count(F.col("a.hash").bitwiseXOR(F.col("b.hash")))
    return met.select(F.col("a.image_id").alias("a"), F.col("b.image_id").alias("b"), distance.alias("distance")).filter(F.col("distance") < below).distinct()


def group_links(rows: DataFrame, below: float, bands: int = 8, bits: int = 64) -> DataFrame:
    """Links a, b (image_id) that span the groups of ``near_links``: equal hashes are one node, so copies make no pairs."""
    rows = rows.filter(F.lit(below > 0))
    firsts = rows.groupBy("hash").agg(F.min("image_id").alias("first"))
    apart = near_links(firsts.select(F.col("first").alias("image_id"), "hash"), below, bands, bits).select("a", "b")
    return apart.unionByName(rows.join(firsts, "hash").filter("image_id <> first").select(F.col("first").alias("a"), F.col("image_id").alias("b")))


def group_roots(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root: the smallest id that each linked node reaches; labels spread until nothing changes."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    both = _cut(both)
    roots = _cut(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root")))
    for _ in range(rounds):
        near = both.join(roots.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", F.least("root", "near").alias("root"), (F.col("near") < F.col("root")).alias("moved"))
        # pointer jumping: a root's own root is as good
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
        step = _cut(step.join(jump, "root", "left").select("node", F.least("root", F.coalesce("further", "root")).alias("root"), (F.col("moved") | (F.coalesce("further", "root") < F.col("root"))).alias("moved")))
        roots = step.select("node", "root")
        if step.filter("moved").isEmpty():
            return roots
    raise RuntimeError("groups have not settled")


#: Links that a task of ``hash_roots`` holds.
TASK_LINKS = 8_000_000


def hash_roots(links: DataFrame, most: int = TASK_LINKS) -> DataFrame:
    """node, root as ``group_roots`` gives them for links between hashes (long), but for the roots themselves.

    Tasks of at most ``most`` links make stars of them, again while that leaves far fewer; what doesn't fit a task then
    goes through the rounds of ``group_roots``.
    """
    links = _cut(links)
    left = links.count()
    while (tasks := -(-left // most)) > 1:
        links = _cut(contracted(links, tasks, most))
        before, left = left, links.count()
        if left > 0.7 * before:
            return group_roots(links).filter("node <> root")
    return _cut(contracted(links, 1, 2 * most)).withColumnsRenamed({"a": "node", "b": "root"})


def _cut(df: DataFrame) -> DataFrame:
    from vetra.plans.session import cut

    return cut(df)


def group_ids(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with root (its own id where unlinked) and group_id: g and the root, numbers with at least four digits."""
    out = rows.join(roots.withColumnRenamed("node", "image_id"), "image_id", "left").withColumn("root", F.coalesce("root", "image_id"))
    named = isinstance(rows.schema["image_id"].dataType, T.StringType)
    return out.withColumn("group_id", F.concat(F.lit("g-"), "root") if named else F.format_string("g%04d", F.col("root")))


def hash_groups(rows: DataFrame, below: float, bands: int = 8, bits: int = 64) -> DataFrame:
    """``rows`` with root and group_id, as ``group_ids`` over ``near_links`` gives them.

    Components are of distinct hashes, so a crowd of equal ones is one node; its rows come back by a join on the hash.
    Rows without a hash stand alone, and where ``below`` isn't positive, all do.
    """
    firsts = _cut(rows.filter(F.col("hash").isNotNull() & F.lit(below > 0)).groupBy("hash").agg(F.min("image_id").alias("image_id")))
    roots = group_roots(near_links(firsts, below, bands, bits).select("a", "b")).withColumnRenamed("node", "image_id")
    by_hash = firsts.join(roots, "image_id", "left").select("hash", F.coalesce("root", "image_id").alias("root"))
    found = rows.join(by_hash, "hash", "left").withColumn("root", F.coalesce("root", "image_id"))
    named = isinstance(rows.schema["image_id"].dataType, T.StringType)
    return found.withColumn("group_id", F.concat(F.lit("g-"), "root") if named else F.format_string("g%04d", F.col("root")))


def linked_groups(rows: DataFrame, links: DataFrame, alike: bool = True) -> DataFrame:
    """``rows`` with root and group_id as ``hash_groups`` gives them, from links a, b between hashes; equal hashes belong together if ``alike``."""
    firsts = _cut(rows.filter(F.col("hash").isNotNull() & F.lit(alike)).groupBy("hash").agg(F.min("image_id").alias("first")))
    heads = _cut(firsts.join(hash_roots(links).withColumnsRenamed({"node": "hash", "root": "head"}), "hash", "left").select("hash", "first", F.coalesce("head", "hash").alias("head")))
    roots = heads.join(heads.groupBy("head").agg(F.min("first").alias("root")), "head").select("hash", "root")
    found = rows.join(roots, "hash", "left").withColumn("root", F.coalesce("root", "image_id"))
    named = isinstance(rows.schema["image_id"].dataType, T.StringType)
    return found.withColumn("group_id", F.concat(F.lit("g-"), "root") if named else F.format_string("g%04d", F.col("root")))


def count_links(rows: DataFrame, below: float, bands: int = 8, bits: int = 64) -> int:
    """How many pairs of rows ``near_links`` gives, from distinct hashes and how often each occurs."""
    counted = _cut(rows.filter(F.col("hash").isNotNull() & F.lit(below > 0)).groupBy("hash").agg(F.min("image_id").alias("image_id"), F.count(F.lit(1)).alias("n")))
    n = counted.select("image_id", "n")
    apart = near_links(counted, below, bands, bits).join(n.withColumnsRenamed({"image_id": "a", "n": "na"}), "a").join(n.withColumnsRenamed({"image_id": "b", "n": "nb"}), "b")
    between = apart.agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0))).first()[0]
    return between + counted.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0))).first()[0]


def mixed_groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("group_id").agg(F.count_distinct("class_name").alias("classes"), F.count(F.lit(1)).alias("images")).filter("classes > 1")


def type_candidates(rows: DataFrame, least: int) -> DataFrame:
    """class_name, candidates: how many of its fragment types have ``least`` images or more."""
    counts = rows.groupBy("class_name", "fragment_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("class_name").agg(F.count_if(F.col("n") >= least).alias("candidates"))


def heldout_types(rows: DataFrame, least: int) -> DataFrame:
    """Per class the fragment type with the fewest images, of those with ``least`` or more; ties by name.

    A class with fewer than two candidates is an error: nothing of it could be learned.
    """
    counts = rows.groupBy("class_name", "fragment_type").agg(F.count(F.lit(1)).alias("n"))
    candidates = F.count_if(F.col("n") >= least)
    best = counts.groupBy("class_name").agg(F.min(F.when(F.col("n") >= least, F.struct("n", "fragment_type"))).alias("m"), candidates.alias("candidates"))
    refused = F.raise_error(F.concat(F.lit("fewer than two fragment types to hold out of class "), F.coalesce("class_name", F.lit("null"))))
    # a filter, as a column that nothing reads would be pruned and its error with it
    checked = best.filter(F.when(F.col("candidates") < 2, refused.cast("boolean")).otherwise(F.lit(True)))
    return checked.select("class_name", F.col("m.fragment_type").alias("fragment_type"), F.col("m.n").alias("n"))


def heldout_groups(rows: DataFrame, types: DataFrame) -> DataFrame:
    """Whole groups that contain a row of a held-out type."""
    hit = rows.join(types.select("class_name", "fragment_type"), ["class_name", "fragment_type"], "left_semi").select("group_id").distinct()
    return rows.join(hit, "group_id", "left_semi")


def strata(rows: DataFrame) -> DataFrame:
    """Per group its most frequent class and fragment type (ties to the smallest) and size."""
    return rows.groupBy("group_id").agg(F.mode("class_name", True).alias("class_name"), F.mode("fragment_type", True).alias("fragment_type"), F.count(F.lit(1)).alias("size"))


SPLITS = (("train", 0.7), ("validation", 0.15), ("test", 0.15))


def greedy_split(groups: DataFrame, seed: str = "s") -> DataFrame:
    """Per stratum, groups in the order of a seeded hash go to the split that lacks most; ties to the larger ratio, then the first.

    ``groups``: group_id, class_name, fragment_type, size. The rule is sequential within a stratum: its groups are sorted
    and pass through one task, which holds three sums; the stratum's total comes before them as a row of its own.
    """
    stratum = ["class_name", "fragment_type"]
    size = F.col("size").cast("double").alias("size")
    items = groups.select(*stratum, F.md5(F.concat(F.lit(seed), "group_id").cast("binary")).alias("order"), "group_id", size, F.lit(False).alias("total"))
    totals = groups.groupBy(*stratum).agg(F.sum("size").cast("double").alias("size"))
    totals = totals.select(*stratum, F.lit("").alias("order"), F.lit(None).cast(items.schema["group_id"].dataType).alias("group_id"), "size", F.lit(True).alias("total"))

    def step(state: dict, row: dict) -> str | None:
        if row["total"]:
            state["total"] = row["size"]
            return None
        best = max(SPLITS, key=lambda s: s[1] * state["total"] - state[s[0]])[0]  # the first of the largest
        state[best] += row["size"]
        return best

    folded = ordered_fold(totals.unionByName(items), stratum, [F.desc("total"), "order", "group_id"], lambda: dict.fromkeys([n for n, _ in SPLITS], 0.0), step, "split", T.StringType())
    return folded.filter("NOT total").select("group_id", "split")


def class_halves(classes: DataFrame, fraction: float, seed: str = "ood") -> DataFrame:
    """Classes in the order of a seeded hash: the first round-half-even(fraction n) calibrate, the others evaluate."""
    order = W.orderBy(F.md5(F.concat(F.lit(seed), "class_name").cast("binary")), "class_name")
    ranked = classes.select("class_name").distinct().withColumn("nth", F.row_number().over(order))  # one row a class
    n = F.count(F.lit(1)).over(W.partitionBy())
    return ranked.withColumn("role", F.when(F.col("nth") <= F.bround(n * F.lit(fraction)), "ood_calibration").otherwise("ood_evaluation")).select("class_name", "role")


def per_class_sample(rows: DataFrame, n: int, seed: str = "pick") -> DataFrame:
    """Per class the first ``n`` unique images in the order of a seeded hash."""
    once = F.row_number().over(W.partitionBy("class_name", "sha256").orderBy("key", "image_id"))
    nth = F.row_number().over(W.partitionBy("class_name").orderBy("key", "image_id"))
    keyed = rows.withColumn("key", F.md5(F.concat(F.lit(seed), F.col("image_id").cast("string")).cast("binary")))
    unique = keyed.withColumn("once", once).filter("once = 1")
    return unique.withColumn("nth", nth).filter(F.col("nth") <= n).select("class_name", "image_id", "nth")
