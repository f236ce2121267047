"""The report of a curated table: all its counts from one scan, as a table, as JSON and as Markdown."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetra.operators.artifacts import markdown_table

#: Facets of a curated inventory; those of columns that it lacks are left out.
FACETS = {
    "all": [], "class": ["class_name"], "role": ["role"], "class_role": ["class_name", "role"], "exclusion": ["exclusion_reason"], "fragment": ["class_name", "fragment_type"],
    "format": ["format"], "mode": ["mode"], "size": ["width", "height"],
}


def curation_measures() -> dict[str, Column]:
    usable = F.coalesce(F.col("role").isin("train", "validation", "test", "heldout_known"), F.lit(False))
    return {"images": F.lit(True), "readable": F.coalesce("readable", F.lit(False)), "usable": usable}


def facet_counts(rows: DataFrame, facets: dict[str, list[str]], measures: dict[str, Column]) -> DataFrame:
    """facet, keys (array<string>, in the facet's order; null where a row has none), and for each measure how many rows hold it.

    One aggregation by grouping sets with map-side partials, so the table is read once whatever the number of facets. Facets
    of columns that ``rows`` lacks are left out; facets of the same columns are refused. No rows: only the facet of no columns has a row.
    """
    facets = {name: columns for name, columns in facets.items() if set(columns) <= set(rows.columns)}
    if len({frozenset(c) for c in facets.values()}) < len(facets):
        raise ValueError("two facets have the same columns")
    columns = sorted({c for of in facets.values() for c in of})
    # keys and measures get names of their own, which no column of the rows can clash with
    named = rows.select(*[F.col(f"`{c}`").cast("string").alias(f"k{i}") for i, c in enumerate(columns)], *[m.alias(f"m{i}") for i, m in enumerate(measures.values())])
    at = {c: f"k{i}" for i, c in enumerate(columns)}
    counts = [F.count_if(f"m{i}").alias(name) for i, name in enumerate(measures)]
    if not columns:
        return named.agg(*counts).select(F.lit(next(iter(facets))).alias("facet"), F.array().cast("array<string>").alias("keys"), *measures)
    sets = [[F.col(at[c]) for c in of] for of in facets.values()]
    every = [F.col(k) for k in at.values()]
    grouped = named.groupingSets(sets, *every).agg(F.grouping_id(*every).alias("absent"), *counts)
    bit = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    facet, keys = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for name, of in facets.items():
        is_it = F.col("absent") == sum(b for c, b in bit.items() if c not in of)
        facet = F.when(is_it, F.lit(name)).otherwise(facet)
        keys = F.when(is_it, F.array(*[F.col(at[c]) for c in of]).cast("array<string>")).otherwise(keys)
    out = grouped.select(facet.alias("facet"), keys.alias("keys"), *measures)
    whole = [name for name, of in facets.items() if not of]
    if not whole or not rows.isEmpty():
        return out
    return rows.sparkSession.createDataFrame([(whole[0], [], *[0] * len(measures))], out.schema)


def largest_keys(counts: DataFrame, most: int) -> DataFrame:
    """Per facet the ``most`` keys with the highest first measure, ties by key, with nth and values, how many there are."""
    from pyspark.sql import Window as W

    first = [c for c in counts.columns if c not in ("facet", "keys")][0]
    values = counts.groupBy("facet").agg(F.count(F.lit(1)).alias("values"))
    nth = F.row_number().over(W.partitionBy("facet").orderBy(F.desc(first), "keys"))
    return counts.withColumn("nth", nth).filter(F.col("nth") <= most).join(F.broadcast(values), "facet")  # one row a facet


def _line(text: str) -> str:
    return text.replace("|", "\\|").replace("\n", " ")


def markdown_report(title: str, counts: DataFrame, facets: dict[str, list[str]], facts: dict, most: int = 100) -> str:
    """Markdown: the facts, then a table a facet of its ``most`` largest keys; how many more there are is said."""
    measures = [c for c in counts.columns if c not in ("facet", "keys")]
    found: dict[str, list] = {}
    for r in largest_keys(counts, most).orderBy("facet", "nth").collect():  # at most ``most`` a facet
        found.setdefault(r["facet"], []).append(r)
    parts = [f"# {title}"]
    if facts:
        shown = lambda v: json.dumps(v, sort_keys=True) if isinstance(v, (dict, list)) else v
        parts.append(markdown_table([{"fact": k, "value": shown(v)} for k, v in facts.items()], ["fact", "value"]))
    for name, of in facets.items():
        if name not in found:
            continue
        rows = [{**dict(zip(of, [None if k is None else _line(k) for k in r["keys"]])), **{m: r[m] for m in measures}} for r in found[name]]
        parts.append(f"## {name}\n\n" + markdown_table(rows, [*of, *measures]))
        if (more := found[name][0]["values"] - len(rows)) > 0:
            parts.append(f"{more} more in the table of counts.")
    return "\n\n".join(parts) + "\n"


def write_report(rows: DataFrame, path: str, title: str, facts: dict, facets: dict[str, list[str]] = FACETS, most: int = 100) -> DataFrame:
    """Write <path>/counts (Parquet), <path>/json (a line a count, after one line of facts) and <path>/markdown; give the counts.

    ``rows`` (a curated inventory) are read once; JSON and Markdown come from the table of counts. JSON holds every count.
    """
    spark = rows.sparkSession
    facet_counts(rows, facets, curation_measures()).write.mode("overwrite").parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    counts.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/json/counts")
    _write_text(spark, json.dumps({"title": title, **facts}, sort_keys=True), f"{path}/json/facts")
    _write_text(spark, markdown_report(title, counts, facets, facts, most), f"{path}/markdown")
    return counts


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
