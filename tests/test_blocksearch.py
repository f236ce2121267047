"""Search in blocks gives the rows of the array search, and its bounds rule cells out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetra.operators import blocksearch, retrieval

SCHEMA = "reference_id string, class_name string, fragment_type string, v array<double>"


def tables(spark, n, asked, d=16, spread=0.1, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    x = centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::50] = x[7 % n]  # ties, to the smaller id
    refs = spark.createDataFrame([(f"R{(i * 37) % n:06d}", f"c{i % 5}", f"f{i % 3}", v.tolist()) for i, v in enumerate(x)], SCHEMA)
    q = np.concatenate([x[: asked // 2], rng.normal(size=(asked - asked // 2, d))])
    return spark.createDataFrame([(i, v.tolist(), "kept") for i, v in enumerate(q)], "id long, v array<double>, cell string"), refs


def rows(found):
    return {r["id"]: (r["cell"], tuple(map(tuple, r["matches"]))) for r in found.collect()}


@pytest.mark.parametrize(("n", "per_block", "per_queries", "most_cells"), [(400, 140, 25, 1024), (400, 30, 1000, 4), (5, 2, 7, 1024), (300, 1000, 40, 1)])
def test_same_rows_as_the_array_search(spark, n, per_block, per_queries, most_cells):
    queries, refs = tables(spark, n, 60)
    got, saved = blocksearch.search_blocks(queries, refs, 7, per_block, per_queries, most_cells)
    want = rows(retrieval.search(queries, refs, 7))
    assert rows(got) == want and len(want) == queries.count() and got.columns == ["id", "v", "cell", "matches"]
    assert saved["cells"] <= most_cells and saved["met"] <= saved["pairs"]


def test_bounds_rule_cells_out(spark):
    queries, refs = tables(spark, 2000, 40, spread=0.02)
    queries = queries.filter("id < 20")  # near the references
    got, saved = blocksearch.search_blocks(queries, refs, 5, per_block=100)
    assert saved["cells"] == 20 and saved["met"] < saved["pairs"] / 2
    assert rows(got) == rows(retrieval.search(queries, refs, 5))


def test_large_libraries_are_not_refused(spark):
    queries, few = tables(spark, 100, 10)
    many = few.unionByName(spark.range(100_000).select(F.format_string("X%d", "id").alias("reference_id"), F.lit("c").alias("class_name"), F.lit("f").alias("fragment_type"), F.array(*[(F.rand(i) - 0.5) * 0.01 for i in range(16)]).alias("v")))
    got = rows(retrieval.search(queries.limit(5), many.repartition(4), 3))
    assert len(got) == 5 and rows(retrieval.search(queries.limit(5), few, 3)).keys() == got.keys()
    assert all(len(m) == 3 and m[0][1] >= m[2][1] for _, m in got.values())
