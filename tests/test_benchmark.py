"""Passages in documents, whatever stands around them."""

from tests.oracle import same
from vetra.queries import ORACLES, QUERIES
from vetra.operators.containment import benchmark_pairs


def test_same_as_sql_on_more_rows(spark):
    same(spark, QUERIES["benchmark_containment"], ORACLES["benchmark_containment"], "/root/testdata/sf0.1")


def test_borders_and_short_passages(spark):
    long = "one two three four five six seven eight nine ten eleven"
    items = {1: long, 2: "two three", 3: "!", 4: "", 5: None, 6: "élan " + long}
    docs = [f"x\n{long}", f"a\t{long}.", f'"{long}"', f"[{long}]", f"x{long}y", f"élan {long}", "one two three!", "", None]
    got = benchmark_pairs(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    want = {(i, k) for i, d in enumerate(docs) for k, p in items.items() if d is not None and p is not None and p in d}
    assert {tuple(r) for r in got.collect()} == want


def test_null_ids_and_parts(spark):
    """A row without an id keeps its pairs, however long the passage; passages in parts give the same."""
    long = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"x {long} y"), (None, f"{long} 😀"), (None, None), (1, long)], "doc_id long, text string")
    items = spark.createDataFrame([(1, long), (2, "two three"), (None, "four 😀"), (4, "eleven 😀"), (5, long)], "item_id long, text string")
    want = {(1, 1), (1, 2), (1, 5), (None, 1), (None, 2), (None, 4), (None, 5)}
    for most in (16_000_000, 40):
        rows = benchmark_pairs(docs, items, most).collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert benchmark_pairs(docs, items.limit(0)).count() == benchmark_pairs(docs.limit(0), items).count() == 0
