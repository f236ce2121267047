"""Which documents contain which passages, whole and whatever stands around them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _contained(passages):
    """For mapInArrow over doc_id, text: each document's passages, all found in one walk over its text."""

    def run(batches):
        import ahocorasick

        of: dict[str, list[int]] = {}
        for item, text in passages.value:
            of.setdefault(text, []).append(item)
        everywhere, automaton = of.pop("", []), ahocorasick.Automaton()
        for text, items in of.items():
            automaton.add_word(text, items)
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1)):
                if text.is_valid:
                    met = {id(x): x for _, x in automaton.iter(text.as_py())} if of else {}
                    own = [*everywhere, *(item for x in met.values() for item in x)]
                    at += [i] * len(own)
                    found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(found, pa.int64())], names=["doc_id", "item_id"])

    return run


def benchmark_pairs(docs: DataFrame, items: DataFrame, most_chars: int = 16_000_000) -> DataFrame:
    """doc_id, item_id: which texts of ``docs`` contain the whole text of which of ``items`` (item_id, text); each pair once.

    The passages travel to the tasks, in parts of about ``most_chars`` characters (one scan of ``docs`` each), and each
    text is walked once for all passages of a part; nothing but the pairs is shuffled. A null text contains and is
    contained in nothing, an empty passage is in every other text. A null id stays null.
    """
    passages = items.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts = max(1, -(-(passages.agg(F.sum(F.length("text"))).first()[0] or 0) // most_chars))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for part in range(parts):
        own = passages.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(parts)) == part).collect()  # about most_chars
        sent = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own])
        found = rows.mapInArrow(_contained(sent), "doc_id long, item_id long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
