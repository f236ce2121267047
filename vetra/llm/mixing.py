"""Mixing to target weights: token weights raked to marginals, then documents sampled by probability.

Documents fall into cells by the classes of their dimensions (source, language, topic). Iterative
proportional fitting scales the cells' tokens to each dimension's target shares in turn, and holds
every cell to the tokens it has, as no document is taken twice. A document is kept where a uniform
number, drawn from a hash of its id, is below its cell's fitted share of tokens.

DataFrame operations only. One aggregation with map-side sums makes the cells; there are at most as
many as the product of the target tables' sizes (checked), so fitting runs in one small partition and
the fitted cells are broadcast. No document is shuffled.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vetra.llm.common import cut

OTHER = "other"
MOST_CELLS = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _class(value: Column, targets: dict[str, float]) -> Column:
    """The value where it has a target of its own, else ``other``; null is other."""
    return F.when(value.cast("string").isin(*targets), value.cast("string")).otherwise(OTHER)


def _target(cls: Column, targets: dict[str, float]) -> Column:
    out = F.lit(float(targets.get(OTHER, 0.0)))
    for k, v in targets.items():
        out = F.when(cls == k, F.lit(float(v))).otherwise(out)
    return out


def _whole_target(k: str, targets: dict[str, float]) -> Column:
    """Targets with a share for ``other``: the part of all tokens that it has; the others give way in proportion."""
    spare = F.coalesce(F.try_divide(F.sum(F.when(F.col(k) == OTHER, F.col("tokens")).otherwise(0)).over(W.partitionBy()), F.sum("tokens").over(W.partitionBy())), F.lit(0.0))
    return F.when(F.col(k) == OTHER, spare).otherwise(_target(F.col(k), targets) * (F.lit(1.0) - spare))


def fit_cells(cells: DataFrame, targets: dict[str, dict[str, float]], share: float, rounds: int, whole: bool = False) -> DataFrame:
    """``cells`` (a class column per dimension, tokens) with probability, the part of its tokens to take."""
    aims = {k: f"{k}_aim" for k in targets}
    cells = cells.repartition(1).withColumns({aims[k]: _whole_target(k, own) if whole and OTHER not in own else _target(F.col(k), own) for k, own in targets.items()})
    w = cells.withColumn("goal", F.sum("tokens").over(W.partitionBy()) * F.lit(share)).withColumn("w", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for k, aim in aims.items():
            total = F.sum("w").over(W.partitionBy(k))
            w = w.withColumn("w", F.coalesce(F.try_divide(F.col("w") * F.col(aim) * F.col("goal"), total), F.lit(0.0)))
        w = w.withColumn("w", F.least("w", F.col("tokens").cast("double")))
    return w.select(*targets, F.round(F.coalesce(F.try_divide("w", F.col("tokens").cast("double")), F.lit(1.0)), 9).alias("probability"))


def mix(docs: DataFrame, dimensions: dict[str, Column], targets: dict[str, dict[str, float]], share: float = 0.5, rounds: int = 8, seed: int = 7, whole: bool = False) -> DataFrame:
    """``docs`` with mix_<dimension>, mix_tokens, mix_probability and mix_kept; no row is dropped here.

    ``targets`` has each dimension's shares by value; values without one, and null, are ``other``
    (share 0 unless given, so such documents are not taken; with ``whole`` the share of tokens that they
    have, and the given shares are of the rest). ``share`` is the part of all tokens to
    take. A null text has no tokens, and one of any length is counted whole; cells without tokens are kept whole. Rows that repeat an id get
    one decision; a null id draws by its text. Columns of those names are replaced. An empty table gives an empty result.
    """
    if prod(len(t) + 1 for t in targets.values()) > MOST_CELLS:
        raise ValueError("too many combinations of targets to broadcast")
    names = {k: f"mix_{k}" for k in dimensions}
    docs = docs.drop("mix_probability", "mix_kept")
    marked = docs.withColumns({names[k]: _class(c, targets[k]) for k, c in dimensions.items()} | {"mix_tokens": word_count(F.col("text"))})
    cells = cut(marked.groupBy(*names.values()).agg(F.sum("mix_tokens").alias("tokens")))
    fitted = cut(fit_cells(cells, {names[k]: targets[k] for k in dimensions}, share, rounds, whole))
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    out = marked.join(F.broadcast(fitted.withColumnRenamed("probability", "mix_probability")), list(names.values()))
    return out.withColumn("mix_kept", uniform(key, seed) < F.col("mix_probability"))


#: The production mix of ``documents``: equal sources, and fixed shares of languages and topics.
SOURCES = {f"src{i}": 0.05 for i in range(20)}
LANGUAGES = {"en": 0.52, "fr": 0.18, "de": 0.18, "es": 0.12}
TOPICS = {"0": 0.3, "1": 0.25, "2": 0.25, "3": 0.2}
TARGETS = {"source": SOURCES, "lang": LANGUAGES, "topic": TOPICS}


def document_dimensions() -> dict[str, Column]:
    """``documents`` has no topic column: four strata by a hash of the whole text stand in for one."""
    topic = F.conv(F.substring(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), 1, 1), 16, 10).cast("int") % 4
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic.cast("string")}


def mixed_documents(docs: DataFrame, share: float = 0.5) -> DataFrame:
    """Every document with its cell, probability and decision under the production mix."""
    out = mix(docs, document_dimensions(), TARGETS, share)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("mix_source").alias("source_class"), F.col("mix_lang").alias("lang_class"),
        F.col("mix_topic").alias("topic_class"), F.col("mix_tokens").alias("n_words"), F.col("mix_probability").alias("probability"), F.col("mix_kept").alias("kept"),
    )


def mixing_sql(share: float = 0.5, rounds: int = 8, seed: int = 7) -> str:
    """DuckDB SQL for ``mixed_documents``."""

    def case(col: str, targets: dict[str, float]) -> str:
        return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in targets.items()) + " ELSE 0::DOUBLE END"

    def cls(col: str, targets: dict[str, float]) -> str:
        return f"CASE WHEN {col} IN ({', '.join(repr(k) for k in targets)}) THEN {col} ELSE 'other' END"

    steps = [
        f"""d AS (SELECT doc_id, {cls('source', SOURCES)} AS source_class, {cls('lang', LANGUAGES)} AS lang_class,
            (('0x' || substr(md5(coalesce(text, '')), 1, 1))::INT % 4)::VARCHAR AS topic_class,
            len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_words,
            coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS k FROM documents)""",
        f"""c0 AS (SELECT source_class, lang_class, topic_class, sum(n_words)::BIGINT AS tokens, sum(n_words)::DOUBLE AS w,
            sum(sum(n_words)) OVER ()::BIGINT * {share}::DOUBLE AS goal FROM d GROUP BY ALL)""",
    ]
    n = 0
    for _ in range(rounds):
        for k in ("source", "lang", "topic"):
            steps.append(f"c{n + 1} AS (SELECT * REPLACE (coalesce(w * {case(k + '_class', TARGETS[k])} * goal / nullif(sum(w) OVER (PARTITION BY {k}_class), 0), 0) AS w) FROM c{n})")
            n += 1
        steps.append(f"c{n + 1} AS (SELECT * REPLACE (least(w, tokens::DOUBLE) AS w) FROM c{n})")
        n += 1
    return f"""WITH {', '.join(steps)},
        f AS (SELECT *, round(coalesce(w / nullif(tokens::DOUBLE, 0), 1), 9) AS probability FROM c{n})
        SELECT doc_id, source_class, lang_class, topic_class, n_words, probability,
               ('0x' || substr(md5('{seed}:' || k), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE < probability AS kept
        FROM d JOIN f USING (source_class, lang_class, topic_class)"""
