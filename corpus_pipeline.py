"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

All but the last return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetra.llm import exactdedup, langid, mixing, nearcopies, packing
from vetra.llm.common import cut, set_aside, shared_path, table

#: Part of the words that the mix takes.
SHARE = 0.5
#: Ids (8 bytes each) that are broadcast at most.
MOST_BROADCAST = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in none of the learned languages, or has no letter (or is null), go.

    Only the text decides; nulls in other columns, repeated rows and columns of any name stay as they are.
    """
    return langid.keep_identified(docs, langid.fit(docs.filter(~langid.held_out(3, 1))))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased; null as empty), the one with the largest doc_id stays.

    Rows that repeat that id and text all stay; a null id stays only where all ids of its text are null.
    """
    rows, back = set_aside(docs, "doc_id", "text")
    return exactdedup.exact_dedup(rows).filter("kept").select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (Jaccard similarity 0.8 or more of distinct five-word shingles), the one with the smallest doc_id stays.

    SimHash and its vantage-point trees find them, the shingles decide. Ids name documents here: rows
    that share an id go or stay together; rows without one stay. A null text counts as empty.
    """
    gone = cut(nearcopies.near_copies(docs).filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    if gone.count() <= MOST_BROADCAST:  # else both sides are shuffled
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sampling by calibrated probabilities takes; sources and languages without a target, and null, keep their share.

    Rows that repeat an id get one decision; a null id draws by its text; a null text has no words.
    """
    rows, back = set_aside(docs, "doc_id", "text", "lang", "source")
    return mixing.mix(rows, mixing.document_dimensions(), mixing.TARGETS, SHARE, whole=True).filter("mix_kept").select(*back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of every document; a null text is the end token alone, repeated rows are packed as often."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_to_targets),
    ("best_fit_packing", pack),
]
#: Language, near-copy and packing stages have no SQL form; tests hold each stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
