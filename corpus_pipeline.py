"""From raw documents to packed sequences: five stages, each one of the llm operators.

Every stage but the last returns all columns of its input, whatever else they are called. Toxic documents go; of each group of near duplicates one stays; repeated passages are cut out;
documents with benchmark passages go; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmuration.llm import decontaminate, ngram_join, packing, shared, suffix_repeats, toxicity

BATCH_BYTES = 8 << 20  # all stages run in the same executors, whose memory doesn't shrink after a stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under one half. A null or empty text has the score of no tokens and stays; repeated rows are each scored."""
    shared.prepare(spark, BATCH_BYTES)
    return toxicity.drop_toxic(docs, shared.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near duplicates. Texts without words, and rows with a null doc_id, stay; so do
    rows that repeat a doc_id that stays."""
    shared.prepare(spark, BATCH_BYTES)
    return ngram_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every passage of 100 bytes or more only where it occurs first. Null texts stay null; a document of which nothing is left stays, empty;
    repeated rows of one document are cut alike."""
    shared.prepare(spark, BATCH_BYTES)
    return suffix_repeats.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item. Null and empty texts, and rows with a null doc_id, stay."""
    shared.prepare(spark, BATCH_BYTES)
    return decontaminate.drop_contaminated(docs, shared.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and the sequences that they are in; a text without words is one piece of none, in no sequence. Repeated rows are packed each."""
    shared.prepare(spark, BATCH_BYTES)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A conditional random field and best fit have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again. What a stage wrote on its way is removed after it."""
    docs = shared.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with shared.scratch(spark, kept := []):
            docs = shared.materialize(stage(spark, docs, sf_dir))
            kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
