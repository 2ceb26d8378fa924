"""The corpus pipeline: documents in, packed training sequences out.

Five stages, each written as Parquet and read again by the next: documents of
low quality go, one document of each near-duplicate group stays, repeated byte
strings are removed from the texts, documents that leak benchmark items go, and
the rest is tokenised and packed.  All stages but the last return the columns of
``documents``.  SQL can't express the classifier, the byte strings or the linear
program, so there is no oracle; ``tests/llm`` holds each stage against a
brute-force version.

Defined cases, in all stages: a null text counts as empty, a null id as an id
like any other, rows that repeat an id (with equal or different texts) are
documents of their own, an empty table gives an empty result, and further columns,
whatever their names, are carried along by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depinfer.llm import op2_decontaminate, op5_suffix_dedup, op7_packing, op8_quality, op9_minhash
from depinfer.llm.common import mark, materialize, sweep, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.7; a text's score is its own, so equal texts go or stay together.

    A null text is scored as the empty one; without usable labels all scores are
    0.5 and nothing stays.
    """
    return op8_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more, the document with the smallest id.

    Of equal ids one row stays, a null id only if its group has no other; texts
    without words, null ones too, are in no group and all stay.  The op9 query has
    its own contract of 0.85.
    """
    return op9_minhash.deduplicate(docs, part=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of 200-byte strings that also start elsewhere; a text may become empty, a null one stays null."""
    return op5_suffix_dedup.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no template with a benchmark item; those without words stay."""
    return op2_decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, sequences and offsets; an empty or null text is a piece of its end id alone."""
    return op7_packing.pack(docs, keep_ids=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; what a stage has written besides its result is removed when that is complete."""
    docs = table(spark, sf_dir, "documents")
    since = mark()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        sweep(spark, since, keep=(docs.work_path,))
    return docs
