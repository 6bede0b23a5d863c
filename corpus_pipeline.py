"""A corpus made ready for training: five stages over whole documents.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept;
its result is written as Parquet and read again.  All but the last return the columns of
``documents``.  Each bounds the batches in which this session's rows go to Python, unless the
session does (:func:`arrays.batched`): that holds for what the session runs later too, and changes no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm import anchors, arrays, crf, minhash, packing, rule_ensemble
from sparkwarden.llm.storage import dropped, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go.

    Null, empty and wordless texts are rejected.  Rows that repeat, or whose doc_id is null, are judged each for itself;
    equal texts are judged alike, whatever their length.  Without usable labels every text with a word stays.  An
    empty table stays empty.  Columns beyond those of documents are dropped, whatever their names."""
    arrays.batched(spark)
    return rule_ensemble.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without one prevailing language go: none has half of the expected words.

    Null, empty and wordless texts are rejected.  Of equally probable languages the first in order counts.  Texts of any length are
    labelled whole.  Rows that repeat, or whose doc_id or lang is null, are labelled each for itself.  Without any lang every text
    with a word stays.  An empty table stays empty; further columns are dropped."""
    arrays.batched(spark)
    return crf.filtered(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least doc_id stays.

    Documents meet in 64 buckets of three values, so that next to no pair above the threshold is left out.
    Null, empty and wordless texts resemble nothing and stay.  Of several rows of one doc_id one stays: that of the
    least hash.  Rows with a null doc_id all stay.  Texts of any length are compared whole.  An empty table stays empty; further columns are dropped."""
    arrays.batched(spark)
    return minhash.deduplicated(docs, values=192, rows_per_band=3).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind; ``n_chars`` is that of the new text.

    No row goes: null stays null (``n_chars`` too), empty stays empty, repeated rows and null doc_ids are kept each.  Of overlapping finds the first
    counts, then the longest.  Texts of any length are read whole.  An empty table stays empty; further columns are dropped."""
    arrays.batched(spark)
    return anchors.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents packed into training windows of tokens.

    Null and empty texts are in no window; repeated rows are packed each, null doc_ids stay null; a text longer than a window fills
    several.  Of equally full windows the one opened first is taken.  An empty table gives no windows; further columns are ignored."""
    arrays.batched(spark)
    return packing.pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", windows)]

#: No stage of models, signatures or tokens can be expressed in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        if i:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
