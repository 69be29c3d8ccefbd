"""A training-data pipeline: rules, language, near duplicates, repeated passages, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; ``run`` writes every result as
Parquet and reads it again as the documents of the next stage.  All stages but the
last return the columns of their input.  A stage frees the scratch tables of the
stage before it, whose result has been written by then.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm import language_id, packing, quality_rules, scratch, similar, suffix_dedup

OWNER = "pipeline"

#: No stage of the whole can be put into SQL (token merges, exact binomial cutoffs, XXH64); tests/llm compares with brute force.
ORACLE_SQL = None


def _stage(function):
    def step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.drop_owned(OWNER)
        with scratch.owner(OWNER):
            return function(spark, docs, sf_dir)

    step.__name__, step.__doc__ = function.__name__, function.__doc__
    return step


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go; the model is fitted on the labelled training fold of the stage's input."""
    return language_id.keep_known(docs, language_id.fit(docs.where(~language_id.held_out())))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (five-word shingles, Jaccard 0.8 and more) stays, that with the smallest id."""
    return similar.keep_one(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that stand elsewhere too are cut out; n_chars follows the text, and no document goes."""
    cut = suffix_dedup.remove_repeats(docs, texts=True)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("language_id", language), ("near_dedup", near_duplicates), ("suffix_dedup", repeated_passages), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    results = scratch.Scratch(spark, "pipeline-stages")
    for nth, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if nth == len(STAGES) - 1:
            return out
        docs = results.save(out, name)
        if nth:
            results.drop(STAGES[nth - 1][0])
    return docs
