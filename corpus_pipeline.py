"""A training-corpus pipeline over ``documents``: each stage's result is written and is the next one's input.

Toxic documents go, one document of each near-duplicate group stays, passages that
repeat are kept once, sources are mixed to target weights (a document comes out as
often as the mix takes it), and what is left is encoded.

Defined results: rows are told by their id and text (in mixing, all columns), never by
the id alone, so null and repeated ids lose and change nothing; wholly equal rows are
one document that may come out more than once. A null or empty text isn't toxic, repeats
nothing, stays once a row through mixing and has no tokens. A null source is a source of
its own. An empty table gives an empty result. Further columns are carried on to the
last stage, whatever their names. Very long texts are read whole in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import common, op2_jaccard, op4_mix, op7_bpe, op9_toxicity, op10_repeats


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half stay. A null text is empty and stays."""
    return op9_toxicity.keep_clean(docs, op9_toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_jaccard.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_repeats.remove_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_mix.take(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_bpe.digests(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixing", mixing), ("encoding", encoding)]

#: The rounding, the classifier and the encoder are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage returns is written as Parquet to the shared folder and reread.

    A stage's folder goes once the next one's is written; the last one is what the result is read from.
    """
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
            if before:
                common.remove(spark, before)
            before = path
    return docs
