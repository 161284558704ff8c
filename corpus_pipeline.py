"""The corpus pipeline: STAGES applied to documents in order, each over all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataflow.llm import linededup, minhash, packing, quality, toxicity
from strataflow.llm.common import discard, kept_rows, read, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier accepts."""
    return quality.accepted(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't predict to be toxic."""
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return kept_rows(docs, lambda texts: [s < 0.5 for s in model.score(texts)])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less every later occurrence of a passage of 50 words; those that are nothing else go."""
    return linededup.deduplicated(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, similarity 0.8 or more)."""
    return minhash.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs)


STAGES = [("quality", good), ("toxicity", harmless), ("line dedup", without_repeats), ("near dedup", distinct), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if k:  # the first stage reads the given table
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained classifiers and similarity search can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
