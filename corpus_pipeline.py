"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsense.llm import decontamination, mixing, ngram_jaccard, suffix_dedup, toxicity
from airsense.llm.tables import read
from airsense.sources.stored import store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def only(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    return only(toxicity.drop_toxic(docs, read(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near duplicates."""
    return only(ngram_jaccard.keep_one_of_each(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that occur again are cut from the texts; rows stay. n_chars
    counts the text that is left where something was cut."""
    cut = suffix_dedup.remove_repeats(docs.withColumn("before", F.octet_length("text")))
    return only(cut.withColumn("n_chars", F.when(F.octet_length("text") < F.col("before"), F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return only(decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents by probabilities that are calibrated to the target weights."""
    return mixing.sample(docs)


STAGES = (
    ("toxicity", reject_toxic), ("n-gram Jaccard join", one_of_each), ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", decontaminate), ("mixing sources to target weights", mix),
)

#: Learned scores and byte cuts have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return docs
