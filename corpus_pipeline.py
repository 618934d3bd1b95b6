"""A training corpus from documents: toxic ones go, near-duplicates go, sources are mixed, texts are tokenised.

Every stage takes rows with null ids, texts or sources (a null text is an empty one, a null
source a source of its own), empty and very long texts, ties and repeated rows, empty tables, and
columns of any other name. What each does with them stands in its operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronobin.llm import mixing, sentencepieces, simhash, toxicity
from chronobin.llm.common import materialise, release, unused


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on this run's labels, does not predict to be toxic; null and empty texts, and all where no label is known, stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused("_toxicity", docs)
    return toxicity.with_scores(docs, model, into=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each group whose five-word shingles are similar; null, empty and blank texts are one group."""
    return simhash.deduplicate(docs, shingle=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; rows of one id are taken alike, texts without words never count."""
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids, the number of them, and whether they decode to the text; columns of those names are replaced."""
    return sentencepieces.tokenise(docs)


STAGES = [("toxicity", reject_toxic), ("simhash", drop_near_duplicates), ("mixing", mix_sources), ("sentencepiece", tokenise)]

#: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result is written as Parquet and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        after = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
        docs = before = after
    return docs
