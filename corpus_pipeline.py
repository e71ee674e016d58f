"""The corpus pipeline: language, quality, near duplicates, mixture, packing.

Each stage works on what its predecessor kept and is written as Parquet before the next
reads it. All but the last return the columns of documents, as they are but for texts that
lost lines: what a stage works out has names of its own.

Defined cases: documents whose text is null, empty or without a letter go at the first
stage; rows with a null id are judged as any other and kept once in the third stage; rows
that repeat an id and a text are one document from the third stage on; an empty table gives
no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import jaccard, langid, mixing, packing, quality
from panelloom.llm.common import Stash, ship, table

#: A document is rejected whose language is less than this share of the way from a guess among the languages to certainty.
MIN_CERTAINTY = 0.2


def least_score(model: dict | None) -> float:
    """The likelihood that a document's language needs, by the number of languages that were learned."""
    guess = 1 / max(1, len(model["langs"])) if model else 0.0
    return guess + MIN_CERTAINTY * (1 - guess)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are in a language; the network learns from these documents' own labels."""
    model = langid.train(langid.training_sample(docs))
    made = langid.with_language(docs, model, "_lang", "_likely")
    return made.filter((F.col("_lang") != langid.UNKNOWN) & (F.col("_likely") >= least_score(model))).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the quality rules, without lines that many share."""
    return quality.clean(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return jaccard.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits documents as often as their source's target says."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("quality rules", rules), ("n-gram Jaccard join", one_of_each), ("mixing to weights", mixture), ("packing", sequences)]
#: SQL can't express the trained language model, the tokenizer or the curve.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, stash = table(spark, sf_dir, "documents"), Stash(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        docs = made if k == len(STAGES) - 1 else stash.put(made)
    return docs
