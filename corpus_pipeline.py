"""The corpus pipeline: quality classifier, near-duplicate removal, personal data, mixing, packing.

Each stage takes the documents that the one before kept and returns documents with the same columns, the last one
packed pieces. ``run`` applies them one after another, each result written to the shared folder and read again.

Cases: a null text is judged, kept, masked and packed as an empty one, and as a null it leaves the stages that return
documents; texts without words are copies of nothing and take no words in the mix, so it leaves them out; null ids and
sources are kept as such; repeated rows are copies of one another; ties are broken by hashes of the rows; without labels
to learn from the classifier gives everything its prior and rejects nothing; an empty table gives no rows at any stage.
Further columns go through unchanged, whatever their names. ``n_chars``, where there is one, follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import jaccard_join, mixing, packing, pii, quality_pu
from loomwright.llm.common import materialise, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier doesn't reject."""
    return quality_pu.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard_join.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind."""
    masked = docs.withColumn("text", pii.mask_personal_data(F.col("text")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, whole or cut, as their sources' targets ask."""
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token windows."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: A trained classifier and a tokenizer aren't expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-').lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
