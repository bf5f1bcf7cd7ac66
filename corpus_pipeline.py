"""From raw documents to token ids: five stages, each one operator of ``plumbline.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
shared folder and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import mixing, ngram_join, pieces, quality, secrets
from plumbline.llm.common import n_words, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the posterior rejects go."""
    return quality.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the smallest doc_id stays.

    Texts without a word are linked with nothing and stay.
    """
    return ngram_join.first_of_each(docs, n=5, percent=80)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced, and n_chars follows."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times."""
    return mixing.taken(docs, n_words(F.col("text")))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and token ids of each row, with their number and whether they decode to the text."""
    coded = pieces.encode(docs)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        "round_trip",
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", judge_quality),
    ("ngram_join", drop_near_duplicates),
    ("secret_scan", hide_secrets),
    ("source_mix", mix_sources),
    ("sentencepiece", encode_texts),
]

#: The last stage follows a model file, which SQL cannot read; tests hold all rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
