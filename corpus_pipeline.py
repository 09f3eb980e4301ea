"""A corpus pipeline over ``documents``: language, near-duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.decontamination import without_passages
from colonnade.llm.language import identified, profiles
from colonnade.llm.packing import packed
from colonnade.llm.simhash import one_of_each_component
from colonnade.llm.suffix_dedup import without_repeats
from colonnade.llm.tables import cut, table

#: A text of at least ``ENOUGH`` characters whose best language is less alike than this is rejected; shorter ones have too few grams to tell.
LEAST_COSINE, ENOUGH = 0.15, 200

_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language go on; those without a letter or unlike all learned languages do not.

    Null, empty and letterless texts go; a null lang teaches nothing; rows are judged one by one, so repeated
    rows and null ids share a fate.  Of equally alike languages the first by name counts.
    """
    docs = docs.select(*_COLUMNS)
    found = identified(docs, profiles(docs))
    alike = (F.col("score") >= LEAST_COSINE) | (F.length("text") < ENOUGH)
    return found.where((F.col("lang_pred") != "und") & alike).select(*_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (four-word shingles, links of four bits or fewer): the one with the smallest doc_id.

    Null and empty texts are copies of each other; a null id comes after all others; of repeated rows one stays.
    """
    return one_of_each_component(docs.select(*_COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that earlier documents hold; n_chars counts what is left.

    Texts of under 50 bytes, null and empty ones among them, stay as they are; a null id is later than all
    others; documents with one id take nothing from each other.  Documents that lose all their words go.
    """
    kept = without_repeats(docs.select(*_COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*_COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; rows are judged one by one, and null or empty texts hold none."""
    return without_passages(docs.select(*_COLUMNS), table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the pieces of every document go in the training sequences; a null or empty text is one token, its end."""
    return packed(docs.select(*_COLUMNS))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: Random vectors, fingerprints and alignments have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each over all that the one before kept, which is written in the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
