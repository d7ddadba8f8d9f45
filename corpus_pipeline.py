"""A corpus pipeline of five stages, each written and read again as the next one's documents.

A stage is called with (spark, docs, sf_dir) and works on all rows that its predecessor kept, whole texts. All but the
last return the columns of documents as they came, extra ones and such with clashing names too. Written tables lie below
``spark.checkpoint.dir``, so a lost executor costs its own tasks only. Defined cases: an empty table stays empty through
all stages; null and blank texts, having no letter, leave at the first stage; null ids, ties and repeated rows are said at
each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refrain.llm import exact_dedup, language_id, mixing, sentencepiece_fst, simhash
from refrain.session import Scratch, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter and those too far from all languages go.

    Repeated rows are decided alike, by their text alone. Where no row is labelled, nothing can be learned and all go.
    """
    return language_id.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal after A-Z are lower-cased: that with the largest doc_id.

    Of repeated rows one stays. A null text counts as an empty one, and a null doc_id as smaller than any other.
    """
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by fingerprint, that with the smallest doc_id of the component.

    Documents without an id stay if their component has none with one, once per text. Texts without words share one
    fingerprint, so one of them stays.
    """
    return simhash.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each time it takes them, up to three.

    A document that the mix takes in part stays whole; one without words has nothing to be cut and stays once. Rows that
    repeat id and size are taken equally often.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, round_trip of every row, repeats included; a null text has no ids."""
    return sentencepiece_fst.encoded(docs)


STAGES = [
    ("language", known_language),
    ("exact_dedup", exact),
    ("simhash", near),
    ("mix", mix),
    ("encode", encode),
]

#: SQL cannot express the first stage; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
