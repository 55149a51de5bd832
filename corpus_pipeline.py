"""From raw documents to packed sequences: the stages, each a function of (spark, docs, sf_dir).

Every stage takes any rows of documents, nulls in every column, empty and very long texts, repeated rows and further columns among them, and gives an
empty table for an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import langid, linededup, oddsketch, packing
from tickloom.llm.shared import discard, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those without letters, null and empty texts among them. Rows repeated under a doc_id go together; rows without one stay."""
    found = langid.identify(docs, langid.fit(docs), declared=F.col("lang"), host=F.col("source"))
    return langid.keep_identified(docs, found)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of like lines stays; documents that had nothing else go, and n_chars follows the text. Null and empty texts, and rows without a doc_id, stay as they are."""
    left = linededup.dedup_lines(docs, lost_col="__lost").where("not (__lost > 0 and trim(BOTH FROM text) = '')")
    return left.select(*[F.when(F.col("__lost") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the one with the smallest doc_id and all its repeated rows; texts without words and rows without a doc_id stay."""
    return oddsketch.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of binary lengths, one row per piece, with its ids; a null or empty text has its end id alone, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", pack),
]

#: SQL can't express the classifier, the fuzzy components and the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
            discard(before)
    return docs
