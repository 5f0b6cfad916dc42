"""A training corpus from raw documents: clean, distinct, without secrets, mixed and packed.

Each stage reads what the one before wrote.  All but the last return the columns of
documents; the last returns where every piece of every document lies in the sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import mixing, near_dedup, packing, secrets, toxicity
from clauseloom.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon's score doesn't reject; learnt from the labels of the same tables."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    return near_dedup.without_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the name of the rule."""
    return secrets.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix: every document once at least, those of small sources up to twice."""
    others = tuple(name for name in docs.columns if name != "doc_id")
    mixed = mixing.mix(docs, mixing.Target(repetitions=2.0), carry=others)
    return mixed.select("doc_id", *(F.col(f"doc_{name}").alias(name) for name in others)).select(docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences of 2048."""
    tokens = packing.tokenized(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.checksummed(packing.pack(tokens), tokens).drop("row")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: SQL has neither the learnt lexicon nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
