"""BM25 in relational form."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.text import tokens

K1 = 1.2
B = 0.75
SCALE = 1e12  # a term's share of a score is a whole number of these parts
EPSILON = 1e-9


@dataclass(frozen=True)
class CorpusStats:
    """What BM25 needs to know about the corpus for one dictionary of queries."""

    documents: int
    average_length: float
    document_frequency: dict[str, int]


def query_terms(attributes: DataFrame) -> DataFrame:
    """(attribute_number, term, query_frequency) of every attribute text."""
    return (
        attributes.select("attribute_number", F.explode_outer(tokens(F.col("content"))).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("attribute_number", "term")
        .agg(F.count("*").alias("query_frequency"))
    )


def corpus_counts(chunks: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """(term, documents, tokens) in one pass over the texts.

    The row with the empty term carries the corpus totals: number of chunks and
    number of tokens.  Both kinds of counts are combined before the shuffle, so
    frequent terms cost no more than rare ones.  ``small`` says whether the
    vocabulary has been measured to be small enough for a broadcast.
    """
    terms = tokens(F.col("content"))
    counted = F.concat(
        F.array(F.struct(F.lit("").alias("term"), F.size("terms").alias("length"))),
        F.transform(
            F.array_distinct("terms"), lambda term: F.struct(term.alias("term"), F.lit(0).alias("length"))
        ),
    )
    # The outer form, here and below, keeps Spark from tokenizing a second time for a size filter.
    rows = chunks.select(terms.alias("terms")).select(F.inline_outer(counted))
    kept = vocabulary.select("term").distinct()
    kept = kept.unionByName(kept.sparkSession.sql("SELECT '' AS term"))
    return (
        rows.join(F.broadcast(kept) if small else kept, "term", "left_semi")
        .groupBy("term")
        .agg(F.count("*").alias("documents"), F.sum("length").cast("long").alias("tokens"))
    )


def bm25_scores(attributes: DataFrame, chunks: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(attribute_number, doc_idx, bm25_score) of every pair that shares a term.

    A pair without a row has score 0.0.  The terms of the dictionary are counted inside the rows
    of the chunks, once; a second pass over the counts scores each chunk where it lies, so
    nothing but the corpus counts is shuffled.
    """
    from clauseloom.operators import scoring  # builds on this module

    found = [
        scoring.sharing_pairs(block.rows, block.scorer)
        for block in scoring.scored_blocks(attributes.withColumn("embedding", F.lit(None).cast("array<double>")), chunks, k1=k1, b=b)
    ]
    return reduce(DataFrame.unionByName, found)
