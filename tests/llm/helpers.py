"""Small tables with the awkward cases every operator has to bear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, texts: list, sources: list | None = None) -> DataFrame:
    rows = [(i, t, "en", sources[i] if sources else "a", len(t) if t else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls everywhere, an empty and a long text, repeated rows, and columns named like results."""
    rows = [
        (None, "some words without a key here and there", None, None, None),
        (1, None, "en", "a", None),
        (2, "", "en", None, 0),
        (3, "one two three four five six seven eight nine ten " * 3000, "en", "a", 1),
        (4, "a repeated row of a few words", "en", "b", 29),
        (4, "a repeated row of a few words", "en", "b", 29),
        (5, "one", None, "b", 3),
    ]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    return docs.selectExpr(
        "*", "'x' as key", "1 as node", "2 as component_id", "'y' as kept", "0 as n_tokens", "1 as tokens", "3 as row",
        "7 as pass", "8 as block", "9 as position", "true as held_out", "0.5 as score", "'s' as spans", "1 as mark",
    )


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, []).limit(0)
