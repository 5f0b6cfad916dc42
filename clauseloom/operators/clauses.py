"""Kept matches to comparable clauses with fingerprints, ids and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.lexicon import TEMPLATE_COLLECTIONS
from clauseloom.functions.text import preprocess_text, redaction, row_id, sha256, token_count

PIPELINE_STEPS = (
    "unicode_nfkc",
    "lowercase",
    "md_fence_strip",
    "non_alnum_strip",
    "collapse_whitespace",
    "stopword_removal",
    "number_masking",
    "number_word_masking",
)


def enrich(clauses: DataFrame, raw: str = "full_content_raw") -> DataFrame:
    """Add the comparable text, its word count and hash, and the redaction finding."""
    prepared = clauses.withColumn("preprocessed_final_content", preprocess_text(F.col(raw)))
    found = redaction(F.col(raw))
    return (
        prepared.withColumn("preprocessed_token_count", token_count(F.col("preprocessed_final_content")))
        .withColumn("preprocessed_sha256", sha256(F.col("preprocessed_final_content")))
        .withColumn("has_redaction", found["has_redaction"])
        .withColumn("redaction_snippet", found["redaction_snippet"])
    )


def provenance(tokenizer: str = "split") -> Column:
    """Which steps produced the text; carries no timestamps so that results repeat."""
    return F.struct(
        F.lit(False).alias("used_stemmer"),
        F.lit(False).alias("used_ftfy"),
        F.lit(tokenizer).alias("tokenizer"),
        F.array(*[F.lit(step) for step in PIPELINE_STEPS]).alias("pipeline_steps"),
    )


def clauses_from_matches(matches: DataFrame, collection_key: str, rank: str) -> DataFrame:
    """Flatten formatted matches into clause rows of one collection."""
    flat = matches.select(
        F.lit(collection_key).alias("collection_key"),
        "attribute_number",
        "attribute_name",
        F.col(rank).alias(rank),
        "page",
        "section",
        "chunk_id",
        "source_file",
        "rrf_score",
        "dense_similarity",
        "bm25_score",
        "content_preview",
        F.col("full_content").alias("full_content_raw"),
    )
    return enrich(flat)


def with_row_id(clauses: DataFrame, suffix: str = "") -> DataFrame:
    return clauses.withColumn(
        "row_id",
        row_id(
            F.col("collection_key"),
            F.col("attribute_number"),
            F.col("source_file"),
            F.col("chunk_id"),
            F.col("page"),
            F.col("preprocessed_sha256"),
            suffix,
        ),
    )


METADATA_COLUMNS = (
    "collection_key",
    "attribute_number",
    "attribute_name",
    "source_file",
    "page",
    "section",
    "chunk_id",
    "rrf_score",
    "bm25_score",
    "preprocessed_token_count",
    "has_redaction",
    "preprocessed_sha256",
)


def metadata(clauses: DataFrame, embedding_type: str) -> DataFrame:
    """The flat columns stored next to a clause vector."""
    return clauses.select(
        *METADATA_COLUMNS,
        F.lit(embedding_type).alias("embedding_type"),
        F.lit("processed_dataset").alias("embedding_source"),
    )


def collection_kind(collection_key: Column) -> Column:
    """'template' or 'contract', decided per row."""
    return F.when(collection_key.isin(*TEMPLATE_COLLECTIONS), F.lit("template")).otherwise(F.lit("contract"))
