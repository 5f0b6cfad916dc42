"""Map the general-purpose test tables onto the engine's tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions.lexicon import RULE_PATTERNS
from clauseloom.functions.text import preprocess_text, token_count
from clauseloom.operators.classify import Thresholds, add_following_word_negations, classify, exact_match, score_against_templates
from clauseloom.operators.nearest import nearest_template
from clauseloom.operators.sizing import broadcast_if_small, spread
from clauseloom.session import cut_lineage, stored


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document is a chunk; those with an ``embeddings`` row have a vector."""
    documents = spread(table(spark, folder, "documents"), "doc_id")
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return documents.join(vectors, "doc_id", "left").select(
        F.col("doc_id").alias("doc_idx"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.floor(F.col("n_chars") / 1000).cast("int").alias("page_number"),
        F.concat(F.lit("section:"), F.col("lang")).alias("header_path"),
        F.col("text").alias("content"),
        F.col("source").alias("source_file"),
        F.col("lang").alias("state"),
        "embedding",
    )


def chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_idx, content) of the same chunks: a document counts once for each of its vectors, at least once.

    Only documents with several vectors are looked up, so that no text travels where they are few.
    """
    vectors = table(spark, folder, "embeddings").groupBy(F.col("vec_id").alias("doc_id")).agg(F.count("*").alias("times"))
    several = broadcast_if_small(vectors.where("times > 1"))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1))))
    joined = table(spark, folder, "documents").join(several, "doc_id", "left")
    return joined.select(F.col("doc_id").alias("doc_idx"), F.col("text").alias("content"), times).drop("col")


def attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item is an attribute definition."""
    items = table(spark, folder, "benchmark")
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return items.join(vectors, "item_id", "left").select(
        (F.col("item_id") + 1).alias("attribute_number"),
        F.concat(F.lit("attribute_"), (F.col("item_id") + 1).cast("string")).alias("attribute_name"),
        F.col("text").alias("content"),
        "embedding",
    )


# Rules that occur in the test tables, checked after the regular vocabulary.
TABLE_RULES = (
    ("exceptions", r"\bder\b"),
    ("exceptions", r"\bque\b"),
    ("methodology_shift", r"\btion\b"),
    ("reanchoring", r"\bnum\b"),
    ("forbidden_conditions", r"\ben.un\b"),
)
TABLE_NEGATORS = ("tion", "que", "der", "les", "los")


def collection_key(lang: Column) -> Column:
    """Two template and two contract collections."""
    return (
        F.when(lang == "en", F.lit("TNredacted"))
        .when(lang == "fr", F.lit("WAredacted"))
        .when(lang == "de", F.lit("TNstandard"))
        .otherwise(F.lit("WAstandard"))
    )


def clauses(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a clause, with its label where there is one."""
    documents = spread(table(spark, folder, "documents"), "doc_id")
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    labels = table(spark, folder, "labels")
    number = (F.col("n_chars") % 5 + 1).cast("int")
    return (
        documents.join(labels, "doc_id", "left")
        .join(vectors, "doc_id", "left")
        .select(
            F.col("doc_id").alias("clause_id"),
            F.col("source").alias("contract"),
            F.col("lang").alias("state"),
            collection_key(F.col("lang")).alias("collection_key"),
            number.alias("attribute_number"),
            F.concat(F.lit("attribute_"), number.cast("string")).alias("attribute_name"),
            F.col("text").alias("raw_text"),
            "n_chars",
            F.col("quality").alias("is_standard"),
            "toxic",
            "embedding",
        )
    )


def templates_and_candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clauses labelled 1 act as templates, all others are classified."""
    # A second measure of the whole vector: its components count one to four times.
    weighted = F.transform("embedding", lambda x, i: x.cast("double") * (i % 4 + 1))
    prepared = rows.withColumn("text", preprocess_text(F.col("raw_text"))).withColumn("paraphrase_embedding", weighted)
    columns = ["state", "attribute_number", "text", "embedding", "paraphrase_embedding"]
    # Stands for the stored clause table, which every later step reads.
    prepared = cut_lineage(prepared.select("clause_id", "contract", "is_standard", *columns))
    is_template = F.coalesce(F.col("is_standard") == 1, F.lit(False))
    templates = prepared.where(is_template).select(F.col("clause_id").alias("template_id"), *columns)
    candidates = prepared.where(~is_template).select("clause_id", "contract", *columns)
    return templates, candidates


# Limits and rules under which every step of the cascade decides some of the table's clauses.
CASCADE_THRESHOLDS = Thresholds(semantic=0.30, paraphrase=0.05, high_paraphrase=0.12)
CASCADE_RULES = (*RULE_PATTERNS, ("exceptions", r"\bzu\b"), ("reanchoring", r"\bnum\b"))
CASCADE_NEGATORS = ("el", "eau", "ment")


def cascade(templates: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates after exact match, both template searches and the model stages."""
    scored = score_against_templates(exact_match(candidates, templates), templates, "cosine", with_text=False)
    negation = partial(add_following_word_negations, negators=CASCADE_NEGATORS)
    return classify(scored, CASCADE_THRESHOLDS, templates=templates, negation=negation, rules=CASCADE_RULES)


def classified(spark: SparkSession, folder: str) -> DataFrame:
    """The clauses that are no templates, as the cascade decides them."""
    found = cascade(*templates_and_candidates(clauses(spark, folder)))
    six = lambda name: F.round(name, 6).alias(name)
    return found.select(
        "clause_id", "contract", "state", "attribute_number", "is_standard", "classification_step", "rule_flags",
        six("semantic_similarity"), six("paraphrase_similarity"),
    )


def metric_clauses(spark: SparkSession, folder: str, similar: bool = False, judged: bool = False) -> DataFrame:
    """Clauses as the dashboard sees them.

    ``similar`` adds the ``similarity`` to the nearest template, ``judged`` that and the cascade's
    ``classification``, where templates are standard themselves.
    """
    rows = clauses(spark, folder)
    known = rows.select(
        "clause_id",
        F.concat(F.lit("doc_"), F.col("clause_id").cast("string")).alias("chunk_id"),
        F.concat(F.lit("contract_"), F.col("contract")).alias("contract_id"),
        F.when(F.col("n_chars") % 7 != 0, F.col("attribute_name")).alias("assigned_attribute"),
        token_count(F.col("raw_text")).alias("token_length"),
        F.col("raw_text").alias("text_snippet"),
        (F.col("is_standard") == 1).alias("is_template"),
    )
    if not (similar or judged):
        return known.drop("clause_id", "is_template")
    templates, candidates = templates_and_candidates(rows)
    cell = ["state", "attribute_number"]
    each = candidates.select("clause_id", *cell, "embedding").unionByName(
        templates.select(F.col("template_id").alias("clause_id"), *cell, "embedding")
    )
    nearest = nearest_template(each, templates, cell, "cosine").select("clause_id", F.round("similarity", 6).alias("similarity"))
    found = known.drop("text_snippet").join(nearest, "clause_id", "left")
    if judged:
        outcome = cascade(templates, candidates).select("clause_id", "is_standard")
        standard = F.coalesce(F.col("is_template"), F.lit(False)) | (F.col("is_standard") == 1)
        found = found.join(outcome, "clause_id", "left").withColumn(
            "classification", F.when(standard, F.lit("standard")).otherwise(F.lit("nonstandard"))
        )
    # Charts read these narrow rows more than once.
    return stored(found.drop("clause_id", "is_template", "is_standard"))


def metric_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Per-contract totals; the contract of each source."""
    return (
        clauses(spark, folder)
        .groupBy(F.concat(F.lit("contract_"), F.col("contract")).alias("contract_id"))
        .agg(
            F.min_by("state", F.struct("n_chars", "clause_id")).alias("state"),
            F.count_if(F.col("is_standard") == 1).alias("standard_count"),
            F.count_if(F.col("is_standard") == 0).alias("nonstandard_count"),
            F.count("*").alias("num_chunks"),
        )
    )


def timings(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds per contract from the text sizes; one key has no contract."""
    documents = table(spark, folder, "documents")
    by_source = documents.groupBy(F.concat(F.lit("contract_"), F.col("source")).alias("contract_id")).agg(
        (F.sum("n_chars") / 1000.0).alias("seconds")
    )
    by_language = documents.groupBy(F.concat(F.lit("lang_"), F.col("lang")).alias("contract_id")).agg(
        (F.sum("n_chars") / 1000.0).alias("seconds")
    )
    return by_source.unionByName(by_language)


def search_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Clauses as the chat search sees them."""
    return clauses(spark, folder).select(
        F.col("contract").alias("source_filename"),
        F.col("clause_id").alias("row_index"),
        "attribute_name",
        "attribute_number",
        F.floor(F.col("n_chars") / 1000).cast("int").alias("page"),
        F.concat(
            F.lit("section:"), F.col("state"), F.lit(" > Clause: "), F.col("attribute_number").cast("string"), F.lit(".1")
        ).alias("section"),
        "is_standard",
        F.col("raw_text").alias("text"),
        F.col("raw_text").alias("full_content_raw"),
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns; every few turns ask about contracts."""
    suffix = (
        F.when(F.col("turn") % 6 == 1, F.concat(F.lit(" show TN contract "), (F.col("conv_id") % 13).cast("string")))
        .when(F.col("turn") % 6 == 2, F.lit(" which are non-standard in WA ?"))
        .when(F.col("turn") % 6 == 3, F.lit(" Non standard terms in tn"))
        .when(F.col("turn") % 6 == 4, F.lit(" are standard in contract1"))
        .otherwise(F.lit(""))
    )
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("seq"),
        "role",
        F.concat("text", suffix).alias("text"),
    )


def markdown_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a markdown file: page markers, headers and blank lines between its own lines."""

    def render(line: Column, index: Column) -> Column:
        page = F.when(
            index % 7 == 0, F.concat(F.lit("--- Page "), (F.floor(index / 7) + 1).cast("string"), F.lit(" ---\n"))
        ).otherwise(F.lit(""))
        header = (
            F.when(index % 11 == 4, F.lit("### "))
            .when(index % 5 == 1, F.lit("# "))
            .when(index % 5 == 3, F.lit("## "))
            .otherwise(F.lit(""))
        )
        blank = F.when(index % 3 == 0, F.lit("\n")).otherwise(F.lit(""))
        return F.concat(page, header, line, blank)

    documents = spread(table(spark, folder, "documents"), "doc_id")
    return documents.select(
        "doc_id",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_file"),
        F.array_join(F.transform(F.split("text", "\n"), render), "\n").alias("value"),
    )


def repeated_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as markdown whose page numbers come again, with OCR marks, empty table heads and shared file names."""

    def render(line: Column, index: Column) -> Column:
        number = F.pmod(F.floor(index / 3), F.lit(2)) + 1
        page = F.when(index % 3 == 0, F.concat(F.lit("--- Page "), number.cast("string"), F.lit(" ---\n"))).otherwise(F.lit(""))
        header = F.when(index % 5 == 1, F.lit("# ")).when(index % 5 == 3, F.lit("## ")).otherwise(F.lit(""))
        marks = (
            F.when(index % 4 == 2, F.lit("\n--- Page 9 (OCR) ---"))
            .when(index % 4 == 3, F.lit("\n| | |\n| --- | --- |"))
            .otherwise(F.lit(""))
        )
        return F.concat(page, header, line, marks)

    documents = spread(table(spark, folder, "documents"), "doc_id")
    return documents.select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat(F.lit("file_"), (F.col("doc_id") % 7).cast("string"), F.lit(".md")).alias("source_file"),
        F.array_join(F.transform(F.split("text", "\n"), render), "\n").alias("value"),
    )
