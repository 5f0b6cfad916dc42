"""Keyword search, chat evidence and session history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.lexicon import ANSWER_COUNT, ANSWER_NOTHING
from clauseloom.functions.text import clause_number, contract_hint, query_keywords, single_line, standard_hint
from clauseloom.operators.ordered import top_k

ROWS_PER_FILE = 30  # of the quick look at each file's beginning
SEARCH_RESULTS = 12
EVIDENCE_ITEMS = 6
HISTORY_LENGTH = 20
SNIPPET_LENGTH = 220

# Wording of the prompt.
PROMPT_INSTRUCTIONS = (
    "Answer the user in ONE SHORT LINE of plain text (<= 20 words).\n"
    "Do NOT output JSON, lists, markdown, or multiple lines.\n"
    "Use only the provided evidence. If counting non-standard, isStandard=0.\n"
)
PROMPT_END = "\nReturn exactly one concise line."


def matching(
    clauses: DataFrame,
    query: str,
    contract: str | None = None,
    is_standard: int | None = None,
    rows_per_file: int | None = None,
) -> DataFrame:
    """All clauses whose attribute name or text contains any keyword of the query.

    ``rows_per_file`` looks only at the first rows of each file, before the other
    filters apply; by default all rows are searched.
    """
    rows = clauses
    if contract is not None:
        rows = rows.where(F.lower("source_filename").contains(contract.lower()))
    if rows_per_file is not None:
        rows = top_k(rows, ["source_filename"], [F.asc("row_index")], rows_per_file, "_row").drop("_row")
    if is_standard in (0, 1):
        rows = rows.where(F.col("is_standard") == is_standard)
    keywords = query_keywords(F.lit(query))
    haystack = F.lower(
        F.concat(F.coalesce("attribute_name", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    )
    return rows.where((F.size(keywords) == 0) | F.exists(keywords, lambda keyword: F.contains(haystack, keyword)))


def search(
    clauses: DataFrame,
    query: str,
    contract: str | None = None,
    is_standard: int | None = None,
    rows_per_file: int | None = None,
    results: int = SEARCH_RESULTS,
) -> DataFrame:
    """The first ``results`` of the ``matching`` clauses, by file name, then row index."""
    return (
        matching(clauses, query, contract, is_standard, rows_per_file)
        .orderBy("source_filename", "row_index")
        .limit(results)
        .select(
            "source_filename",
            "row_index",
            "attribute_name",
            "attribute_number",
            "page",
            "section",
            clause_number(F.col("section")).alias("clause_number"),
            "is_standard",
            F.substring(F.coalesce("full_content_raw", F.lit("")), 1, SNIPPET_LENGTH).alias("full_content_raw"),
        )
    )


def intents(messages: DataFrame, text: str = "text") -> DataFrame:
    """Add the contract and standard filters a message asks for."""
    return messages.withColumn("contract_filter", contract_hint(F.col(text))).withColumn(
        "standard_filter", standard_hint(F.col(text))
    )


def evidence_item() -> Column:
    # Names of the fields in an item.
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("N/A"))
    return F.concat(
        F.lit("Contract="),
        shown("source_filename"),
        F.lit("; Attr="),
        shown("attribute_name"),
        F.lit("; Clause="),
        shown("clause_number"),
        F.lit("; Page="),
        shown("page"),
        F.lit("; Standard="),
        shown("is_standard"),
    )


def evidence(found: DataFrame, items: int = EVIDENCE_ITEMS) -> DataFrame:
    """One row with the first items joined by " | "; found is bounded by the search limit."""
    ordered = F.array_sort(F.collect_list(F.struct("source_filename", "row_index", evidence_item().alias("item"))))
    first = F.slice(F.transform(ordered, lambda row: row["item"]), 1, items)
    joined = F.when(F.size(first) > 0, F.array_join(first, " | ")).otherwise(F.lit("(no items)"))
    return found.agg(joined.alias("evidence"))


def prompt(found: DataFrame, query: str) -> DataFrame:
    """The instruction for an answering model; earlier messages are not part of it."""
    return evidence(found).select(
        F.concat(
            F.lit(PROMPT_INSTRUCTIONS), F.lit(f"Question: {query}\nEvidence: "), F.col("evidence"), F.lit(PROMPT_END)
        ).alias("prompt")
    )


def fallback_answer(found: DataFrame, is_standard: int | None) -> DataFrame:
    """One line derived from the clauses found, used when no model answers.

    ``found`` holds all ``matching`` clauses: the count in the line is theirs.
    """
    number = F.col("clause_number") if "clause_number" in found.columns else clause_number(F.col("section"))
    first = F.min_by(
        F.struct("source_filename", number.alias("clause_number"), "page", "attribute_name"),
        F.struct("source_filename", "row_index"),
    )
    summary = found.agg(first.alias("first"), F.count("*").alias("rows"))
    shown = lambda name: F.coalesce(F.col(f"first.{name}").cast("string"), F.lit("N/A"))
    counted = F.concat(
        F.col("first.source_filename"), F.lit(": "), F.col("rows").cast("string"), F.lit(ANSWER_COUNT)
    )
    item = F.concat(
        F.lit("Clause "), shown("clause_number"), F.lit(" page "), shown("page"), F.lit(" - "), shown("attribute_name")
    )
    return summary.select(
        F.when(F.col("rows") == 0, F.lit(ANSWER_NOTHING))
        .when(F.lit(is_standard == 0), counted)
        .otherwise(item)
        .alias("answer")
    )


def needs_fallback(answer: Column) -> Column:
    lowered = F.lower(answer)
    return lowered.startswith("error calling llm") | lowered.contains("memory")


def chat(clauses: DataFrame, message: str, answer: Callable[[str], str] | None = None) -> str:
    """Answer one message: intent, search, prompt, model, one line.

    ``answer`` is the injected model; without one, or when it reports an error,
    the line is derived from the data.
    """
    spark = clauses.sparkSession
    asked = intents(spark.createDataFrame([(message,)], "text string")).first()
    found = search(clauses, message, asked.contract_filter, asked.standard_filter)
    if answer is not None:
        reply = spark.createDataFrame([(answer(prompt(found, message).first().prompt),)], "reply string")
        line = reply.select(single_line(F.col("reply")).alias("line"))
        row = line.select("line", needs_fallback(F.col("line")).alias("failed")).first()
        if not row.failed:
            return row.line
    every = matching(clauses, message, asked.contract_filter, asked.standard_filter)
    return fallback_answer(every, asked.standard_filter).first().answer


def recent_messages(messages: DataFrame, keep: int = HISTORY_LENGTH) -> DataFrame:
    """The last ``keep`` messages of each session."""
    return top_k(messages, ["session_id"], [F.desc("seq")], keep, "_age").drop("_age")


def session_history(messages: DataFrame, session_id: str) -> DataFrame:
    return messages.where(F.col("session_id") == session_id).orderBy("seq")


def clear_session(messages: DataFrame, session_id: str) -> DataFrame:
    return messages.where(F.col("session_id") != session_id)
