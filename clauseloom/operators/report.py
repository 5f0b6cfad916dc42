"""Aggregates over classified clauses and their text report.

Input columns: contract, attribute_number, state, is_standard,
classification_step, rule_flags, semantic_similarity, paraphrase_similarity.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.operators.topcounts import top_counts

UNKNOWN = "unknown"


def _standard() -> Column:
    # A missing flag counts as non-standard.
    return F.count_if(F.col("is_standard") == 1)


def _percentage(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * 100).otherwise(0.0)


def summary(classified: DataFrame) -> DataFrame:
    """All counts of the report in one pass over the clauses.

    ``section`` names the breakdown: overall, step, attribute, state,
    contract_step or contract_attribute; ``contract`` and ``key`` identify the row.
    """
    keyed = classified.select(
        F.coalesce("contract", F.lit(UNKNOWN)).alias("contract"),
        F.coalesce("classification_step", F.lit(UNKNOWN)).alias("step"),
        F.coalesce(F.col("attribute_number").cast("string"), F.lit(UNKNOWN)).alias("attribute"),
        F.coalesce("state", F.lit(UNKNOWN)).alias("state"),
        "is_standard",
    )
    contract, step, attribute, state = (F.col(name) for name in ("contract", "step", "attribute", "state"))
    grouped = keyed.groupingSets(
        [[], [step], [attribute], [state], [contract, step], [contract, attribute]],
        contract,
        step,
        attribute,
        state,
    ).agg(
        F.count("*").alias("total"),
        _standard().alias("standard"),
        F.grouping_id().alias("_set"),
    )
    # Bits from contract (8) down to state (1); a set bit means "not grouped by".
    section = (
        F.when(F.col("_set") == 15, F.lit("overall"))
        .when(F.col("_set") == 11, F.lit("step"))
        .when(F.col("_set") == 13, F.lit("attribute"))
        .when(F.col("_set") == 14, F.lit("state"))
        .when(F.col("_set") == 3, F.lit("contract_step"))
        .otherwise(F.lit("contract_attribute"))
    )
    return grouped.select(
        section.alias("section"),
        contract,
        F.coalesce(step, attribute, state).alias("key"),
        "total",
        "standard",
        (F.col("total") - F.col("standard")).alias("non_standard"),
        _percentage("standard", "total").alias("standard_percentage"),
    )


def overall(classified: DataFrame) -> DataFrame:
    counted = classified.agg(F.count("*").alias("total_clauses"), _standard().alias("standard_clauses"))
    return counted.select(
        "total_clauses",
        "standard_clauses",
        (F.col("total_clauses") - F.col("standard_clauses")).alias("non_standard_clauses"),
        _percentage("standard_clauses", "total_clauses").alias("standard_percentage"),
    )


def breakdown(classified: DataFrame, key: Column, name: str) -> DataFrame:
    """Totals, standard counts and percentage by one key."""
    counted = classified.groupBy(F.coalesce(key.cast("string"), F.lit(UNKNOWN)).alias(name)).agg(
        F.count("*").alias("total"), _standard().alias("standard")
    )
    return counted.withColumn("standard_percentage", _percentage("standard", "total"))


def flag_histogram(classified: DataFrame, top: int | None = 10) -> DataFrame:
    """Most frequent rule flags; ties by flag text."""
    if top is not None:
        return top_counts(classified, F.col("rule_flags"), top).select(
            F.col("item").alias("flag"), F.col("amount").alias("clauses")
        )
    flags = classified.select(F.explode_outer("rule_flags").alias("flag")).where(F.col("flag").isNotNull())
    return flags.groupBy("flag").agg(F.count("*").alias("clauses")).orderBy(F.desc("clauses"), F.asc("flag"))


def similarity_means(classified: DataFrame) -> DataFrame:
    """Mean and size of both similarity distributions, missing values left out."""
    return classified.agg(
        F.avg("semantic_similarity").alias("avg_semantic"),
        F.count("semantic_similarity").alias("semantic_values"),
        F.avg("paraphrase_similarity").alias("avg_paraphrase"),
        F.count("paraphrase_similarity").alias("paraphrase_values"),
    )


def similarity_values(classified: DataFrame) -> DataFrame:
    """Both distributions as rows (kind, value)."""
    columns = F.array(
        F.struct(F.lit("semantic").alias("kind"), F.col("semantic_similarity").alias("value")),
        F.struct(F.lit("paraphrase").alias("kind"), F.col("paraphrase_similarity").alias("value")),
    )
    return classified.select(F.inline(columns)).where(F.col("value").isNotNull())


def contract_summary(classified: DataFrame) -> DataFrame:
    """Per contract: total, standard, and everything else as non-standard."""
    counted = classified.groupBy("contract").agg(
        F.count("*").alias("total_clauses"), _standard().alias("standard_clauses")
    )
    return counted.withColumn("non_standard_clauses", F.col("total_clauses") - F.col("standard_clauses"))


def non_standard_rows(classified: DataFrame, contract: str | None = None) -> DataFrame:
    """Clauses flagged 0; a missing flag is not listed."""
    rows = classified.where(F.col("is_standard") == 0)
    if contract is not None:
        rows = rows.where(F.lower("contract").contains(contract.lower()))
    return rows


def non_standard_counts(classified: DataFrame, contract: str | None = None, keep_empty: bool = False) -> DataFrame:
    """Number of clauses flagged 0 per contract, optionally with zero rows."""
    rows = classified
    if contract is not None:
        rows = rows.where(F.lower("contract").contains(contract.lower()))
    counted = rows.groupBy("contract").agg(F.count_if(F.col("is_standard") == 0).alias("non_standard"))
    return counted if keep_empty else counted.where(F.col("non_standard") > 0)


def table_text(title: str, columns: tuple[str, ...], rows: Iterable[tuple]) -> str:
    """A Markdown table under a heading; empty where there are no rows."""
    shown = [["" if value is None else f"{value:.3f}" if isinstance(value, float) else str(value) for value in row] for row in rows]
    if not shown:
        return ""
    lines = [columns, ["---"] * len(columns), *shown]
    return "\n".join([f"## {title}", "", *(f"| {' | '.join(line)} |" for line in lines), ""])


#: Sections of the summary in the report: heading and the name of their key column.
REPORT_SECTIONS = {"overall": ("All clauses", "scope"), "step": ("Deciding step", "step"),
                   "attribute": ("Attributes", "attribute"), "state": ("States", "state")}


def text_report(classified: DataFrame, title: str = "Classified clauses") -> str:
    """The summary as Markdown tables, one for each section, then rule flags and similarities.

    Only aggregates reach the driver; contracts are not listed.
    """
    found = summary(classified).where(F.col("section").isin(*REPORT_SECTIONS)).collect()
    parts = [f"# {title}", ""]
    for section, (heading, key) in REPORT_SECTIONS.items():
        rows = sorted((row for row in found if row.section == section), key=lambda row: row.key or "")
        cells = [(row.key or "all", row.total, row.standard, row.total - row.standard, row.standard_percentage) for row in rows]
        parts.append(table_text(heading, (key, "clauses", "standard", "other", "% standard"), cells))
    parts.append(table_text("Rule flags", ("flag", "clauses"), [(row.flag, row.clauses) for row in flag_histogram(classified).collect()]))
    means = similarity_means(classified).first()
    measured = (("semantic", means.avg_semantic, means.semantic_values), ("paraphrase", means.avg_paraphrase, means.paraphrase_values))
    parts.append(table_text("Similarity to the template", ("measure", "mean", "values"), [row for row in measured if row[2]]))
    return "\n".join(part for part in parts if part)
