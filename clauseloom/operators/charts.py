"""Chart-ready aggregates over clause and contract metrics.

clauses: chunk_id, contract_id, assigned_attribute, token_length, similarity,
classification, text_snippet.  contracts: contract_id, state, standard_count,
nonstandard_count, num_chunks, processing_seconds.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.lexicon import WORDCLOUD_STOP_WORDS
from clauseloom.functions.text import words
from clauseloom.operators.selection import select_positions
from clauseloom.operators.sizing import broadcast_if_small
from clauseloom.operators.topcounts import top_counts
from clauseloom.session import cut_lineage, stored


def share(part: Column, whole: Column) -> Column:
    """Percentage with one digit; an empty whole gives 0.0."""
    return F.coalesce(F.round(part * 100.0 / F.nullif(whole, F.lit(0)), 1), F.lit(0.0))


def first_contracts(contracts: DataFrame) -> DataFrame:
    """One row per contract id, as the first match would be taken."""
    return contracts.groupBy("contract_id").agg(
        *[F.min_by(name, F.struct("state", "num_chunks")).alias(name) for name in contracts.columns if name != "contract_id"]
    )


def standard_pie(contracts: DataFrame) -> DataFrame:
    totals = contracts.agg(
        F.coalesce(F.sum("standard_count"), F.lit(0)).alias("standard"),
        F.coalesce(F.sum("nonstandard_count"), F.lit(0)).alias("non_standard"),
    )
    slices = F.array(
        F.struct(F.lit("Standard").alias("label"), F.col("standard").alias("value")),
        F.struct(F.lit("Non-Standard").alias("label"), F.col("non_standard").alias("value")),
    )
    total = F.col("standard") + F.col("non_standard")
    return totals.select(total.alias("total"), F.inline(slices)).select(
        "label", "value", share(F.col("value"), F.col("total")).alias("percentage"), "total"
    )


def histogram(values: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed, empty bins kept."""
    # One pass over the rows counts the distinct values; bounds, bins and total come from those.
    known = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("value"))
    known = cut_lineage(known.groupBy("value").agg(F.count("*").alias("rows")))
    bounds = known.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("rows").alias("total"))
    flat = F.col("low") == F.col("high")
    bounds = bounds.where(F.col("low").isNotNull()).select(
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
        "total",
    )
    low, high = bounds.select("low").scalar(), bounds.select("high").scalar()
    position = F.least(F.floor((F.col("value") - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    counts = known.groupBy(position.alias("bin")).agg(F.sum("rows").alias("count"))
    edges = bounds.withColumn("width", (F.col("high") - F.col("low")) / bins).withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    )
    return edges.join(counts, "bin", "left").select(
        "bin",
        F.round(F.col("low") + F.col("bin") * F.col("width"), 1).alias("bin_start"),
        F.round(F.col("low") + (F.col("bin") + 1) * F.col("width"), 1).alias("bin_end"),
        F.round(F.col("low") + (F.col("bin") + 0.5) * F.col("width"), 1).alias("bin_center"),
        F.coalesce("count", F.lit(0)).alias("count"),
        share(F.coalesce("count", F.lit(0)), F.col("total")).alias("percentage"),
    )


def length_stats(clauses: DataFrame, column: str = "token_length") -> DataFrame:
    """Mean, median, range and population deviation of an integer column.

    The median is the mean of the two middle values, selected by counting ranges of values.
    """
    lengths = clauses.select(F.coalesce(F.col(column), F.lit(0)).alias("value"))
    middle = {"lower": F.floor((F.col("n") + 1) / 2), "upper": F.floor(F.col("n") / 2) + 1}
    halves = select_positions(lengths, [], "value", middle)
    value = F.col("value")
    stats = lengths.agg(
        F.round(F.avg(value), 1).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.round(F.stddev_pop(value), 1).alias("std"),
    )
    median = halves.select(F.round((F.col("lower") + F.col("upper")) / 2, 1)).scalar()
    return stats.select("mean", median.alias("median"), "min", "max", "std")


def heatmap(clauses: DataFrame, contracts: DataFrame) -> DataFrame:
    """Dense grid attribute x state with average similarity and clause count."""
    states = first_contracts(contracts).select("contract_id", "state")
    cells = (
        clauses.where(F.col("assigned_attribute").isNotNull())
        .groupBy("contract_id", "assigned_attribute")
        .agg(F.sum("similarity").alias("total"), F.count("similarity").alias("scored"), F.count("*").alias("rows"))
        .join(states, "contract_id")
        .groupBy("assigned_attribute", "state")
        .agg(
            (F.sum("total") / F.nullif(F.sum("scored"), F.lit(0))).alias("average"),
            F.sum("rows").alias("count"),
        )
    )
    # The state axis of the chart: one label per state.
    axis = contracts.where(F.col("state").isNotNull()).agg(F.collect_set("state")).scalar()
    grid = (
        clauses.where(F.col("assigned_attribute").isNotNull())
        .select("assigned_attribute")
        .distinct()
        .withColumn("state", F.explode(axis))
    )
    return grid.join(cells, ["assigned_attribute", "state"], "left").select(
        F.col("assigned_attribute").alias("attribute"),
        "state",
        F.round(F.coalesce("average", F.lit(0.0)), 3).alias("value"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def short_name(contract_id: Column) -> Column:
    return F.element_at(F.split(contract_id, "_"), -1)


def contract_bars(contracts: DataFrame) -> DataFrame:
    standard = F.coalesce("standard_count", F.lit(0))
    non_standard = F.coalesce("nonstandard_count", F.lit(0))
    return contracts.select(
        "contract_id",
        short_name(F.col("contract_id")).alias("contract_name"),
        "state",
        standard.alias("standard"),
        non_standard.alias("non_standard"),
        (standard + non_standard).alias("total"),
        share(standard, standard + non_standard).alias("standard_percentage"),
    )


def attribute_bars(clauses: DataFrame) -> DataFrame:
    """Standard and non-standard clauses per attribute with the mean similarity."""
    return (
        clauses.where(F.col("assigned_attribute").isNotNull())
        .groupBy(F.col("assigned_attribute").alias("attribute"))
        .agg(
            F.count_if(F.col("classification") == "standard").alias("standard"),
            F.count_if(F.col("classification") == "nonstandard").alias("non_standard"),
            F.count("*").alias("total"),
            F.round(F.coalesce(F.avg("similarity"), F.lit(0.0)), 3).alias("avg_similarity"),
        )
    )


def _similarities(clauses: DataFrame) -> DataFrame:
    return clauses.where(F.col("assigned_attribute").isNotNull()).select(
        F.col("assigned_attribute").alias("attribute"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "chunk_id"
    )


def _box(known: DataFrame) -> DataFrame:
    """One row per attribute: n, low, high, total and the quartiles."""
    quarter = lambda numerator: F.floor(F.col("n") * numerator / 4) + 1
    return select_positions(
        known, ["attribute"], "similarity", {"q1": quarter(1), "median": quarter(2), "q3": quarter(3)}
    )


def _outside(known: DataFrame, box: DataFrame) -> DataFrame:
    """The rows beyond one and a half times the middle half's spread; looks at every row where it lies."""
    spread = F.col("q3") - F.col("q1")
    outside = (F.col("similarity") < F.col("q1") - 1.5 * spread) | (F.col("similarity") > F.col("q3") + 1.5 * spread)
    return known.join(broadcast_if_small(box.select("attribute", "q1", "q3")), "attribute").where(outside)


def similarity_box(clauses: DataFrame) -> DataFrame:
    """Quartiles without interpolation (sorted[n//4], [n//2], [3n//4]), mean and outlier count."""
    known = _similarities(clauses)
    box = stored(_box(known))
    outliers = _outside(known, box).groupBy("attribute").agg(F.count("*").alias("outliers"))
    box = box.withColumn("mean", F.col("total") / F.col("n")).withColumnsRenamed({"low": "min", "high": "max"})
    rounded = [F.round(name, 3).alias(name) for name in ("min", "q1", "median", "q3", "max", "mean")]
    return box.join(broadcast_if_small(outliers), "attribute", "left").select(
        "attribute", *rounded, F.col("n").alias("count"), F.coalesce("outliers", F.lit(0)).alias("outliers")
    )


def similarity_outliers(clauses: DataFrame) -> DataFrame:
    """The outliers themselves, one row each."""
    known = _similarities(clauses)
    found = _outside(known, stored(_box(known)))
    return found.select("attribute", "chunk_id", F.round("similarity", 3).alias("similarity"))


def length_scatter(clauses: DataFrame) -> DataFrame:
    """Points (length, similarity); anything but 'standard' belongs to the other series."""
    series = F.when(F.col("classification") == "standard", F.lit("standard")).otherwise(F.lit("non_standard"))
    return clauses.select(
        series.alias("series"),
        F.coalesce("token_length", F.lit(0)).alias("x"),
        F.round(F.coalesce("similarity", F.lit(0.0)), 3).alias("y"),
        F.col("chunk_id").alias("clause_id"),
        "contract_id",
        F.col("assigned_attribute").alias("attribute"),
    )


def processing_timeline(timings: DataFrame, contracts: DataFrame) -> DataFrame:
    """Seconds per contract, longest first; timings of unknown contracts are kept."""
    known = first_contracts(contracts).select("contract_id", "state", "num_chunks")
    return (
        timings.join(known, "contract_id", "left")
        .select(
            "contract_id",
            short_name(F.col("contract_id")).alias("contract_name"),
            F.coalesce("state", F.lit("Unknown")).alias("state"),
            F.round("seconds", 2).alias("processing_time"),
            F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"),
        )
        .orderBy(F.desc("processing_time"), F.asc("contract_id"))
    )


def word_cloud(clauses: DataFrame, stop_words: Iterable[str] = WORDCLOUD_STOP_WORDS, top: int = 50) -> DataFrame:
    """Most frequent words longer than three characters; ties by word."""
    kept = F.filter(words(F.lower("text_snippet")), lambda word: (F.char_length(word) > 3) & ~word.isin(list(stop_words)))
    counted = top_counts(clauses, kept, top).select(F.col("item").alias("text"), F.col("amount").alias("value"))
    return counted.withColumn("size", F.least(F.col("value") * 2, F.lit(100)))
