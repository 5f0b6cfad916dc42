"""Mixing sources to target weights by temperature.  DataFrame functions only.

The share of each source's tokens is raised to an exponent and normalised.  The
exponent is found by bisection: 1 keeps the corpus as it is, 0 makes all sources
equal.  The weights are then realised as whole and partial passes over the sources,
each pass a permutation of token blocks with its own order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import stored

NO_SOURCE = "\x00none"  # stands for a null source inside the operator


@dataclass(frozen=True)
class Target:
    """Give ``entropy`` (a share of the greatest possible, 0 to 1) or ``repetitions`` (most passes over a source).

    ``budget``: tokens of the mix; without one, the source used least gets exactly one
    pass, so that no document is left out.  ``block_tokens``: tokens of a block, about.
    """

    entropy: float | None = None
    repetitions: float | None = 4.0
    budget: int | None = None
    block_tokens: int = 1 << 20
    seed: int = 17


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit(NO_SOURCE))


def _sums(sources: DataFrame, exponent: float) -> tuple[float, float, float, float]:
    """Sum of powers, entropy of the weights, and the largest and smallest of weight / share."""
    power = F.pow("share", F.lit(exponent))
    ratio = F.pow("share", F.lit(exponent - 1.0))
    total, weighted, most, least = sources.agg(
        F.sum(power), F.sum(power * F.log("share")), F.max(ratio), F.min(ratio)
    ).first()
    entropy = math.log(total) - exponent * weighted / total
    return total, entropy, most / total, least / total


def exponent_for(sources: DataFrame, target: Target, steps: int = 40) -> float:
    """Exponent between 0 and 1 by bisection over the table of shares (one row for each source).

    For ``entropy``: the largest exponent whose weights reach it.  For ``repetitions``: the
    smallest at which no source is passed over more often.
    """
    n, volume = sources.agg(F.count("*"), F.sum("tokens")).first()
    if n < 2:
        return 1.0

    def flat_enough(exponent: float) -> bool:
        _, entropy, most, least = _sums(sources, exponent)
        if target.entropy is not None:
            return entropy >= target.entropy * math.log(n) - 1e-12
        # weight * budget / tokens; without a budget the smallest such number is one
        passes = most * target.budget / volume if target.budget is not None else most / least
        return passes > target.repetitions

    low, high = 0.0, 1.0
    if flat_enough(high):
        return high
    if not flat_enough(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        if flat_enough(middle):
            low = middle
        else:
            high = middle
    return low if target.entropy is not None else high


def weights(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """Stored table of the sources: source, tokens, share, exponent, weight, passes (a number >= 0).

    ``docs`` needs source and tokens.  Sources without tokens get weight 0 and one pass.
    """
    totals = docs.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("tokens").alias("tokens"))
    totals = stored(totals.coalesce(4))
    volume = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shares = totals.withColumn("share", F.col("tokens") / F.lit(float(volume or 1)))
    positive = shares.where("tokens > 0")
    exponent = exponent_for(positive, target) if volume else 1.0
    total, _, _, least = _sums(positive, exponent) if volume else (1.0, 0.0, 1.0, 1.0)
    budget = float(target.budget) if target.budget is not None else volume / least
    weight = F.when(F.col("tokens") > 0, F.pow("share", F.lit(exponent)) / total).otherwise(F.lit(0.0))
    passes = F.when(F.col("tokens") > 0, F.round(F.col("weight") * budget / F.col("tokens"), 9)).otherwise(F.lit(1.0))
    return (
        shares.withColumn("exponent", F.lit(exponent)).withColumn("weight", weight).withColumn("passes", passes)
    )


def mix(docs: DataFrame, target: Target = Target(), row: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """The passes that realise the target: source, tokens, pass, block, place, position, exponent, weight.

    ``docs`` needs source, text and ``row``, the column that names a row; it comes first in
    the result.  ``carry`` names columns to repeat with each pass, prefixed ``doc_``  Each source is
    passed over floor(passes) times whole, and once in part: blocks in the order of the
    last pass's permutation as long as the budget lasts, and of the block at its end the
    documents that still fit.  ``position`` numbers a block's documents.  Order within a
    source: pass, then the block's place in the pass (``place``), then position.

    (columns of any name can be carried, as none of theirs meets one of the operator's).
    A source is spread over blocks of about ``block_tokens`` tokens by a hash of the row
    number, so one source with most of the rows, and copies, spread alike.  A null source
    is a source of its own; null and empty texts hold no tokens and go with each whole
    pass; repeated rows count each; an empty table gives no rows.
    """
    seed = target.seed
    rows = docs.select(
        F.col(row).alias("row"), source_key(F.col("source")).alias("source"),
        token_count(F.col("text")).alias("tokens"), *(F.col(name).alias(f"doc_{name}") for name in carry),
    )
    extra = [f"doc_{name}" for name in carry]
    if not carry:
        rows = stored(rows)  # narrow: the texts are read once
    table = weights(rows, target)
    blocks_of = F.greatest(F.lit(1), F.ceil(F.col("tokens") / target.block_tokens)).cast("long")
    sized = table.select("source", "exponent", "weight", "passes", blocks_of.alias("blocks"))
    spread = rows.join(sized, "source").withColumn(
        "block", F.pmod(F.xxhash64(F.col("row"), F.lit(seed)), F.col("blocks"))
    )
    whole = F.floor("passes").cast("long")
    blocks = (
        spread.groupBy("source", "block")
        .agg(
            F.sum("tokens").alias("size"), F.first("passes").alias("passes"),
            F.first("weight").alias("weight"), F.first("exponent").alias("exponent"),
        )
        .join(table.select("source", F.col("tokens").alias("total")), "source")
    )
    # Which blocks the partial pass takes: a running sum over blocks, not over documents.
    turn = Window.partitionBy("source").orderBy(F.xxhash64("block", whole, F.lit(seed + 1)), "block")
    before = F.coalesce(F.sum("size").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.round((F.col("passes") - whole) * F.col("total")).cast("long")
    blocks = stored(
        blocks.withColumn("left", rest - before)
        .withColumn("last", F.when(F.col("left") > 0, F.col("left")))
        .select("source", "block", "exponent", "weight", whole.alias("whole"), "last")
    )
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("row", F.lit(seed + 2)), "row", "tokens")
    placed = (
        spread.select("row", "source", "tokens", "block", *extra)
        .withColumn("position", F.row_number().over(inside))
        .withColumn("through", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(blocks, ["source", "block"])
    )
    partial = (F.col("last").isNotNull() & (F.col("tokens") > 0) & (F.col("through") <= F.col("last"))).cast("long")
    times = F.col("whole") + partial
    repeated = placed.where(times > 0).withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return repeated.select(
        F.col("row").alias(row),
        F.when(F.col("source") != NO_SOURCE, F.col("source")).alias("source"),
        "tokens", "pass", "block",
        F.xxhash64("block", F.col("pass") - 1, F.lit(seed + 1)).alias("place"),
        "position", "exponent", "weight", *extra,
    )
