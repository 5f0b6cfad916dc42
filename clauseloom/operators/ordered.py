"""Ranks and top-k that stay spread out when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.operators.sizing import broadcast_if_small
from clauseloom.session import stored

_POSITION = "_position"


def group_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column], output: str) -> DataFrame:
    """``row_number`` per group without gathering a group in one task.

    ``order`` must end in a unique key.  Rows are range-partitioned by group and
    order, so a large group covers many partitions.  A position inside the sorted
    partitions is stored, and each (group, partition) block learns how many rows
    of its group lie in earlier blocks.  The block table has at most one row per
    partition plus one per group: measured small it is broadcast and the rows are
    shuffled once, otherwise the join spreads them by group and block.  Both are
    stored as columns, so that counting a block reads its group and positions only.
    """
    keys = [F.col(name) for name in group] + list(order)
    positioned = stored(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(_POSITION, F.monotonically_increasing_id())
    )
    block = F.shiftright(_POSITION, 33)
    blocks = positioned.groupBy(*group, block.alias("_block")).agg(
        F.min(_POSITION).alias("_first"), F.count("*").alias("_rows")
    )
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored(blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))))
    return (
        positioned.withColumn("_block", block)
        .join(broadcast_if_small(blocks), [*group, "_block"])
        .withColumn(output, F.col(_POSITION) - F.col("_first") + F.col("_before") + 1)
        .select(*df.columns, output)
    )


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, output: str = "rank") -> DataFrame:
    """First ``k`` rows per group with their 1-based position.

    Spark cuts every task's share to ``k`` rows per group before the shuffle
    (WindowGroupLimit), so a hot group sends at most ``k`` rows per task.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(output, F.row_number().over(window)).where(F.col(output) <= k)


def merge_top_k(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, output: str = "rank", fan_out: int = 64,
    tasks: int | None = None,
) -> DataFrame:
    """``top_k`` over rows that already are per-task winners.

    Winners of many tasks are merged in two levels so that no single task
    receives ``k`` rows from every task of the scan; those of at most ``fan_out``
    ``tasks``, where their number is known, in one.
    """
    if tasks is not None and tasks <= fan_out:
        return top_k(df, group, order, k, output)
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(fan_out)))
    first = top_k(salted, [*group, "_salt"], order, k, "_salted_rank").drop("_salted_rank", "_salt")
    return top_k(first, group, order, k, output)


def take_positions(ranked: DataFrame, group: Sequence[str], rank: str, value: str, positions: dict[str, Column]) -> DataFrame:
    """Values found at 1-based positions that may depend on the group size ``n``.

    ``ranked`` carries the position of each row in its group in ``rank``.
    """
    sizes = ranked.groupBy(*group).agg(F.count("*").alias("n"))
    sized = ranked.join(broadcast_if_small(sizes), list(group))
    picks = [
        F.max(F.when(F.col(rank) == position, F.col(value))).alias(name) for name, position in positions.items()
    ]
    return sized.groupBy(*group).agg(F.first("n").alias("n"), *picks)
