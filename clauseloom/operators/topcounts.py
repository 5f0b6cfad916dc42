"""The most frequent items of array columns, exactly, without shuffling the rare ones.

Each task counts its own items and writes the counts down, with their rank, where it runs.  The
heads of all tasks give partial sums; the k-th of those is a count that the k-th item reaches at
least.  An item that reaches it in total reaches the m-th part of it in one of m tasks, so only
items that do are candidates, and the counts of candidates alone are added up.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.operators.sizing import broadcast_if_small
from clauseloom.session import stored

TABLE_ITEMS = 500_000  # distinct items that a task counts together; beyond them it begins anew
LOCAL = "part string, item string, amount long, place long"


def _local_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, part = TaskContext.get().partitionId(), 0
    table: dict[str, int] = {}
    for batch in batches:
        found = batch.column("items").flatten().drop_null().value_counts()
        for item, amount in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
            table[item] = table.get(item, 0) + amount
        if len(table) > TABLE_ITEMS:
            yield from _written(f"{task}-{part}", table)
            table, part = {}, part + 1
    yield from _written(f"{task}-{part}", table)


def _written(part: str, table: dict[str, int]) -> Iterator[pa.RecordBatch]:
    rows = sorted(table.items(), key=lambda row: -row[1])
    for at in range(0, len(rows), 50_000):
        some = rows[at : at + 50_000]
        columns = [
            pa.array([part] * len(some), pa.string()),
            pa.array([row[0] for row in some], pa.string()),
            pa.array([row[1] for row in some], pa.int64()),
            pa.array(range(at + 1, at + len(some) + 1), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "item", "amount", "place"])


def local_counts(rows: DataFrame, items: Column) -> DataFrame:
    """(part, item, amount, place): the counts of each task, most frequent first."""
    return stored(rows.select(items.alias("items")).mapInArrow(_local_counts, LOCAL))


def candidates(counts: DataFrame, k: int) -> DataFrame:
    """The counts of all items that can be among the ``k`` most frequent ones."""
    parts = counts.where("place = 1").count()
    heads = counts.where(F.col("place") <= k).groupBy("item").agg(F.sum("amount").alias("amount"))
    # At most k short rows reach the driver.
    reached = [row["amount"] for row in heads.orderBy(F.desc("amount")).limit(k).collect()]
    least = reached[-1] if len(reached) == k else 0
    # Written as a product: no rounding of the share of one part.
    hopeful = counts.where(F.col("amount") * max(parts, 1) >= least).select("item").distinct()
    return counts.join(broadcast_if_small(hopeful), "item", "left_semi")


def top_counts(rows: DataFrame, items: Column, k: int) -> DataFrame:
    """The ``k`` most frequent items of an array column and their ``amount``; ties by item.

    Null arrays and null items don't count.  An item counts as often as it is in a row.
    """
    totals = candidates(local_counts(rows, items), k).groupBy("item").agg(F.sum("amount").alias("amount"))
    return totals.orderBy(F.desc("amount"), F.asc("item")).limit(k)
