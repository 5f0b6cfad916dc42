"""Measured decisions: broadcast only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows.

    ``take`` reads partition by partition and stops one row later, so a large
    table is not scanned to learn that it is large.
    """
    return len(df.select(F.lit(1)).take(rows + 1)) <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a measured-small side; a larger one takes a shuffle join with AQE skew splitting."""
    return F.broadcast(df) if fits(df, rows) else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a scan that is too small to occupy the cores; leave larger ones alone.

    A table of many files already gives enough tasks and is never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(cores, key)
