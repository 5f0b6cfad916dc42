"""Exact order statistics of large groups by repeated counting of value ranges.

No group is sorted or gathered.  One pass finds the count, the ends and the sum of every group.
Then each wanted position has a range of values that holds it; a pass counts the rows of each
range in equal parts, and the part that holds the position, cut down to the values that occur
in it, is the next range.  Counts combine before the shuffle, so a round moves at most
``BUCKETS`` short rows for each task and position, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.operators.sizing import fits
from clauseloom.session import stored

BUCKETS = 2048
FEW_GROUPS = 10_000  # groups whose ranges are kept by the driver and sent to the tasks


def select_positions(
    values: DataFrame, group: Sequence[str], value: str, positions: Mapping[str, Column], buckets: int = BUCKETS
) -> DataFrame:
    """Values at 1-based positions of each group's ascending values, and n, low, high, total.

    ``positions`` may use the group's size ``n``; one outside 1..n gives null.  Null values don't
    count; NaN is not supported.  ``values`` is read once for each round; the few rounds
    depend on the spread of the values, not on their number.
    """
    keys = list(group)
    known = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value"))
    sizes = stored(
        known.groupBy(*keys).agg(
            F.count("*").alias("n"), F.min("_value").alias("low"), F.max("_value").alias("high"), F.sum("_value").alias("total")
        )
    )
    few = fits(sizes, FEW_GROUPS)
    wanted = [F.struct(F.lit(name).alias("name"), position.cast("long").alias("position")) for name, position in positions.items()]
    ranges = sizes.select(*keys, "n", "low", "high", F.explode(F.array(*wanted)).alias("_wanted")).select(
        *keys, F.col("_wanted.name").alias("name"), F.col("_wanted.position").alias("position"),
        F.lit(0).cast("long").alias("below"), "low", "high", F.col("_wanted.position").between(1, F.col("n")).alias("inside"),
    )
    ranges = _kept(ranges.where("inside").drop("inside"), few)
    found = [ranges.where("low = high")]
    by_magnitude = False
    while True:
        ranges = ranges.where("low < high")
        if ranges.isEmpty():
            break
        ranges = _kept(_narrowed(known, ranges, keys, buckets, by_magnitude, few), few)
        by_magnitude = not by_magnitude
        found.append(ranges.where("low = high"))
    done = found[0]
    for part in found[1:]:
        done = done.unionByName(part)
    picked = done.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("low"))).alias(name) for name in positions))
    if not keys:
        return sizes.join(F.broadcast(picked))
    return sizes.join(_hinted(picked, few), keys, "left")


def _kept(ranges: DataFrame, few: bool) -> DataFrame:
    """The ranges of a round, by the driver where they are few, else in the shared folder."""
    return ranges.sparkSession.createDataFrame(ranges.collect(), ranges.schema) if few else stored(ranges)


def _hinted(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _magnitude(value: Column) -> Column:
    """A value's place on a logarithmic scale of both signs; it never falls where the value rises."""
    size = F.abs(value)
    return F.when(size < 1e-308, F.lit(0.0)).otherwise(F.signum(value) * (F.log(size) + 710.0))


def _narrowed(known: DataFrame, ranges: DataFrame, keys: list[str], buckets: int, by_magnitude: bool, few: bool) -> DataFrame:
    """Each range cut down to the part that holds its position.

    Parts are equal in values or in magnitudes; taking turns, they soon tell apart both close
    values and those of many orders of magnitude.
    """
    # One row for each group, with its few ranges side by side.
    sides = ranges.groupBy(*keys).agg(F.collect_list(F.struct("name", "low", "high")).alias("_ranges"))
    rows = known.join(_hinted(sides, few), keys) if keys else known.join(F.broadcast(sides))
    rows = rows.select(*keys, "_value", F.explode("_ranges").alias("_range"))
    low, high = F.col("_range.low"), F.col("_range.high")
    # Halves keep the width finite for the largest doubles.
    share = (F.col("_value") / 2 - low / 2) / (high / 2 - low / 2)
    if by_magnitude:
        first, last = _magnitude(low), _magnitude(high)
        share = F.when(last > first, (_magnitude(F.col("_value")) - first) / (last - first)).otherwise(share)
    part = F.floor(share * buckets)
    counted = (
        rows.where(F.col("_value").between(low, high))
        .groupBy(*keys, F.col("_range.name").alias("name"), F.least(part, F.lit(buckets - 1)).alias("_part"))
        .agg(F.count("*").alias("_rows"), F.min("_value").alias("low"), F.max("_value").alias("high"))
    )
    # At most ``buckets`` rows for each position.
    before = Window.partitionBy(*keys, "name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    asked = ranges.select(*keys, "name", "position", "below")
    holds = (F.col("position") > F.col("below") + F.col("_before")) & (
        F.col("position") <= F.col("below") + F.col("_before") + F.col("_rows")
    )
    return (
        counted.join(_hinted(asked, few), [*keys, "name"])
        .where(holds)
        .select(*keys, "name", "position", (F.col("below") + F.col("_before")).alias("below"), "low", "high")
    )
