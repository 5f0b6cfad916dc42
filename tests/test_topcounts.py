"""Exact most frequent items by local counts, a bound and a recount of candidates."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseloom.operators import topcounts


@pytest.mark.parametrize("limit", [500_000, 5])
def test_top_counts_with_ties_at_the_last_place(spark, monkeypatch, limit):
    monkeypatch.setattr(topcounts, "TABLE_ITEMS", limit)
    rng = np.random.default_rng(2)
    # Items of one kind of rows each, so that tasks disagree about what is frequent.
    lists = [[f"w{int(x)}" for x in rng.zipf(1.6, 12) if x < 400] + [f"own{i % 30}"] * (i % 4) for i in range(400)]
    lists += [None, [], [None, "w1"]]
    rows = spark.createDataFrame([(x,) for x in lists], "x array<string>").repartition(9)
    counts = Counter(w for x in lists if x for w in x if w)
    ordered = sorted(counts.items(), key=lambda item: (-item[1], item[0]))
    tied = next(i for i in range(5, len(ordered)) if ordered[i - 1][1] == ordered[i][1])
    for k in (1, tied, len(ordered) + 5):
        assert [tuple(r) for r in topcounts.top_counts(rows, F.col("x"), k).collect()] == ordered[:k]


def test_rare_items_are_no_candidates(spark):
    rows = spark.range(4000).select(F.array(F.lit("often"), F.concat(F.lit("rare"), F.col("id").cast("string"))).alias("x"))
    counts = topcounts.local_counts(rows.repartition(4), F.col("x"))
    assert counts.count() >= 4004
    assert {r.item for r in topcounts.candidates(counts, 1).collect()} == {"often"}
    nothing = rows.where("size(x) = 0")
    assert topcounts.top_counts(nothing, F.col("x"), 3).count() == 0
