"""Order statistics by counting, and the pruned nearest-template search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseloom.operators import nearest
from clauseloom.operators.selection import select_positions


def quarters():
    n = F.col("n")
    return {"q1": F.floor(n / 4) + 1, "median": F.floor(n / 2) + 1, "last": n, "none": n + 1}


def test_selection_equals_sorting(spark):
    rng = np.random.default_rng(3)
    groups = {
        "hot": rng.normal(size=4000).round(3).tolist(),  # most rows and many ties
        "one": [2.5],
        "same": [1.0] * 50,
        "wide": [float(10.0**e) for e in range(-300, 300, 20)] + [-1e308, 1e308, 0.0],
        "near": [1.0 + i * 2.0**-52 for i in range(40)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("hot", None), ("null", None), (None, 7.0)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(7)
    found = {r.g: r for r in select_positions(table, ["g"], "v", quarters(), buckets=32).collect()}
    assert set(found) == {*groups, None}
    for g, values in groups.items():
        ordered, n = sorted(values), len(values)
        row = found[g]
        assert (row.n, row.low, row.high) == (n, ordered[0], ordered[-1])
        assert (row.q1, row["median"], row["last"], row["none"]) == (ordered[n // 4], ordered[n // 2], ordered[-1], None)


def test_selection_without_groups(spark):
    table = spark.range(101).select((F.col("id") * 37 % 101).cast("double").alias("v"))
    row = select_positions(table, [], "v", quarters()).first()
    assert (row.n, row.q1, row["median"], row["last"], row.total) == (101, 25.0, 50.0, 100.0, 5050.0)
    assert select_positions(table.where("v < 0"), [], "v", quarters()).first().n == 0


def test_selection_shuffles_counts_only(spark):
    table = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = select_positions(table, ["g"], "v", quarters())._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "Sort" not in plan


SCHEMA = "{} long, state string, embedding array<double>"


def clusters(rng, count, size, width, spread=0.05):
    centres = rng.normal(size=(count, width)) * 3
    return [[float(x) for x in centres[i % count] + rng.normal(size=width) * spread] for i in range(size)]


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_pruned_search_equals_the_unpruned_one(spark, metric):
    rng = np.random.default_rng(6)
    vectors = clusters(rng, 12, 700, 5)
    odd = [[0.0] * 5, [float("nan")] * 5, [float("inf")] + [0.0] * 4, [1.0, 2.0], [], None]
    state = lambda i: "hot" if i % 3 else ("rare" if i % 2 else None)
    templates = [(i, state(i), v) for i, v in enumerate(vectors[:300] + vectors[:40] + odd)]  # copies are ties
    clauses = [(i, state(i), v) for i, v in enumerate(vectors[300:] + vectors[:40] + odd)] + [(9000, "alone", vectors[0])]
    tables = spark.createDataFrame(clauses, SCHEMA.format("clause_id")), spark.createDataFrame(templates, SCHEMA.format("template_id"))
    whole = nearest.nearest_template(*tables, ["state"], metric)
    pruned = nearest.nearest_template(*tables, ["state"], metric, broadcast_limit=0, template_block=12, clause_block=40)
    rows = lambda df: sorted((r.clause_id, round(r.similarity, 9), r.template_id) for r in df.collect())
    assert rows(whole) == rows(pruned) and len(rows(whole)) > 250
    report = {r.state: (r.compared, r.pairs) for r in nearest.pruning(*tables, ["state"], metric, template_block=12).collect()}
    assert report["hot"][0] < 0.5 * report["hot"][1]  # clusters far apart: most pairs are skipped


def test_scattered_vectors_are_compared_with_all(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "s", rng.normal(size=64).tolist()) for i in range(200)]
    tables = spark.createDataFrame(rows[100:], SCHEMA.format("clause_id")), spark.createDataFrame(rows[:100], SCHEMA.format("template_id"))
    report = nearest.pruning(*tables, ["state"], template_block=20).first()
    assert 0 < report.compared <= report.pairs == 10_000


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_copies_of_a_row_do_not_grow_with_the_other_side(spark, monkeypatch, metric):
    rng = np.random.default_rng(8)
    rows = [(i, "s", rng.normal(size=4).tolist()) for i in range(2400)]
    clauses, templates = (spark.createDataFrame(part, SCHEMA.format(name)) for part, name in ((rows[1200:], "clause_id"), (rows[:1200], "template_id")))
    whole = nearest.nearest_template(clauses, templates, ["state"], metric).collect()
    used = {}
    real = nearest._with_blocks

    def watched(left, right, cell, metric, template_block, clause_block):
        used.update(copies=left.count() / 1200, blocks=1200 / template_block, clause_blocks=1200 / clause_block)
        return real(left, right, cell, metric, template_block, clause_block)

    monkeypatch.setattr(nearest, "_with_blocks", watched)
    found = nearest.nearest_template(clauses, templates, ["state"], metric, broadcast_limit=0, template_block=2, clause_block=4)
    rows = lambda found: sorted((r.clause_id, round(r.similarity, 9), r.template_id) for r in found)
    assert rows(found.collect()) == rows(whole) and len(whole) == 1200
    assert used["blocks"] <= nearest.BLOCKS and used["clause_blocks"] <= nearest.BLOCKS and used["copies"] <= 3 * nearest.BLOCKS


def test_scores_are_compared_in_bounded_steps(monkeypatch):
    rng = np.random.default_rng(9)
    left, right, ids = rng.normal(size=(50, 3)), rng.normal(size=(20, 3)), np.arange(20)[::-1]
    whole = nearest._best(left, right, ids, "cosine")
    sizes = []
    real = nearest.similarities
    monkeypatch.setattr(nearest, "similarities", lambda a, b, metric: sizes.append(len(a) * len(b)) or real(a, b, metric))
    monkeypatch.setattr(nearest, "SCORES", 100)
    stepped = nearest._best(left, right, ids, "cosine")
    assert max(sizes) <= 100 and all((a == b).all() for a, b in zip(whole, stepped))
    assert [len(part) for part in nearest._best(left[:0], right, ids, "cosine")] == [0, 0]
