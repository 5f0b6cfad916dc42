"""The threshold algorithm of the per-source fusion against the ranking of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseloom.operators import ranking, scoring
from tests.test_ranking import ATTRIBUTES, CHUNKS, corpus, unit

COLUMNS = ["attribute_number", "source_file", "doc_idx", "dense_rank", "bm25_rank", "rank_in_source"]


def full_ranking(attributes, chunks, k, rrf_k):
    return ranking._ranked_in_source(ranking.rrf_scores(attributes, chunks, rrf_k), k)


def assert_equal(found, expected):
    key = lambda row: tuple(str(v) for v in row)
    assert sorted(map(tuple, found.select(COLUMNS).collect()), key=key) == sorted(map(tuple, expected.select(COLUMNS).collect()), key=key)


def opposed(size=600):
    """One source with two thirds of the chunks whose two rankings run against each other, and many ties."""
    rng = np.random.default_rng(5)
    chunks = []
    for i in range(size):
        hot = i % 3 > 0
        # The nearer the vector, the longer and so the weaker the text.
        vector = [float(np.cos(i / size)), float(np.sin(i / size))] if hot else unit(rng, 2)
        text = "alpha " + "filler " * (1 + (size - i) // 40) if hot else str(rng.choice(["alpha", "alpha beta", "other words"]))
        source = "hot.md" if hot else (None if i % 2 else f"s{i % 5}.md")
        chunks.append((i, f"c{i}", 1, "", text, source, vector if i % 10 else None))
    return chunks, [(1, "a", "alpha alpha", [1.0, 0.0]), (2, "b", "beta", [0.0, 1.0]), (3, "c", "other alpha", None)]


@pytest.fixture()
def rounds(monkeypatch):
    seen = []
    original = ranking.source_best

    def counted(rows, scorer, depth, cells=None):
        seen.append((depth, len(scorer.numbers), cells and sorted(cells, key=str)))
        return original(rows, scorer, depth, cells)

    monkeypatch.setattr(ranking, "source_best", counted)
    return seen


@pytest.mark.parametrize(("k", "rrf_k"), [(1, 1), (3, 2)])
def test_hot_source_and_ties_equal_the_full_ranking(spark, rounds, k, rrf_k):
    chunks, attributes = opposed()
    rows, items = spark.createDataFrame(chunks, CHUNKS).repartition(4), spark.createDataFrame(attributes, ATTRIBUTES)
    expected = full_ranking(items, rows, k, rrf_k)
    assert_equal(ranking.rrf_per_source(items, rows, k, rrf_k), expected)
    # Shallow heads don't settle the opposed source: it is asked again, without the settled ones.
    assert len(rounds) > 1 and rounds[0][2] is None and "hot.md" in rounds[1][2]
    assert [depth for depth, *_ in rounds] == [2 * k * 2**i for i in range(len(rounds))]


def test_settled_cells_need_no_pairs(spark, monkeypatch, rounds):
    chunks, attributes = corpus(9, 500, 4, missing=0.2)
    rows, items = spark.createDataFrame(chunks, CHUNKS).repartition(3), spark.createDataFrame(attributes, ATTRIBUTES)
    expected = full_ranking(items, rows, 4, 20)
    expected.cache().count()
    monkeypatch.setattr(ranking, "rrf_scores", None)  # the ranking of all pairs isn't asked
    monkeypatch.setattr(scoring, "STATE_VALUES", 500)  # tasks hand heads on more than once
    monkeypatch.setattr(scoring, "BATCH_ROWS", 30)
    found = ranking.rrf_per_source(items, rows, 4, 20)
    assert_equal(found, expected)
    # The plan of the result holds candidates, not (attributes x chunks) rows.
    assert found.count() < len(chunks) * len(attributes) and all(depth <= 32 for depth, *_ in rounds)


@pytest.mark.parametrize("limit", [1, 300, 1500])
def test_small_limits_give_the_same_result(spark, limit):
    chunks, attributes = opposed(240)
    rows, items = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(attributes, ATTRIBUTES)
    assert_equal(ranking.rrf_per_source(items, rows, 2, 3, limit=limit), full_ranking(items, rows, 2, 3))


def test_no_chunks_and_no_vectors(spark):
    items = spark.createDataFrame([(1, "a", "alpha", [1.0, 0.0])], ATTRIBUTES)
    none = spark.createDataFrame([], CHUNKS)
    assert ranking.rrf_per_source(items, none).count() == 0
    rows = spark.createDataFrame([(i, "c", 1, "", "alpha" if i else None, "s", None) for i in range(4)], CHUNKS)
    found = ranking.rrf_per_source(items, rows, 2).orderBy("rank_in_source").collect()
    assert [(r.doc_idx, r.dense_rank) for r in found] == [(0, 5), (1, 5)]  # alpha in most chunks counts negatively


def test_vectors_of_different_lengths_have_no_similarity(spark):
    rows = spark.createDataFrame(
        [(0, "c", 1, "", "x", "s", [1.0, 0.0]), (1, "c", 1, "", "x", "s", [1.0, 0.0, 0.0]), (2, "c", 1, "", "x", "s", [])], CHUNKS
    )
    items = spark.createDataFrame([(1, "a", "x", [1.0, 0.0]), (2, "b", "x", [1.0, 0.0, 0.0])], ATTRIBUTES)
    found = {(r.attribute_number, r.doc_idx) for r in ranking.dense_top_k(items, rows).collect()}
    assert found == {(1, 0), (2, 1)}


def test_counted_terms_keep_only_the_dictionary(spark):
    rows = spark.createDataFrame([(0, "s", "The alpha, the BETA the"), (1, "s", None), (2, "s", "none of it")], "doc_idx long, source_file string, content string")
    counted = {r.doc_idx: r for r in scoring.counted_terms(rows, ["beta", "the"]).collect()}
    assert (counted[0].length, list(counted[0].term_index), list(counted[0].term_count)) == (5, [0, 1], [1, 3])
    assert (counted[1].length, list(counted[1].term_index)) == (0, []) and counted[2].length == 3
    stats = scoring.counted_stats(scoring.counted_terms(rows, ["beta", "the"]), ["beta", "the"])
    assert stats.documents == 3 and stats.average_length == 8 / 3 and stats.document_frequency == {"beta": 1, "the": 1}
    assert scoring.counted_terms(rows.where(F.lit(False)), []).count() == 0
