"""The postings index against the map-only BM25 ranking."""

import re

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from clauseloom.operators import postings, ranking
from clauseloom.plans import driver_tables, queries
from tests.test_ranking import ATTRIBUTES, CHUNKS


def clustered(seed=1, size=1200):
    """Frequent words everywhere, rare ones in a few neighbouring chunks; some chunks have no words."""
    rng = np.random.default_rng(seed)
    common = ["the", "of", "and", "rate", "fee"]
    chunks = []
    for i in range(size):
        words = list(rng.choice(common, rng.integers(0, 9)))
        if i // 60 in (3, 11):
            words += list(rng.choice(["zeta", "omega", "kappa"], 3))
        chunks.append((i * 3, f"c{i}", 1, "", " ".join(words) if i % 50 else None, "s", None))
    return chunks


QUERIES = ["zeta omega the", "kappa", "the of the", "unseen words", "fee rate of zeta", ""]


@pytest.fixture(scope="module")
def tables(spark):
    chunks = spark.createDataFrame(clustered(), CHUNKS).repartition(5)
    attributes = spark.createDataFrame([(n, f"a{n}", q, None) for n, q in enumerate(QUERIES, 1)], ATTRIBUTES)
    return chunks, attributes


def rows(df):
    return sorted((r.attribute_number, r["rank"], r.doc_idx, round(r.bm25_score, 9)) for r in df.collect())


def test_index_gives_the_exact_ranking_and_skips_blocks(spark, tables, tmp_path):
    chunks, attributes = tables
    index = postings.write_index(chunks, str(tmp_path / "index"), block=64)
    assert index.documents == 1200
    for k in (3, 40):
        answer = postings.bm25_top_k(index, attributes, k)
        assert rows(answer.top) == rows(ranking.bm25_top_k(attributes, chunks, k))
    few = {r.attribute_number: (r.scored, r.blocks) for r in postings.bm25_top_k(index, attributes, 3).blocks.collect()}
    # Rare words lie in a few of the 57 blocks; a query of frequent words alone scores all of them.
    assert few[1][1] == 57 and few[1][0] <= 8 and few[2][1] <= 8 and few[3] == (57, 57)


def test_index_is_written_once_and_opened_again(spark, tables, tmp_path):
    chunks, attributes = tables
    path = str(tmp_path / "index")
    first = postings.bm25_top_k(postings.write_index(chunks, path), attributes, 5).top
    again = postings.bm25_top_k(postings.open_index(spark, path), attributes, 5).top
    assert rows(first) == rows(again)
    # A frequent term is one row for each block, never one for the corpus.
    entries = postings.write_index(chunks, str(tmp_path / "small"), block=32).postings
    assert entries.selectExpr("max(size(entries))").first()[0] <= 32


def test_index_of_nothing(spark, tables, tmp_path):
    _, attributes = tables
    index = postings.write_index(spark.createDataFrame([], CHUNKS), str(tmp_path / "index"))
    assert postings.bm25_top_k(index, attributes).top.count() == 0
    blank = spark.createDataFrame([(i, "c", 1, "", None, "s", None) for i in range(5)], CHUNKS)
    found = postings.bm25_top_k(postings.write_index(blank, str(tmp_path / "blank")), attributes, 2).top
    assert rows(found) == [(n, r, r - 1, 0.0) for n in range(1, 7) for r in (1, 2)]


def test_postings_travel_to_their_block_once(spark, tmp_path):
    table = spark.createDataFrame([(i, f"fee rate w{i % 7} w{i % 3}") for i in range(60)], "doc_idx long, content string")
    asked = spark.createDataFrame([(n, f"fee rate w{n % 7}") for n in range(30)], "attribute_number long, content string")
    index = postings.write_index(table, str(tmp_path / "index"), block=8)
    weighed = postings._weighed(index, postings.query_terms(asked))
    found = postings._scores(index, weighed, weighed.select("attribute_number", "block").distinct())
    plan = found._jdf.queryExecution().executedPlan().toString()
    # No exchange carries a pair of attribute and chunk.
    assert not re.search(r"hashpartitioning\([^)]*doc_idx", plan) and "hashpartitioning(block" in plan
    assert found.count() == found.select("attribute_number", "doc_idx").distinct().count() == 30 * 60


def test_texts_travel_once_and_postings_do_not(spark, tmp_path, monkeypatch):
    table = spark.createDataFrame([(i, f"fee rate w{i % 7}") for i in range(60)], "doc_idx long, content string")
    plans, write = {}, DataFrameWriter.parquet

    def parquet(self, path, *rest):
        plans[path.rsplit("/", 1)[-1]] = self._df._jdf.queryExecution().executedPlan().toString()
        write(self, path, *rest)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    postings.write_index(table, str(tmp_path / "index"), block=8)
    assert [line.split("Exchange ")[1].split("(")[0] for line in plans["postings"].splitlines() if "Exchange " in line] == [
        "hashpartitioning"
    ]
    assert "hashpartitioning(block" in plans["postings"] and "Exchange " not in plans["bounds"] + plans["chunks"]


def test_no_table_holds_all_pairs(tables, tmp_path, monkeypatch):
    chunks, attributes = tables
    index = postings.write_index(chunks, str(tmp_path / "index"), block=64)
    kept, keep = [], postings.stored
    monkeypatch.setattr(postings, "stored", lambda df: kept.append(keep(df)) or kept[-1])
    answer = postings.bm25_top_k(index, attributes, 3)
    assert rows(answer.top) == rows(ranking.bm25_top_k(attributes, chunks, 3))
    # At most one row for each attribute and block; the six attributes share terms with over 3000 of the chunks.
    assert max(table.count() for table in kept) <= 6 * 57


@pytest.fixture(scope="module")
def odd(spark):
    """Numbers that are missing, come again with other texts, or crowd one block."""
    table = [(i, f"fee rate w{i % 5} w{i % 3}") for i in range(40)] + [(3, "fee fee w9"), (3, None), (-2, "rate")]
    table += [(None, f"fee w{i % 4}") for i in range(6)] + [(17, f"rate w{i % 7}") for i in range(60)]
    chunks = spark.createDataFrame(table, "doc_idx long, content string").repartition(3)
    asked = ["fee w1", "rate rate w6", "w9", "none", "fee rate"]
    return table, chunks, spark.createDataFrame(list(enumerate(asked)), "attribute_number long, content string")


def listed(index):
    entry = F.struct("term", "block", F.transform("entries", lambda e: F.struct(e["doc_idx"], e["tf"], e["length"])))
    found = [(t, b, tuple(sorted(map(tuple, e), key=str))) for t, b, e in (r[0] for r in index.postings.select(entry).collect())]
    return sorted(found, key=str), sorted(map(tuple, index.bounds.collect()), key=str)


def test_odd_numbers_are_indexed_alike_by_both_ways(odd, tmp_path, monkeypatch):
    table, chunks, _ = odd
    found = listed(postings.write_index(chunks, str(tmp_path / "some"), block=8))
    expected = {}
    for number, text in table:
        words = (text or "").split()
        for word in set(words):
            block = None if number is None else int(number / 8)
            expected.setdefault((word, block), []).append((number, words.count(word), len(words)))
    assert found[0] == sorted(((*key, tuple(sorted(e, key=str))) for key, e in expected.items()), key=str)
    for limit in (0, 1000):  # all blocks crowded; none but that of missing numbers
        monkeypatch.setattr(postings, "CROWDED", limit)
        assert listed(postings.write_index(chunks, str(tmp_path / str(limit)), block=8)) == found


def test_answers_do_not_depend_on_what_is_broadcast(odd, tables, tmp_path, monkeypatch):
    _, chunks, attributes = odd

    def answers(name):
        answer = postings.bm25_top_k(postings.write_index(chunks, str(tmp_path / name), block=8), attributes, 4)
        blocks = sorted(map(tuple, answer.blocks.collect()))
        return rows(answer.top.na.fill(-1, ["doc_idx"])), blocks

    small = answers("small")
    assert [row[2] for row in small[0] if row[0] == 3] == [-1] * 4  # no shared term: the first chunks, by number
    monkeypatch.setattr(postings, "fits", lambda df, rows=0: False)
    monkeypatch.setattr(postings, "broadcast_if_small", lambda df, rows=0: df)
    assert answers("large") == small


def test_chunk_texts_are_those_of_the_chunks(spark, tmp_path):
    documents = spark.createDataFrame(
        [(i, None if i == 4 else f"text {i}", "en", "s", 10) for i in (None, 1, 2, 2, 3, 4)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    vectors = spark.createDataFrame([(n, [0.5]) for n in (None, None, 2, 2, 2, 3, 4, 4, 9, 9)], "vec_id long, embedding array<float>")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = driver_tables.chunk_texts(spark, str(tmp_path))
    chunks = driver_tables.chunks(spark, str(tmp_path)).select("doc_idx", "content")
    assert found.schema == chunks.schema and found.count() == 11
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, chunks.collect()), key=str)


def test_indexed_texts_are_not_sent_to_their_vectors(spark, tmp_path, monkeypatch):
    documents = [(256 * i, f"the fee w{i}", "en", "s", 10) for i in range(12)]
    documents = spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long")
    vectors = spark.createDataFrame([(256 * i, [0.5]) for i in (0, 0, 1, 2)], "vec_id long, embedding array<float>")
    for name, table in (("documents", documents), ("embeddings", vectors)):
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    plans, write = {}, DataFrameWriter.parquet

    def parquet(self, path, *rest):
        plans[path.rsplit("/", 1)[-1]] = self._df._jdf.queryExecution().executedPlan().toString()
        write(self, path, *rest)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = queries._postings(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert index.documents == 13 and index.average_length == 3
    assert "SortMergeJoin" not in plans["postings"] and plans["postings"].count("hashpartitioning(block") == 1
