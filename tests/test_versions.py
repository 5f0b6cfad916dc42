import pytest
from pyspark.sql import functions as F

from clauseloom.sources import versions as V

SCHEMA = "row_id string, collection_key string, text string"


def rows(spark, *found):
    return spark.createDataFrame(list(found), SCHEMA)


def held(spark, path, number=None):
    return sorted(map(tuple, V.read_collections(spark, path, number).select("row_id", "collection_key", "text").collect()))


def test_replace_append_and_older_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        V.read_collections(spark, path)
    V.replace_collections(rows(spark, ("1", "TN", "a"), ("2", "TN", "b"), ("3", "007", "c")), path)
    V.append_rows(rows(spark, ("2", "TN", "again"), ("4", "TN", "d"), ("4", "TN", "d"), ("3", "WA", "held by another")), path)
    assert held(spark, path) == [("1", "TN", "a"), ("2", "TN", "b"), ("3", "007", "c"), ("4", "TN", "d")]
    last = V.replace_collections(rows(spark, ("9", "TN", "z")), path)
    assert held(spark, path) == [("3", "007", "c"), ("9", "TN", "z")]
    assert last.number == 3 and held(spark, path, 1) == [("1", "TN", "a"), ("2", "TN", "b"), ("3", "007", "c")]
    # Nothing new makes no version; an id that was replaced may come again.
    assert V.append_rows(rows(spark, ("9", "TN", "z")), path).number == 3
    assert V.append_rows(rows(spark, ("1", "TN", "new")), path).number == 4
    assert ("1", "TN", "new") in held(spark, path)
    with pytest.raises(ValueError):
        V.read_collections(spark, path, 99)


def test_failed_and_late_writes_change_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    first = V.replace_collections(rows(spark, ("1", "TN", "a")), path)
    before = held(spark, path)
    broken = rows(spark, ("2", "TN", "x"), ("3", "WA", "y")).withColumn(
        "text", F.when(F.col("row_id") == "3", F.raise_error(F.lit("lost"))).otherwise(F.col("text"))
    )
    for write in (V.replace_collections, V.append_rows):
        with pytest.raises(Exception, match="lost"):
            write(broken, path)
        with pytest.raises(Exception, match="every row needs"):
            write(rows(spark, (None, "TN", "x")), path)
    assert held(spark, path) == before and V.current(spark, path).number == 1
    with pytest.raises(V.ConcurrentWrite):
        V._commit(spark, path, first)
    assert held(spark, path) == before


def test_filters_pass_every_held_id_and_few_others(spark, tmp_path):
    path = str(tmp_path / "t")
    numbered = spark.range(4000).select(
        F.lpad(F.col("id").cast("string"), 6, "0").alias("row_id"), F.lit("TN").alias("collection_key"), F.lit("x").alias("text")
    )
    V.replace_collections(numbered.where("row_id % 2 = 0"), path)
    version = V.current(spark, path)
    assert V._parts_that_may_hold(numbered.where("row_id = 44"), path, version) == version.parts
    assert V._parts_that_may_hold(numbered.where("row_id = 44").withColumn("row_id", F.lit("a")), path, version) == ()
    part, = version.parts
    text = F.col("row_id")
    filters = spark.read.parquet(f"{path}/keys/{part.folder}")
    asked = numbered.select(text, V._word(text, F.lit(part.words)).alias("word"), V._bits(text).alias("mask")).join(filters, "word")
    passed = [int(r.row_id) for r in asked.where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).collect()]
    assert sum(i % 2 == 0 for i in passed) == 2000 and sum(i % 2 for i in passed) < 300
    V.append_rows(numbered, path)
    assert V.read_collections(spark, path).count() == 4000 == V.read_collections(spark, path).distinct().count()


def test_empty_table_and_clashing_names(spark, tmp_path):
    path = str(tmp_path / "t")
    named = spark.createDataFrame([("1", "TN", 5, 6)], "row_id string, collection_key string, words int, word int")
    V.replace_collections(named, path)
    V.append_rows(named.where("false"), path)
    assert [tuple(r) for r in V.read_collections(spark, path).select("row_id", "words", "word").collect()] == [("1", 5, 6)]
