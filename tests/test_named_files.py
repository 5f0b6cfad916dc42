import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clauseloom.sources import named_files
from clauseloom.sources.named_files import write_named


def names(folder):
    return sorted(path.name for path in folder.iterdir())


def test_one_file_per_name_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, "4"), ("a/x", 1, "1"), ("b", 1, "3"), (None, 1, "9"), ("b", 3, None)], "file string, n int, value string")
    write_named(rows, str(tmp_path / "out"), ["n"])
    assert names(tmp_path / "out") == ["a_x.json", "b.json"]
    assert json.loads((tmp_path / "out" / "b.json").read_text()) == [3, 4]


def test_modes(spark, tmp_path):
    path, out = str(tmp_path / "out"), tmp_path / "out"
    make = lambda *files: spark.createDataFrame([(f, 1, "1") for f in files], "file string, n int, value string")
    write_named(make("a", "b"), path, ["n"])
    (out / "note.txt").write_text("kept")
    write_named(make("b", "c"), path, ["n"])
    assert names(out) == ["b.json", "c.json", "note.txt"]
    write_named(make("d"), path, ["n"], mode="append")
    with pytest.raises(Exception, match="written before"):
        write_named(make("c", "e"), path, ["n"], mode="append")
    assert names(out) == ["b.json", "c.json", "d.json", "note.txt"]
    write_named(make().limit(0), path, ["n"])
    assert names(out) == ["note.txt"]


def test_a_large_source_spans_pieces(spark, tmp_path):
    rows = spark.range(4000).select(F.when(F.col("id") % 4 > 0, "hot").otherwise("cold").alias("file"), F.col("id").alias("n"), F.col("id").cast("string").alias("value"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_named(rows, str(tmp_path / "out"), ["n"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    hot = sorted((tmp_path / "out").glob("hot.*json"))
    assert len(hot) > 1
    assert [n for path in hot for n in json.loads(path.read_text())] == [n for n in range(4000) if n % 4]
    cold = sorted((tmp_path / "out").glob("cold*json"))
    assert [n for path in cold for n in json.loads(path.read_text())] == list(range(0, 4000, 4))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path, out = str(tmp_path / "out"), tmp_path / "out"
    write_named(spark.createDataFrame([("a", 1, "1")], "file string, n int, value string"), path, ["n"])
    rows = spark.range(1000).select(
        (F.col("id") % 7).cast("string").alias("file"), F.col("id").alias("n"),
        F.when(F.col("id") == 900, F.raise_error(F.lit("broken row"))).otherwise(F.lit("1")).alias("value"),
    )
    with pytest.raises(Exception, match="broken row"):
        write_named(rows, path, ["n"])
    assert names(out) == ["a.json"]


def test_a_failed_task_removes_its_own_files(tmp_path):
    import pyarrow as pa

    from clauseloom.sources.named_files import NamedFilesWriter

    writer = NamedFilesWriter(str(tmp_path / "out"), ".json", "array", True)

    def batches():
        yield pa.RecordBatch.from_pydict({"file": ["a", "a", "b"], "value": ["1", "2", "3"]})
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(batches())
    staged = tmp_path / "out" / f"_staged-{writer.job}"
    assert names(staged) == []
    writer.abort([None])
    assert names(tmp_path / "out") == []


def test_a_batch_becomes_objects_a_few_rows_at_a_time(tmp_path):
    sizes = []

    class Watched:
        num_rows = 200

        def slice(self, at, length):
            part = pa.RecordBatch.from_pydict({"file": ["a"] * 200, "value": [str(i) for i in range(200)]}).slice(at, length)
            sizes.append(part.num_rows)
            return part

    writer = named_files.NamedFilesWriter(str(tmp_path), ".txt", "text", True)
    writer.commit([writer.write(iter([Watched()]))])
    assert max(sizes) <= 64 and (tmp_path / "a.txt").read_text().split() == [str(i) for i in range(200)]
