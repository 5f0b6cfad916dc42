"""What the operators share: tables, stored intermediate results, connected components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.session import ensure_checkpoint_dir

_FOLDERS: dict[str, SparkSession] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    A later failure reads the files instead of repeating the work, values that a
    task chose (such as partition numbers) become fixed, and unused columns are
    pruned.  The files go when the driver ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    if not _FOLDERS:
        atexit.register(_discard_all)
    _FOLDERS[path] = spark
    again = spark.read.schema(df.schema).parquet(path)
    again.stored_path = path
    return again


def discard(df: DataFrame) -> None:
    """Delete the files behind a result of ``stored`` that is no longer read."""
    path = getattr(df, "stored_path", None)
    spark = _FOLDERS.pop(path, None)
    if spark is not None:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _discard_all() -> None:
    for path, spark in list(_FOLDERS.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before the interpreter
            return


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one slice take about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node of ``edges`` (a, b long): rows (node, component).

    Alternates star contractions, so the number of rounds grows with the logarithm
    of a chain's length.  Minima are combined before the shuffle and the joins are
    equi-joins that Spark splits where a centre is popular; no group is gathered.
    """
    state = stored(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(
            both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        following = stored(
            small.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = following.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        discard(large)
        discard(state)
        state = following
        if now == mark:
            break
        mark = now
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
