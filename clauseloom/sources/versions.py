"""Collections in one table with atomic replacement: files first, then one new manifest.

``path/data/<id>`` holds the rows of one write, ``path/keys/<id>`` a Bloom filter of its row
ids, ``path/versions/<n>.json`` the parts that make up version n.  A manifest is created
only if its number is free, after everything it names is written: readers see the old
version or the new one, a failed write leaves nothing that is read, and of two writers
that began from the same version one fails.

A part is one collection of one write, with its number of rows and its least and greatest
id.  An append looks up its own ids in those ranges, then in the filters of the parts that
are left - a join with narrow rows of bits - and reads only the ids of parts in which
some id may lie.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEY = "collection_key"
IDS_PER_WORD = 8  # ids for each row of 64 bits; with four bits an id about 3 % of strange ids pass
BITS_PER_ID = 4


class ConcurrentWrite(RuntimeError):
    """Another writer has made the version that this one was about to make."""


@dataclass(frozen=True)
class Part:
    """One collection of one write; ``words`` is the number of rows of its filter."""

    collection: str
    folder: str
    rows: int
    low: str
    high: str
    words: int


@dataclass(frozen=True)
class Version:
    number: int = 0
    row_id: str = "row_id"
    schema: str | None = None
    parts: tuple[Part, ...] = ()


# --- manifests ------------------------------------------------------------------


def hadoop_path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, or return False if it exists already or another writer claims it.

    A driver lost between the claim and the file leaves ``<path>.claim``, which stops later
    writers until ``release`` removes it; readers never look at it.
    """
    files, target = hadoop_path(spark, path)
    if files.exists(target):
        return False
    _, draft = hadoop_path(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        # An empty file of that name is the claim: creating it fails for all but one writer.
        files.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.claim"), False).close()
    except Exception:
        files.delete(draft, False)
        return False
    return files.rename(draft, target)


def release(spark: SparkSession, path: str) -> None:
    """Remove the claim of a writer that is known to be lost; manifests stay as they are."""
    number = current(spark, path).number + 1
    files, claim = hadoop_path(spark, f"{path}/versions/{number:08d}.json.claim")
    files.delete(claim, False)


def read_small(spark: SparkSession, path: str) -> str | None:
    files, target = hadoop_path(spark, path)
    if not files.exists(target):
        return None
    source = files.open(target)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def current(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The newest version of the table, or the one asked for; version 0 holds nothing."""
    if number is None:
        files, folder = hadoop_path(spark, f"{path}/versions")
        names = [status.getPath().getName() for status in files.listStatus(folder)] if files.exists(folder) else []
        number = max((int(name[:-5]) for name in names if name.endswith(".json")), default=0)
    if number == 0:
        return Version()
    text = read_small(spark, f"{path}/versions/{number:08d}.json")
    if text is None:
        raise ValueError(f"no version {number} under {path}")
    found = json.loads(text)
    return Version(found["number"], found["row_id"], found["schema"], tuple(Part(**part) for part in found["parts"]))


def _commit(spark: SparkSession, path: str, version: Version) -> Version:
    if not write_new(spark, f"{path}/versions/{version.number:08d}.json", json.dumps(asdict(version))):
        raise ConcurrentWrite(f"version {version.number} of {path} has been written by another writer")
    return version


# --- Bloom filters as rows --------------------------------------------------------


def _word(row_id: Column, words: Column) -> Column:
    return F.pmod(F.xxhash64(row_id), words)


def _bits(row_id: Column) -> Column:
    """Four of 64 bits, from a hash of its own."""
    hashed = F.xxhash64(row_id, F.lit(1))
    places = [F.shiftrightunsigned(hashed, 6 * at).bitwiseAND(F.lit(63)).cast("int") for at in range(BITS_PER_ID)]
    return reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places])


# --- reading and writing ----------------------------------------------------------


def _read(spark: SparkSession, path: str, version: Version, parts: tuple[Part, ...]) -> DataFrame:
    schema = StructType.fromJson(json.loads(version.schema))
    frames = []
    for folder in sorted({part.folder for part in parts}):
        live = [part.collection for part in parts if part.folder == folder]
        # The named collections are folders, so no file of a replaced one is opened.
        frames.append(spark.read.schema(schema).parquet(f"{path}/data/{folder}").where(F.col(KEY).isin(live)))
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def read_collections(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """Rows of all collections in the newest version, or in an older one."""
    version = current(spark, path, number)
    if version.schema is None:
        raise ValueError(f"nothing has been written to {path}")
    return _read(spark, path, version, version.parts)


def _write(rows: DataFrame, path: str, row_id: str) -> tuple[StructType, tuple[Part, ...]]:
    """Write rows and the filters of their ids; both are in place, and unread, when this returns."""
    spark, folder = rows.sparkSession, uuid.uuid4().hex
    rows.write.partitionBy(KEY).parquet(f"{path}/data/{folder}")
    schema = StructType([*[field for field in rows.schema if field.name != KEY], rows.schema[KEY]])
    written = spark.read.schema(schema).parquet(f"{path}/data/{folder}")
    text = F.col(row_id).cast("string")
    # One row per collection of this write.
    counted = written.groupBy(KEY).agg(F.count("*").alias("rows"), F.min(text).alias("low"), F.max(text).alias("high")).collect()
    parts = tuple(Part(r[KEY], folder, r.rows, r.low, r.high, r.rows // IDS_PER_WORD + 1) for r in counted)
    sizes = spark.createDataFrame([(p.collection, p.words) for p in parts], f"{KEY} string, words long")
    filters = (
        written.select(KEY, text.alias("id"))
        .join(F.broadcast(sizes), KEY)
        .groupBy(KEY, _word(F.col("id"), F.col("words")).alias("word"))
        .agg(F.bit_or(_bits(F.col("id"))).alias("bits"))
    )
    filters.write.parquet(f"{path}/keys/{folder}")
    return schema, parts


def replace_collections(rows: DataFrame, path: str, row_id: str = "row_id") -> Version:
    """A version in which the collections present in ``rows`` hold just these rows; others stay.

    Rows need a collection and an id; rows without either are refused by an error.
    """
    spark = rows.sparkSession
    before = current(spark, path)
    named = _named(rows, row_id)
    schema, parts = _write(named, path, row_id)
    new = {part.collection for part in parts}
    kept = tuple(part for part in before.parts if part.collection not in new)
    return _commit(spark, path, Version(before.number + 1, row_id, schema.json(), kept + parts))


def _named(rows: DataFrame, row_id: str) -> DataFrame:
    """Rows with a collection and an id; a row without one stops the write."""
    missing = F.col(KEY).isNull() | F.col(row_id).isNull()
    stop = F.raise_error(F.lit(f"every row needs {KEY} and {row_id}")).cast("string")
    return rows.withColumn(KEY, F.when(missing, stop).otherwise(F.col(KEY).cast("string")))


def append_rows(rows: DataFrame, path: str, row_id: str = "row_id") -> Version:
    """A version with those of ``rows`` whose id the table does not hold yet, one row of each id.

    Of repeated ids any one row is kept.  Nothing is committed if no row is new.  ``row_id``
    names the id of a new table; an older one keeps its own.
    """
    spark = rows.sparkSession
    before = current(spark, path)
    row_id = before.row_id if before.number else row_id
    fresh = _named(rows, row_id).dropDuplicates([row_id])
    suspects = _parts_that_may_hold(fresh, path, before)
    if suspects:
        held = _read(spark, path, before, suspects).select(row_id)
        fresh = fresh.join(held, row_id, "left_anti")
    schema, parts = _write(fresh, path, row_id)
    if not parts:
        return before
    return _commit(spark, path, Version(before.number + 1, row_id, before.schema or schema.json(), before.parts + parts))


def _parts_that_may_hold(rows: DataFrame, path: str, version: Version) -> tuple[Part, ...]:
    """Parts in whose id range and Bloom filter some row of ``rows`` falls."""
    spark = rows.sparkSession
    if not version.parts:
        return ()
    ids = rows.select(F.col(version.row_id).cast("string").alias("id"))
    fields = "place int, folder string, collection string, low string, high string, words long"
    listed = [(at, p.folder, p.collection, p.low, p.high, p.words) for at, p in enumerate(version.parts)]
    table = F.broadcast(spark.createDataFrame(listed, fields))  # one row per part of a manifest
    within = ids.join(table, F.col("id").between(F.col("low"), F.col("high")))
    asked = within.select("place", "folder", "collection", _word(F.col("id"), F.col("words")).alias("word"), _bits(F.col("id")).alias("mask"))
    folders = sorted({part.folder for part in version.parts})
    filters = reduce(
        DataFrame.unionByName,
        [spark.read.parquet(f"{path}/keys/{folder}").select(F.lit(folder).alias("folder"), F.col(KEY).alias("collection"), "word", "bits") for folder in folders],
    )
    hits = asked.join(filters, ["folder", "collection", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return tuple(version.parts[row.place] for row in hits.select("place").distinct().collect())
