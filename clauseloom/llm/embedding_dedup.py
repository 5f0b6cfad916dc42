"""Near duplicates among embeddings by Euclidean p-stable hashing.

Normalised vectors are projected on random directions, shifted, and cut into cells of a
fixed width; several such numbers make a key, and several keys put a vector into as many
tables.  Vectors that share a cell are compared by their exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import components, stored
from clauseloom.llm.vectors import matrix, packed, runs, usable


@dataclass(frozen=True)
class Options:
    """With the defaults a pair at cosine 0.98 misses all tables with a chance of 1e-6.

    ``block``: rows of a bucket that are compared at a time; larger buckets are compared
    block by block, none is cut off.
    """

    threshold: float = 0.98
    tables: int = 48
    hashes: int = 8
    width: float = 1.0
    block: int = 1024
    seed: int = 11


def cell_keys(unit: np.ndarray, salt: np.ndarray, options: Options) -> np.ndarray:
    """Keys (rows, tables) of normalised vectors; ``salt`` keeps apart what must not meet."""
    rng = np.random.default_rng([options.seed, unit.shape[1]])
    count = options.tables * options.hashes
    directions = rng.standard_normal((unit.shape[1], count))
    shift = rng.uniform(0, options.width, count)
    odd = rng.integers(0, 1 << 62, count, np.uint64) * np.uint64(2) + np.uint64(1)
    cells = np.floor((unit @ directions + shift) / options.width).astype(np.int64).astype(np.uint64)
    mixed = (cells * odd).reshape(len(unit), options.tables, options.hashes).sum(axis=2, dtype=np.uint64)
    mixed += (np.arange(options.tables, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed += salt[:, None].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def _hashed(batches: Iterator[pa.RecordBatch], options: Options) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        labels = batch.column("label").cast(pa.int64()).to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            part = batch.take(pa.array(at))
            vectors = matrix(part.column("vec"))
            # Large and tiny components would lose their squares.
            scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
            unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
            keys = cell_keys(unit, labels[at] * 4099 + dim, options)
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), part.column("n"), pa.array([u.tobytes() for u in unit], pa.binary()),
                 pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))],
                names=["node", "n", "unit", "keys", "cells"],
            )


def _lowest(linked: np.ndarray) -> np.ndarray:
    """Smallest row number reachable from each row by the symmetric matrix ``linked``."""
    lowest = np.arange(len(linked))
    while True:
        following = np.minimum(lowest, np.where(linked, lowest[None, :], len(linked)).min(axis=1))
        if (following == lowest).all():
            return lowest
        lowest = following


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Per block: what each node's links add (a, a, count), and a tree over each of its components (a, b, 0)."""
    out: list[list[int]] = [[], [], []]

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "more"])
        for x in out:
            x.clear()
        return batch

    for table in runs(batches, ("cell", "i", "j")):
        if table.num_rows < 2:
            continue
        unit, keys = matrix(table.column("unit")), matrix(table.column("keys"), "<i8")
        node, n, side = (table.column(name).to_numpy() for name in ("node", "n", "side"))
        which = table.column("number")[0].as_py()
        linked = unit @ unit.T >= threshold
        if table.column("i")[0] != table.column("j")[0]:
            linked &= side[:, None] != side[None, :]
        linked &= node[:, None] != node[None, :]
        # A pair counts in the first table where it meets.
        a, b = np.nonzero(np.triu(linked, 1))
        if not len(a):
            continue
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            first = (keys[x] == keys[y]).argmax(axis=1) == which
            later = ~first
            linked[x[later], y[later]] = linked[y[later], x[later]] = False
        more = linked @ n
        lowest = _lowest(linked)
        touched = np.flatnonzero(more)
        joined = np.flatnonzero(lowest != np.arange(len(lowest)))
        out[0] += node[touched].tolist() + node[joined].tolist()
        out[1] += node[touched].tolist() + node[lowest[joined]].tolist()
        out[2] += more[touched].tolist() + [0] * len(joined)
        if len(out[0]) > 20_000:
            yield flush()
    yield flush()


def near_duplicates(
    vectors: DataFrame, options: Options = Options(), key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """Links between vectors of one label at cosine ``threshold`` or more: key, n_links, component_id, kept.

    One row per input row.  Equal vectors of a label are one node with a count, so large
    groups of copies cost one comparison; of near copies, links are counted where they are
    found and only a tree per block leaves the task, never the pairs.  Every link counts
    once, in the first table where its vectors meet.

    Vectors that are null, zero or hold null or non-finite components, and those with a
    null label or key, link with nothing and are kept (a null key has no component).
    Vectors of different lengths don't link.  Repeated rows are vectors that link; rows
    that share a key but not the vector share their links.  Other columns are ignored; an
    empty table gives no rows.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    fine = packed(rows.where("label is not null"), "key", "embedding", "label")
    copies = fine.groupBy("label", "dim", "vec").agg(F.min("key").alias("node"), F.count("*").alias("n"))
    copies = stored(copies.withColumn("node", F.col("node").cast("long")))
    hashed = stored(
        copies.mapInArrow(
            lambda batches: _hashed(batches, options), "node long, n long, unit binary, keys binary, cells array<long>"
        )
    )
    cells = hashed.select("node", F.posexplode("cells").alias("number", "cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(cells.join(sizes, "cell"))
    blocks = F.ceil(F.col("size") / options.block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = (
        shared.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "node", "number", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") <= F.col("other")).cast("int").alias("side"),
        )
    )
    spread = (
        placed.join(hashed.select("node", "n", "unit", "keys"), "node")
        .repartition("cell", "i", "j")
        .sortWithinPartitions("cell", "i", "j")
    )
    found = stored(spread.mapInArrow(lambda batches: _compare(batches, options.threshold), "a long, b long, more long"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("more").alias("more"))
    joined = components(found.where("a <> b").select("a", "b"))
    nodes = (
        copies.join(links, "node", "left")
        .join(joined, "node", "left")
        .select(
            "label", "dim", "vec",
            (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    linked = fine.join(nodes, ["label", "dim", "vec"]).select("key", "n_links", "component_id")
    aside = F.col("key").isNull() | F.col("label").isNull() | ~usable(F.col("embedding"))
    rest = rows.where(aside).select(
        "key", F.lit(0).cast("long").alias("n_links"), F.col("key").cast("long").alias("component_id")
    )
    return linked.unionByName(rest).select(
        F.col("key").alias(key), "n_links", "component_id",
        F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"),
    )

