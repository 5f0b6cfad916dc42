"""Vectors in Arrow batches: checks, matrices, and runs of rows that share a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components and with one that isn't 0."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def packed(vectors: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """Usable rows as (key, *more, dim, vec): the components as little-endian doubles."""
    kinds = {name: vectors.schema[name].dataType.simpleString() for name in (key, *more)}
    chosen = vectors.where(F.col(key).isNotNull() & usable(F.col(vector)))
    chosen = chosen.select(key, *more, F.col(vector).cast("array<double>").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vec")
            sizes = column.value_lengths()
            values = column.flatten().to_numpy(zero_copy_only=False).tobytes()
            ends = np.cumsum(sizes.to_numpy()).astype(np.int32) * 8
            offsets = np.concatenate([np.zeros(1, np.int32), ends])
            binary = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in (key, *more)), sizes, binary], names=[key, *more, "dim", "vec"]
            )

    schema = ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    return chosen.mapInArrow(run, f"{schema}, dim int, vec binary")


def matrix(column: pa.Array, dtype: str = "<f8") -> np.ndarray:
    """Rows of equally long binary values as a matrix."""
    if not len(column):
        return np.zeros((0, 0), dtype)
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows that follow one another with equal ``keys``, each run whole, whatever the batches."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        marks = np.zeros(max(0, table.num_rows - 1), bool)
        for key in keys:
            values = table.column(key).to_numpy()
            marks |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(marks) + 1).tolist()]
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield table.slice(start, end - start)
        rest = table.slice(cuts[-1]) if table.num_rows else None
    if rest is not None and rest.num_rows:
        yield rest


def batches_of(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
