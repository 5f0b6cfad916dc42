"""Python functions over columns, a few rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

STEP_ROWS = 64  # whose values are Python objects at the same time


def each(one: Callable[[Any], Any], kind: DataType | str, arrow: pa.DataType) -> Callable[[Column], Column]:
    """``one`` for every value of a column that is not null; ``kind`` and ``arrow`` name the type of the results.

    Batches of Arrow stay as they are and only ``STEP_ROWS`` values of them become objects at
    a time, so a task's memory does not grow with the rows of a batch and what is made of them.
    """

    @F.arrow_udf(kind)
    def column(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            for at in range(0, len(array), STEP_ROWS):
                values = array.slice(at, STEP_ROWS).to_pylist()
                yield pa.array([None if value is None else one(value) for value in values], arrow)

    return column
