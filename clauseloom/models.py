"""Model-dependent steps: what the engine expects, and deterministic stand-ins.

An embedder turns a batch of texts into vectors (``None`` where it fails).  It is
created once per task through a factory, so heavy models load lazily on the
executors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


class Embedder(Protocol):
    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[float] | None]: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """Stand-in: signed word hashing, which puts texts sharing words close together."""

    dimensions: int = 64

    def __call__(self, texts: Sequence[str]) -> list[list[float] | None]:
        vectors: list[list[float] | None] = []
        for text in texts:
            vector = np.zeros(self.dimensions)
            for word in re.findall(r"\w+", (text or "").lower()):
                digest = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                vector[(digest >> 1) % self.dimensions] += 1.0 if digest & 1 else -1.0
            vectors.append(vector.tolist())
        return vectors


def _unit(vector: Sequence[float] | None) -> np.ndarray | None:
    if vector is None or len(vector) == 0:
        return None
    array = np.asarray(vector, dtype=np.float64)
    length = np.linalg.norm(array)
    return (array / length).astype(np.float32) if np.isfinite(length) and length > 0 else None


def embed(
    rows: DataFrame,
    text: str = "content",
    output: str = "embedding",
    factory: Callable[[], Embedder] = HashingEmbedder,
    batch_size: int = 64,
) -> DataFrame:
    """Add unit vectors; a text that is empty or fails to embed gets NULL and the row is kept."""

    @F.pandas_udf(ArrayType(FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            result = pd.Series([None] * len(batch), dtype=object)
            filled = [position for position, value in enumerate(batch) if value]
            for start in range(0, len(filled), batch_size):
                positions = filled[start : start + batch_size]
                for position, vector in zip(positions, _embed_batch(model, [batch.iloc[p] for p in positions])):
                    result.iat[position] = vector
            yield result

    return rows.withColumn(output, vectors(F.col(text)))


def _embed_batch(model: Embedder, texts: list[str]) -> Iterable[np.ndarray | None]:
    try:
        return [_unit(vector) for vector in model(texts)]
    except Exception:
        # One bad text must not lose its whole batch.
        return [_embed_one(model, text) for text in texts]


def _embed_one(model: Embedder, text: str) -> np.ndarray | None:
    try:
        return _unit(model([text])[0])
    except Exception:
        return None
