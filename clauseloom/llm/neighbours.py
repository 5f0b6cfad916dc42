"""Approximate nearest neighbours by collision counting.

Every vector is projected on single random directions.  For each direction a block of
the data keeps its vectors sorted.  A query opens a window around its own projection in
every sorted array and widens all of them together (virtual rehashing).  Vectors that
lie in many of the windows are compared exactly; the search ends when the k-th best is
nearer than the radius that the windows stand for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import stored
from clauseloom.llm.vectors import matrix, packed, runs

DIGITS = 12  # of scores that are told apart
PART = 4096  # vectors whose collisions are counted together
FEW = 32  # queries that are multiplied with a block together
STEP = 512  # queries whose windows are held at the same time


@dataclass(frozen=True)
class Options:
    """``slack``: standard deviations below the expected collisions at which a vector is still compared;
    2.3 misses one in a hundred of the vectors at the radius itself and fewer of nearer ones."""

    k: int = 5
    directions: int = 96
    width: float = 2.4
    first: float = 0.2
    growth: float = 1.25
    slack: float = 2.3
    block: int = 32_768
    query_block: int = 32_768
    seed: int = 5


def threshold(options: Options) -> int:
    """Collisions that a vector at the radius reaches but for ``slack`` deviations."""
    near = math.erf(options.width / 2 / math.sqrt(2))
    m = options.directions
    return max(1, math.floor(m * near - options.slack * math.sqrt(m * near * (1 - near))))


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def ranked(scores: np.ndarray) -> np.ndarray:
    """What scores are ordered by: multiples of one vector differ in the last bits only and are ties."""
    return np.round(scores, DIGITS)


class Index:
    """Sorted projections of one block of vectors: for every vector its place in each sorted array.

    A vector lies in a window if its place falls between the places where the window begins and ends.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, options: Options):
        self.ids = ids
        self.unit = _units(vectors)
        self.options = options
        rng = np.random.default_rng([options.seed, vectors.shape[1]])
        self.directions = rng.standard_normal((vectors.shape[1], options.directions))
        projected = np.ascontiguousarray((self.unit @ self.directions).T)
        order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(projected, order, axis=1)
        self.kind = np.uint16 if len(ids) < 1 << 16 else np.uint32
        places = np.empty(order.shape, self.kind)
        np.put_along_axis(places, order, np.arange(len(ids), dtype=self.kind)[None], axis=1)
        # Cut so that one part and what is made of it stay in the processor's cache.
        self.places = [np.ascontiguousarray(places[:, at : at + PART]) for at in range(0, len(ids), PART)]
        self.least = threshold(options)

    def search(self, own: np.ndarray, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query: its number, and ids and cosines of the nearest found, nearest first."""
        radii, guess = self._radii(), 0
        reach = np.array([self.options.width * radius / 2 for radius in radii])
        for first in range(0, len(queries), STEP):
            units = _units(queries[first : first + STEP])
            at = units @ self.directions
            # Where the windows of some queries and all radii begin and end in every sorted array.
            begins = np.stack([line.searchsorted(at[:, j, None] - reach) for j, line in enumerate(self.sorted)], axis=1)
            ends = np.stack([line.searchsorted(at[:, j, None] + reach, "right") for j, line in enumerate(self.sorted)], axis=1)
            for q, unit in enumerate(units):
                if q % FEW == 0:
                    about = units[q : q + FEW] @ self.unit.T
                others = self.ids != own[first + q]
                guess, found, scores = self._nearest(unit, about[q % FEW], others, begins[q], ends[q], radii, guess)
                yield first + q, self.ids[found], scores

    def _nearest(
        self, unit: np.ndarray, about: np.ndarray, others: np.ndarray, begins: np.ndarray, ends: np.ndarray,
        radii: list[float], guess: int,
    ) -> tuple[int, np.ndarray, np.ndarray]:
        """The first radius whose vectors hold ``k`` within it, and their nearest: places and cosines.

        ``about``: cosines of all vectors but for rounding; those that decide are computed row by row.

        Windows only widen, so any radius at which the search may end tells which smaller ones can be the
        first: none below the k-th best distance.  Of those, only vectors within the radius matter.
        """
        for step in range(guess, len(radii)):
            met = np.flatnonzero((self._collisions(begins[:, step], ends[:, step]) >= self.least) & others)
            found, scores = self._best(unit, met, about)
            if self._ends(scores, radii[step]):
                break
        if step and len(scores) == self.options.k:
            near = met[about[met] >= 1 - radii[step - 1] ** 2 / 2 - 1e-9]
            cuts = near.searchsorted(np.arange(len(self.places) + 1) * PART)
            places = [part[:, near[cuts[i] : cuts[i + 1]] - i * PART] for i, part in enumerate(self.places)]
            places = np.concatenate(places, axis=1)
            for earlier in range(step):
                if not self._ends(scores, radii[earlier]):
                    continue
                begin, end = begins[:, earlier, None], ends[:, earlier, None]
                inside = near[((places >= begin) & (places < end)).sum(axis=0) >= self.least]
                closer, their = self._best(unit, inside, about)
                if self._ends(their, radii[earlier]):
                    return earlier, closer, their
        return step, found, scores

    def _ends(self, scores: np.ndarray, radius: float) -> bool:
        return len(scores) == self.options.k and math.sqrt(max(0.0, 2 - 2 * scores[-1])) <= radius

    def _collisions(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """In how many of the windows each vector lies."""
        begin, width = (x.astype(self.kind)[:, None] for x in (begins, ends - begins))
        counts = np.uint8 if len(begins) < 256 else np.uint16
        # Places before a window wrap round to numbers above its width.
        return np.concatenate([np.add.reduce((part - begin < width).view(np.uint8), axis=0, dtype=counts) for part in self.places])

    def _best(self, unit: np.ndarray, among: np.ndarray, about: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` nearest of some vectors."""
        k = self.options.k
        if len(among) > k:
            some = about[among]
            among = among[some >= np.partition(some, len(some) - k)[len(some) - k] - 1e-9]
        # Row by row in one order of sums: equal vectors score alike wherever they lie.
        scores = (self.unit[among] * unit).sum(axis=1)
        order = np.lexsort((self.ids[among], -ranked(scores)))[:k]
        return among[order], scores[order]

    def _radii(self) -> list[float]:
        """Radii of the rehashing up to 2, the greatest distance of unit vectors, and one that holds all."""
        steps = math.ceil(math.log(2 / self.options.first) / math.log(self.options.growth))
        return [*(self.options.first * self.options.growth**i for i in range(steps + 1)), 1e9]


def _search(batches: Iterator[pa.RecordBatch], options: Options) -> Iterator[pa.RecordBatch]:
    for table in runs(batches, ("dim", "data_block", "query_block")):
        query = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        data, asked = table.filter(pa.array(~query)), table.filter(pa.array(query))
        if not data.num_rows or not asked.num_rows:
            continue
        index = Index(data.column("key").to_numpy(), matrix(data.column("vec")), options)
        own = asked.column("key").to_numpy()
        rows: list[list] = [[], [], []]
        for q, ids, scores in index.search(own, matrix(asked.column("vec"))):
            rows[0] += [int(own[q])] * len(ids)
            rows[1] += ids.tolist()
            rows[2] += scores.tolist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows[0], pa.int64()),
                pa.array(rows[1], pa.int64()),
                pa.array(rows[2], pa.float64()),
                pa.array(ranked(np.array(rows[2], dtype=float))),
            ],
            names=["query_id", "vec_id", "score", "ordered"],
        )


def nearest(
    vectors: DataFrame, queries: Column, options: Options = Options(), key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest found of each row that fulfils ``queries``: query_id, rank, vec_id, score (cosine).

    Every usable row is a candidate for every query but for rows with the query's own key.
    The data are dealt in blocks of a bounded size, and so are the queries; a task indexes
    one block for one block of queries and hands on ``k`` rows for each.  Only vectors of
    equal length are compared.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null
    key, take no part.  Ties (scores equal to twelve digits) go to the smaller key; a key that comes more than once counts as
    often.  Other columns are ignored; without queries or candidates there are no rows.
    """
    rows = vectors.select(
        F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked")
    )
    fine = stored(packed(rows, "key", "vector", "asked"))
    n, asked = fine.agg(F.count("*"), F.count_if("asked")).first()
    blocks, query_blocks = max(1, -(-n // options.block)), max(1, -(-asked // options.query_block))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    mine = lambda count: F.pmod(F.xxhash64("key"), F.lit(count)).cast("int")
    data = fine.select("key", "dim", "vec", F.lit(False).alias("is_query"), mine(blocks).alias("data_block"), each(query_blocks).alias("query_block"))
    wanted = fine.where("asked").select(
        "key", "dim", "vec", F.lit(True).alias("is_query"), mine(query_blocks).alias("query_block"), each(blocks).alias("data_block")
    )
    met = data.unionByName(wanted).repartition("dim", "data_block", "query_block")
    found = met.sortWithinPartitions("dim", "data_block", "query_block").mapInArrow(
        lambda batches: _search(batches, options), "query_id long, vec_id long, score double, ordered double"
    )
    ranks = Window.partitionBy("query_id").orderBy(F.desc("ordered"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= options.k).select(
        "query_id", "rank", "vec_id", "score"
    )
