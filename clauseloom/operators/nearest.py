"""Nearest template per clause among the templates of the same cell.

A cell is a combination of equality keys, such as (state, attribute_number).
No plan ever emits clause-template pairs: similarities are computed block
by block with matrix products and only each clause's best template leaves a task.

Templates too many to travel to the tasks are dealt to pivots, some of the cell's templates
themselves.  The distance of a clause to its nearest pivot is one that its nearest template
does not exceed, and by the triangle inequality a pivot whose distance, less the radius of
its templates, is larger holds no nearer one: the clause is not sent there.  Squared
distances and cosines order templates as distances do, those of unit vectors for the cosine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.vectors import METRICS, similarities
from clauseloom.operators.sizing import broadcast_if_small
from clauseloom.session import stored

# Vector components that may be sent to every task, and block sizes of the shuffled plan.
BROADCAST_COMPONENTS = 4_000_000
TEMPLATE_BLOCK = 4096
CLAUSE_BLOCK = 16384
BLOCKS = 16  # of a cell, before its blocks grow beyond the size asked for
SCORES = 1_000_000  # that a task holds at once
SENT_ROWS = 8192  # copies of clauses that are handed on together
DIGITS = 12  # of compared scores
SLACK = 1e-5  # of distances: their last digits, as roots of differences of squares, are not sure
WIDTH, PIVOT = "_width", "_pivot"

_OUTPUT = "clause_id long, similarity double, template_id long"


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _best(clause_vectors: np.ndarray, template_vectors: np.ndarray, template_ids: np.ndarray, metric: str):
    """Best similarity and template per clause; ties go to the smaller id, and NaN to none."""
    order = np.argsort(template_ids, kind="stable")
    template_vectors, template_ids = template_vectors[order], template_ids[order]
    step = max(SCORES // max(len(template_ids), 1), 1)
    best, chosen = [np.empty(0)], [template_ids[:0]]
    for at in range(0, len(clause_vectors), step):
        scores = np.round(similarities(clause_vectors[at : at + step], template_vectors, metric), DIGITS)
        position = np.where(np.isnan(scores), -np.inf, scores).argmax(axis=1)
        best.append(scores[np.arange(len(scores)), position])
        chosen.append(template_ids[position])
    return np.concatenate(best), np.concatenate(chosen)


def _winners(clause_ids: np.ndarray, score: np.ndarray, template: np.ndarray) -> pd.DataFrame:
    known = ~np.isnan(score)
    return pd.DataFrame({"clause_id": clause_ids[known], "similarity": score[known], "template_id": template[known]})


def _one_per_clause(winners: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("similarity", "template_id"), F.struct(F.col("similarity"), -F.col("template_id")))
    return winners.groupBy("clause_id").agg(best.alias("best")).select("clause_id", "best.*")


def nearest_template(
    clauses: DataFrame,
    templates: DataFrame,
    cell: Sequence[str],
    metric: str = "l2sq",
    broadcast_limit: int = BROADCAST_COMPONENTS,
    template_block: int = TEMPLATE_BLOCK,
    clause_block: int = CLAUSE_BLOCK,
) -> DataFrame:
    """(clause_id, similarity, template_id) for every clause with a vector and a template in its cell.

    ``clauses`` has clause_id, the cell columns and ``embedding``; ``templates``
    has template_id, the cell columns and ``embedding``.  All plans compare doubles
    and give one row per clause_id, its best over all rows with that id.  Vectors of
    different lengths are not compared.  Blocks have the sizes asked for, but grow up to
    the default ones where a cell would have more than ``BLOCKS`` of them: a row is copied
    for the blocks of the other side, so with blocks of a fixed size copies grow with the square.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    clauses, templates = _compared(clauses, "clause_id", cell), _compared(templates, "template_id", cell)
    cell = [*cell, WIDTH]
    if (templates.agg(F.sum(WIDTH)).first()[0] or 0) <= broadcast_limit:
        return _with_broadcast_templates(clauses, templates, cell, metric)
    template_block = _grown(templates, cell, template_block, TEMPLATE_BLOCK)
    clause_block = _grown(clauses, cell, clause_block, CLAUSE_BLOCK)
    pivots = _pivots(templates, cell, metric, template_block)
    if pivots is not None:
        clauses, templates = _dealt(clauses, templates, cell, metric, pivots)
        cell = [*cell, PIVOT]
    return _with_blocks(clauses, templates, cell, metric, template_block, clause_block)


def _grown(rows: DataFrame, cell: Sequence[str], block: int, most: int) -> int:
    """The block size that gives the largest cell ``BLOCKS`` blocks, at least ``block``, at most ``most`` if that is larger."""
    largest = rows.groupBy(*cell).agg(F.count("*").alias("_rows")).agg(F.max("_rows")).first()[0] or 0
    return max(block, min(most, -(-largest // BLOCKS)))


def _compared(rows: DataFrame, row_id: str, cell: Sequence[str]) -> DataFrame:
    rows = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    return rows.select(row_id, *cell, F.size("embedding").alias(WIDTH), "embedding")


def pruning(
    clauses: DataFrame, templates: DataFrame, cell: Sequence[str], metric: str = "l2sq", template_block: int = TEMPLATE_BLOCK
) -> DataFrame:
    """Per cell: ``pairs`` of clauses and templates, and those ``compared`` that the pivots leave."""
    clauses, templates = _compared(clauses, "clause_id", cell), _compared(templates, "template_id", cell)
    keys = [*cell, WIDTH]
    pivots = _pivots(templates, keys, metric, template_block)
    if pivots is None:
        raise ValueError("too many pivots to travel to the tasks: nothing is pruned")
    sent, dealt = _dealt(clauses, templates, keys, metric, pivots)
    here = sent.groupBy(*keys, PIVOT).agg(F.count("*").alias("sent"))
    there = dealt.groupBy(*keys, PIVOT).agg(F.count("*").alias("held"))
    compared = here.join(there, [*keys, PIVOT]).groupBy(*keys).agg(F.sum(F.col("sent") * F.col("held")).alias("compared"))
    both = [rows.groupBy(*keys).agg(F.count("*").alias(name)) for rows, name in ((clauses, "_c"), (templates, "_t"))]
    pairs = both[0].join(both[1], keys).withColumn("pairs", F.col("_c") * F.col("_t"))
    return pairs.join(compared, keys).groupBy(*cell).agg(F.sum("pairs").alias("pairs"), F.sum("compared").alias("compared"))


def _located(vectors: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Points whose distances order the pairs as the metric does, and which of the vectors have one."""
    usable = np.isfinite(vectors).all(axis=1)
    if metric == "l2sq":
        return vectors, usable
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        length = np.sqrt((vectors * vectors).sum(axis=1))
        usable &= (length > 0) & np.isfinite(length)
        return vectors / length[:, None], usable


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * points @ centres.T
    return np.sqrt(np.maximum(squares, 0.0))


Pivots = dict[tuple, np.ndarray]


def _pivots(templates: DataFrame, cell: Sequence[str], metric: str, template_block: int) -> Pivots | None:
    """About one template for each block of a cell, chosen by hash; None where they are too many to send."""
    sizes = templates.groupBy(*cell).agg(F.ceil(F.count("*") / template_block).alias("_share"), F.count("*").alias("_rows"))
    total = sizes.agg(F.sum((F.col("_share") * 2 + 2) * F.col(WIDTH))).first()[0] or 0
    if total > BROADCAST_COMPONENTS:
        return None
    chance = F.pmod(F.xxhash64("template_id"), F.col("_rows")) < F.col("_share")
    some = templates.join(F.broadcast(sizes), list(cell)).where(chance).select(*cell, "embedding")
    frame = some.limit(max(total, 1)).toPandas()  # fewer pivots prune less, and repeated ids could make too many
    pivots: Pivots = {}
    for key, group in frame.groupby(list(cell), dropna=True):
        points, usable = _located(_stack(group["embedding"]), metric)
        points = np.unique(points[usable], axis=0)
        if len(points):
            pivots[key] = points
    return pivots


def _dealt(
    clauses: DataFrame, templates: DataFrame, cell: Sequence[str], metric: str, pivots: Pivots
) -> tuple[DataFrame, DataFrame]:
    """Templates with their pivot, and a copy of each clause for every pivot that may hold its nearest.

    Cells without a pivot keep all their templates together.
    """
    others = [*cell, PIVOT, "embedding"]

    def deal(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            for key, group in batch.groupby(list(cell), dropna=True):
                points, usable = _located(_stack(group["embedding"]), metric)
                group, points = group[usable], points[usable]
                if len(group) and key in pivots:
                    away = _distances(points, pivots[key])
                    nearest = away.argmin(axis=1)
                    yield group.assign(**{PIVOT: nearest, "_away": away[np.arange(len(group)), nearest]})
                elif len(group):
                    yield group.assign(**{PIVOT: 0, "_away": 0.0})

    kinds = lambda rows, row_id: ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in (row_id, *cell, "embedding"))
    dealt = stored(templates.mapInPandas(deal, f"{kinds(templates, 'template_id')}, {PIVOT} int, _away double"))
    # One row for each pivot.
    radii: dict[tuple, dict[int, float]] = {}
    for row in dealt.groupBy(*cell, PIVOT).agg(F.max("_away").alias("_radius")).collect():
        radii.setdefault(tuple(row[name] for name in cell), {})[row[PIVOT]] = row["_radius"]

    def send(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            for key, group in batch.groupby(list(cell), dropna=True):
                known = radii.get(key)
                points, usable = _located(_stack(group["embedding"]), metric)
                group, points = group[usable], points[usable]
                if known is None or not len(group):
                    continue
                if key not in pivots:
                    yield group.assign(**{PIVOT: 0})
                    continue
                away = _distances(points, pivots[key])
                # Every pivot is a template, so the nearest one is no farther than the nearest pivot.
                bound = away.min(axis=1, keepdims=True)
                radius = np.array([known.get(i, -np.inf) for i in range(len(pivots[key]))])
                slack = SLACK * (1 + np.abs(points).max(initial=0.0) + np.abs(pivots[key]).max(initial=0.0))
                line, pivot = np.nonzero(away - radius <= bound + slack)
                for at in range(0, len(line), SENT_ROWS):
                    yield group.iloc[line[at : at + SENT_ROWS]].assign(**{PIVOT: pivot[at : at + SENT_ROWS]})

    sent = clauses.mapInPandas(send, f"{kinds(clauses, 'clause_id')}, {PIVOT} int")
    return sent.select("clause_id", *others), dealt.select("template_id", *others)


def _with_broadcast_templates(clauses: DataFrame, templates: DataFrame, cell: Sequence[str], metric: str) -> DataFrame:
    cells: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    frame = templates.toPandas()
    for key, group in frame.groupby(list(cell), dropna=True):
        cells[key] = (_stack(group["embedding"]), group["template_id"].to_numpy())

    def emit(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            for key, group in batch.groupby(list(cell), dropna=True):
                known = cells.get(key)
                if known is None:
                    continue
                score, template = _best(_stack(group["embedding"]), known[0], known[1], metric)
                yield _winners(group["clause_id"].to_numpy(), score, template)

    return _one_per_clause(clauses.mapInPandas(emit, _OUTPUT))


def _with_blocks(
    clauses: DataFrame, templates: DataFrame, cell: Sequence[str], metric: str, template_block: int, clause_block: int
) -> DataFrame:
    """Split both sides of each cell into bounded blocks and pair up the blocks.

    A clause is copied once per template block of its cell and a template once
    per clause block, so a cell holding most of the rows becomes many tasks of
    bounded size.
    """
    keys = list(cell)
    sizes = (
        clauses.groupBy(*keys)
        .agg(F.ceil(F.count("*") / clause_block).cast("int").alias("_clause_blocks"))
        .join(
            templates.groupBy(*keys).agg(F.ceil(F.count("*") / template_block).cast("int").alias("_template_blocks")),
            keys,
        )
    )
    sizes = broadcast_if_small(sizes)

    def split(df: DataFrame, row_id: str, own: str, other: str) -> DataFrame:
        copies = F.sequence(F.lit(0), F.col(f"_{other}_blocks") - 1)
        return (
            df.join(sizes, keys)
            .withColumn(f"_{own}", F.pmod(F.xxhash64(row_id), F.col(f"_{own}_blocks")).cast("int"))
            .withColumn(f"_{other}", F.explode(copies))
            .drop("_clause_blocks", "_template_blocks")
        )

    left = split(clauses, "clause_id", "clause", "template")
    right = split(templates, "template_id", "template", "clause")
    # Fresh column identities, since both sides may stem from one table.
    right = right.toDF(*right.columns)

    def emit(clause_group: pd.DataFrame, template_group: pd.DataFrame) -> pd.DataFrame:
        if clause_group.empty or template_group.empty:
            return pd.DataFrame({"clause_id": [], "similarity": [], "template_id": []})
        score, template = _best(
            _stack(clause_group["embedding"]),
            _stack(template_group["embedding"]),
            template_group["template_id"].to_numpy(),
            metric,
        )
        return _winners(clause_group["clause_id"].to_numpy(), score, template)

    block_keys = [*keys, "_clause", "_template"]
    return _one_per_clause(left.groupBy(*block_keys).cogroup(right.groupBy(*block_keys)).applyInPandas(emit, _OUTPUT))
