"""Score a small dictionary of attributes against every chunk in map-only passes.

The attributes (their vectors and BM25 term weights) travel to the tasks; the chunks are
never shuffled.  One pass over the texts leaves what BM25 needs of them: the length and the
counts of the dictionary's terms.  Later passes read those narrow rows, score them batch by
batch with matrix arithmetic, and hand on either all pairs, or only their best rows per
attribute (and source), or counts of chunks that beat given candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from clauseloom.functions.text import tokens
from clauseloom.functions.vectors import METRICS, similarities
from clauseloom.operators.lexical import B, EPSILON, K1, SCALE, CorpusStats, query_terms
from clauseloom.operators.sizing import fits
from clauseloom.session import stored

# Attributes scored together. Bounds what is collected and sent to the tasks;
# larger dictionaries are scored block by block.
BLOCK_ROWS = 512
BATCH_ROWS = 2048
DIGITS = 12  # of ranked scores: equal texts rank as equal whatever the order of a sum
VOCABULARY_ROWS = 1_000_000  # (attribute, term) rows whose terms are counted in one pass
STATE_VALUES = 4_000_000  # scores that a task holds back before it hands them on
COUNTED = ("length", "term_index", "term_count")


def counted_terms(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """``chunks`` with ``length``, ``term_index`` and ``term_count`` in place of ``content``.

    Texts are tokenized in the JVM, the one tokenizer of all lexical scores; the tokens of a
    batch are looked up together.  Only terms of the dictionary leave a row.
    """
    others = [name for name in ("doc_idx", "source_file", "embedding") if name in chunks.columns]
    kinds = {name: chunks.schema[name].dataType.simpleString() for name in others}
    schema = "".join(f"{name} {kind}, " for name, kind in kinds.items())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for batch in batches:
            lists = batch.column("terms")
            length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            place = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            hit = place >= 0
            row = np.repeat(np.arange(len(length)), length)[hit]
            keys, counts = np.unique(row * max(len(terms), 1) + place[hit], return_counts=True)
            row, term = np.divmod(keys, max(len(terms), 1))
            starts = pa.array(np.searchsorted(row, np.arange(len(length) + 1)), pa.int32())
            columns = [
                *(batch.column(name) for name in others),
                pa.array(length),
                pa.ListArray.from_arrays(starts, pa.array(term, pa.int32())),
                pa.ListArray.from_arrays(starts, pa.array(counts, pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, *COUNTED])

    split = chunks.select(*others, tokens(F.col("content")).alias("terms"))
    return split.mapInArrow(count, f"{schema}length long, term_index array<int>, term_count array<int>")


def counted_stats(counted: DataFrame, terms: list[str]) -> CorpusStats:
    """Number of chunks, mean length, and the chunks that hold each term; the totals take one row a task."""
    documents, average = counted.agg(F.count("*"), F.avg("length")).first()
    rows = counted.select(F.explode("term_index").alias("term")).groupBy("term").count().collect()
    return CorpusStats(documents, average or 0.0, {terms[row["term"]]: row["count"] for row in rows})


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Length of every list (-1: null) and the values of all, a null one as NaN."""
    length = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    return length, column.flatten().to_numpy(zero_copy_only=False)


@dataclass(frozen=True)
class Scorer:
    """One block of attributes, ready to score batches of counted chunks.

    ``vectors`` holds, for each length of vectors, the attributes that have one and the matrix.
    """

    numbers: np.ndarray
    vectors: Mapping[int, tuple[np.ndarray, np.ndarray]]
    terms: tuple[str, ...]
    term_start: np.ndarray
    term_attribute: np.ndarray
    term_weight: np.ndarray
    average_length: float
    metric: str
    k1: float
    b: float

    def only(self, numbers: Iterable[int]) -> Scorer:
        """The scorer of some of its attributes."""
        kept = np.isin(self.numbers, list(numbers))
        place = np.cumsum(kept) - 1
        vectors = {
            width: (place[columns[kept[columns]]], matrix[kept[columns]]) for width, (columns, matrix) in self.vectors.items()
        }
        entry = kept[self.term_attribute]
        before = np.concatenate([[0], np.cumsum(entry)])
        return replace(
            self, numbers=self.numbers[kept], vectors=vectors, term_start=before[self.term_start],
            term_attribute=place[self.term_attribute[entry]], term_weight=self.term_weight[entry],
        )

    def dense(self, embeddings: pa.Array) -> np.ndarray:
        """Similarities, chunks x attributes; NaN where a side has no vector or one of another length."""
        scores = np.full((len(embeddings), len(self.numbers)), np.nan)
        length, values = _lists(embeddings)
        size = np.maximum(length, 0)
        start = np.cumsum(size) - size
        for width, (columns, matrix) in self.vectors.items():
            rows = np.flatnonzero(length == width)
            if width and len(rows) and len(columns):
                own = values[start[rows, None] + np.arange(width)].astype(np.float64)
                scores[np.ix_(rows, columns)] = np.round(similarities(own, matrix, self.metric), DIGITS)
        return scores

    def lexical(self, batch: pa.RecordBatch) -> np.ndarray:
        """BM25 scores, chunks x attributes; 0.0 where no term is shared."""
        return self._shares(batch)[0]

    def sharing(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunk, attribute column and BM25 score of the pairs that share a term."""
        scores, cells = self._shares(batch)
        row, column = np.divmod(np.unique(cells), max(len(self.numbers), 1))
        return row, column, scores[row, column]

    def _shares(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """All scores, and the cells (row by row) of the shares that they are made of."""
        shape = (batch.num_rows, len(self.numbers))
        found, term = _lists(batch.column("term_index"))
        frequency = _lists(batch.column("term_count"))[1].astype(np.int64)
        term = term.astype(np.int64)
        row = np.repeat(np.arange(shape[0]), np.maximum(found, 0))
        length = batch.column("length").to_numpy(zero_copy_only=False)[row]
        pivot = (1 - self.b) + self.b * (length / (self.average_length + EPSILON))
        saturated = frequency * (self.k1 + 1) / (frequency + self.k1 * pivot + EPSILON)
        # Expand every (chunk, term) to the attributes that use the term.
        fan_out = self.term_start[term + 1] - self.term_start[term]
        offset = np.arange(fan_out.sum()) - np.repeat(np.cumsum(fan_out) - fan_out, fan_out)
        entry = np.repeat(self.term_start[term], fan_out) + offset
        cell = np.repeat(row, fan_out) * shape[1] + self.term_attribute[entry]
        # Whole numbers add up alike in any order, so equal texts get equal scores.
        value = np.rint(np.repeat(saturated, fan_out) * self.term_weight[entry] * SCALE)
        totals = np.bincount(cell, weights=value, minlength=shape[0] * shape[1])
        return totals.reshape(shape) / SCALE + 0.0, cell

    def batches(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Batches with both score tables; a column that was not read gives NaN or 0.0."""
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                shape = (part.num_rows, len(self.numbers))
                dense = self.dense(part.column("embedding")) if "embedding" in part.schema.names else np.full(shape, np.nan)
                lexical = self.lexical(part) if "term_index" in part.schema.names else np.zeros(shape)
                yield part, dense, lexical


@dataclass(frozen=True)
class ScoredBlock:
    """A scorer, the corpus counts behind it, and the rows that it scores."""

    scorer: Scorer
    stats: CorpusStats
    rows: DataFrame


@dataclass(frozen=True)
class _Lexicon:
    """The terms of a dictionary: (attribute, term, frequency) rows, corpus counts, counted chunks."""

    queries: list[Row]
    terms: tuple[str, ...]
    stats: CorpusStats
    rows: DataFrame


def _lexicon(queries: DataFrame, chunks: DataFrame, keep: bool) -> _Lexicon:
    rows = queries.collect()
    terms = sorted({row.term for row in rows})
    counted = counted_terms(chunks, terms)
    counted = stored(counted) if keep else counted
    return _Lexicon(rows, tuple(terms), counted_stats(counted, terms), counted)


def scored_blocks(
    attributes: DataFrame, chunks: DataFrame, metric: str = "l2sq", k1: float = K1, b: float = B,
    block_rows: int = BLOCK_ROWS, lexical: bool = True,
) -> Iterator[ScoredBlock]:
    """Scorers that together cover the whole dictionary, about ``block_rows`` attributes each.

    The texts are read once for all blocks, or, where the dictionary's terms pass
    ``VOCABULARY_ROWS``, once for each.  ``lexical=False`` doesn't read them.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    columns = attributes.select("attribute_number", "content", "embedding")
    queries = query_terms(columns)
    whole = _Lexicon([], (), CorpusStats(0, 0.0, {}), chunks)
    if lexical:
        whole = _lexicon(queries, chunks, keep=True) if fits(queries, VOCABULARY_ROWS) else None
    head = columns.select("attribute_number", "embedding").take(block_rows + 1)
    if len(head) <= block_rows:
        yield _scored_block(head, whole or _lexicon(queries, chunks, keep=True), metric, k1, b)
        return
    blocks = math.ceil(columns.count() / block_rows)
    for index in range(blocks):
        block = columns.where(F.pmod(F.xxhash64("attribute_number"), F.lit(blocks)) == index)
        rows = block.select("attribute_number", "embedding").collect()
        if rows:
            yield _scored_block(rows, whole or _lexicon(query_terms(block), chunks, keep=True), metric, k1, b)


def _scored_block(rows: list[Row], lexicon: _Lexicon, metric: str, k1: float, b: float) -> ScoredBlock:
    attributes = sorted(rows, key=lambda row: row.attribute_number)
    column = {row.attribute_number: position for position, row in enumerate(attributes)}
    by_width: dict[int, list[int]] = {}
    for position, row in enumerate(attributes):
        if row.embedding is not None:
            by_width.setdefault(len(row.embedding), []).append(position)
    vectors = {
        width: (np.array(own), np.array([attributes[i].embedding for i in own], dtype=np.float64)) for width, own in by_width.items()
    }
    stats = lexicon.stats
    used: dict[str, list[tuple[int, float]]] = {}
    for row in lexicon.queries:
        frequency = stats.document_frequency.get(row.term)
        if frequency and row.attribute_number in column:
            weight = math.log((stats.documents - frequency + 0.5) / (frequency + 0.5) + EPSILON)
            used.setdefault(row.term, []).append((column[row.attribute_number], row.query_frequency * weight))
    entries = [entry for term in lexicon.terms for entry in used.get(term, ())]
    scorer = Scorer(
        numbers=np.array([row.attribute_number for row in attributes], dtype=np.int64),
        vectors=vectors,
        terms=lexicon.terms,
        term_start=np.cumsum([0] + [len(used.get(term, ())) for term in lexicon.terms]),
        term_attribute=np.array([entry[0] for entry in entries], dtype=np.int64),
        term_weight=np.array([entry[1] for entry in entries], dtype=np.float64),
        average_length=stats.average_length,
        metric=metric,
        k1=k1,
        b=b,
    )
    return ScoredBlock(scorer, stats, lexicon.rows)


def _inputs(rows: DataFrame, scorer: Scorer, *names: str, lexical: bool = True) -> DataFrame:
    """The columns that a pass reads; texts that are not counted yet are counted on the way."""
    if lexical and "term_index" not in rows.columns:
        rows = counted_terms(rows, list(scorer.terms))
    return rows.select(*names, *(COUNTED if lexical else ()))


def _nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), from_pandas=True)


PAIR_SCHEMA = "attribute_number long, doc_idx long, source_file string, dense_similarity double, bm25_score double"


def pairs(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """Every (attribute, chunk) pair with both scores, as narrow rows."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(scorer.numbers)
        for part, dense, lexical in scorer.batches(batches):
            each = pa.array(np.repeat(np.arange(part.num_rows), width))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(scorer.numbers, part.num_rows)),
                    part.column("doc_idx").take(each).cast(pa.int64()),
                    part.column("source_file").take(each),
                    _nullable(dense.ravel()),
                    pa.array(lexical.ravel()),
                ],
                names=["attribute_number", "doc_idx", "source_file", "dense_similarity", "bm25_score"],
            )

    return _inputs(rows, scorer, "doc_idx", "source_file", "embedding").mapInArrow(emit, PAIR_SCHEMA)


def sharing_pairs(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """BM25 scores of the (attribute, chunk) pairs that share a term."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                row, column, score = scorer.sharing(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(scorer.numbers[column]), part.column("doc_idx").take(pa.array(row)).cast(pa.int64()), pa.array(score)],
                    names=["attribute_number", "doc_idx", "bm25_score"],
                )

    schema = "attribute_number long, doc_idx long, bm25_score double"
    return _inputs(rows, scorer, "doc_idx").mapInArrow(emit, schema)


BEST_SCHEMA = "ranking string, attribute_number long, doc_idx long, dense_similarity double, bm25_score double"


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best rows: score descending, then id."""
    if len(score) > k:
        bar = np.partition(score, len(score) - k)[len(score) - k]
        chosen = np.flatnonzero(score >= bar)
    else:
        chosen = np.arange(len(score))
    return chosen[np.lexsort((ids[chosen], -score[chosen]))][:k]


def task_best(rows: DataFrame, scorer: Scorer, k: int, rankings: tuple[str, ...] = ("dense", "bm25")) -> DataFrame:
    """Each task's ``k`` best chunks per attribute and ranking."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, int], tuple[np.ndarray, ...]] = {}
        for part, dense, lexical in scorer.batches(batches):
            ids = part.column("doc_idx").to_numpy(zero_copy_only=False)
            for ranking in rankings:
                table = dense if ranking == "dense" else lexical
                for column in range(len(scorer.numbers)):
                    usable = np.flatnonzero(~np.isnan(table[:, column]))
                    found = (table[usable, column], ids[usable], dense[usable, column], lexical[usable, column])
                    known = kept.get((ranking, column))
                    if known is not None:
                        found = tuple(np.concatenate(arrays) for arrays in zip(known, found, strict=True))
                    best = _best(found[0], found[1], k)
                    kept[ranking, column] = tuple(array[best] for array in found)
        for (ranking, column), (_, ids, similarity, bm25) in kept.items():
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ranking] * len(ids)),
                        pa.array(np.full(len(ids), scorer.numbers[column])),
                        pa.array(ids, pa.int64()),
                        _nullable(similarity),
                        pa.array(bm25),
                    ],
                    names=["ranking", "attribute_number", "doc_idx", "dense_similarity", "bm25_score"],
                )

    dense = ["embedding"] if "dense" in rankings else []
    return _inputs(rows, scorer, "doc_idx", *dense, lexical="bm25" in rankings).mapInArrow(emit, BEST_SCHEMA)


class _Heads:
    """The best rows of every (source, attribute) of one ranking seen by a task.

    Per source a table of at most ``depth`` rows and one column per attribute, best first.
    """

    def __init__(self, depth: int, width: int):
        self.depth, self.width = depth, width
        self.tables: dict[str | None, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.values = 0

    def add(self, source: str | None, score: np.ndarray, ids: np.ndarray, other: np.ndarray) -> None:
        known = self.tables.get(source)
        if known is not None and len(known[0]) == self.depth:
            # Rows that no column has room for change nothing.
            last, last_id = known[0][-1], known[1][-1]
            fits_in = ((score > last) | ((score == last) & (ids[:, None] < last_id))).any(axis=1)
            score, ids, other = score[fits_in], ids[fits_in], other[fits_in]
            if not len(ids):
                return
        parts = (score, np.repeat(ids[:, None], self.width, axis=1), other)
        if known is not None:
            parts = tuple(np.concatenate(pair) for pair in zip(known, parts, strict=True))
        order = np.lexsort((parts[1], -parts[0]), axis=0)[: self.depth]
        new = tuple(np.take_along_axis(part, order, axis=0) for part in parts)
        self.values += new[0].size - (0 if known is None else known[0].size)
        self.tables[source] = new


HEAD_SCHEMA = (
    "ranking string, attribute_number long, source_file string, doc_idx long, dense_similarity double, bm25_score double"
)


def source_best(
    rows: DataFrame, scorer: Scorer, depth: int, cells: Mapping[str | None, np.ndarray] | None = None
) -> DataFrame:
    """Each task's ``depth`` best chunks per attribute, source and ranking.

    ``cells`` names, for each source wanted, the columns of the scorer wanted of it.  A task
    holds about ``STATE_VALUES`` scores; with more sources it hands heads on as it goes, and the
    same cell may come more than once.
    """

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = {ranking: _Heads(depth, len(scorer.numbers)) for ranking in ("dense", "bm25")}
        for part, dense, lexical in scorer.batches(batches):
            ids = part.column("doc_idx").to_numpy(zero_copy_only=False).astype(np.int64)
            coded = part.column("source_file").dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            names = coded.dictionary.to_pylist()
            order = np.argsort(codes, kind="stable")
            bounds = np.flatnonzero(np.diff(codes[order])) + 1
            for own in np.split(order, bounds):
                source = None if codes[own[0]] < 0 else names[codes[own[0]]]
                if cells is None or source in cells:
                    similarity = np.where(np.isnan(dense[own]), -np.inf, dense[own])
                    heads["dense"].add(source, similarity, ids[own], lexical[own])
                    heads["bm25"].add(source, lexical[own], ids[own], similarity)
            if sum(head.values for head in heads.values()) > STATE_VALUES:
                yield from _emitted(heads, scorer, cells)
                heads = {ranking: _Heads(depth, len(scorer.numbers)) for ranking in heads}
        yield from _emitted(heads, scorer, cells)

    return _inputs(rows, scorer, "doc_idx", "source_file", "embedding").mapInArrow(emit, HEAD_SCHEMA)


def _emitted(heads: dict[str, _Heads], scorer: Scorer, cells: Mapping[str | None, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    for ranking, head in heads.items():
        for source, (score, ids, other) in head.tables.items():
            wanted = score > -np.inf
            if cells is not None:
                wanted &= np.isin(np.arange(head.width), cells[source])
            line, column = np.nonzero(wanted)
            if len(line):
                dense, lexical = (score, other) if ranking == "dense" else (other, score)
                dense = dense[line, column]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ranking] * len(line)),
                        pa.array(scorer.numbers[column]),
                        pa.array([source] * len(line), pa.string()),
                        pa.array(ids[line, column]),
                        _nullable(np.where(np.isinf(dense), np.nan, dense)),
                        pa.array(lexical[line, column]),
                    ],
                    names=["ranking", "attribute_number", "source_file", "doc_idx", "dense_similarity", "bm25_score"],
                )


@dataclass(frozen=True)
class Contenders:
    """Candidates of one attribute and ranking, best first."""

    score: np.ndarray
    ids: np.ndarray

    def places(self, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For each row, how many candidates are at least as good as it is."""
        ascending = -self.score
        lower = np.searchsorted(ascending, -score, side="left")
        upper = np.searchsorted(ascending, -score, side="right")
        place = lower.copy()
        tied = np.flatnonzero(upper > lower)
        for low in np.unique(lower[tied]):
            same = tied[lower[tied] == low]
            high = upper[same[0]]
            place[same] = low + np.searchsorted(self.ids[low:high], ids[same], side="right")
        return place


COUNT_SCHEMA = "ranking string, attribute_number long, place long, chunks long"


def place_counts(rows: DataFrame, scorer: Scorer, contenders: dict[tuple[str, int], Contenders]) -> DataFrame:
    """Number of chunks per place between candidates, counted inside each task.

    ``contenders`` is keyed by ranking and attribute number.  Ranking ``total``
    counts the chunks that have a dense score at all, per attribute.
    """

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], np.ndarray] = {}
        for part, dense, lexical in scorer.batches(batches):
            ids = part.column("doc_idx").to_numpy(zero_copy_only=False)
            for column, number in enumerate(scorer.numbers):
                for ranking, table in (("dense", dense), ("bm25", lexical)):
                    score = table[:, column]
                    usable = ~np.isnan(score)
                    candidates = contenders.get((ranking, int(number)))
                    if candidates is not None:
                        places = candidates.places(score[usable], ids[usable])
                        found = np.bincount(places, minlength=len(candidates.ids) + 1)
                        counts[ranking, number] = counts.get((ranking, number), 0) + found
                    if ranking == "dense":
                        counts["total", number] = counts.get(("total", number), 0) + np.array([usable.sum()])
        for (ranking, number), found in counts.items():
            place = np.flatnonzero(found)
            if len(place):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ranking] * len(place)),
                        pa.array(np.full(len(place), number)),
                        pa.array(place, pa.int64()),
                        pa.array(found[place], pa.int64()),
                    ],
                    names=["ranking", "attribute_number", "place", "chunks"],
                )

    counted = _inputs(rows, scorer, "doc_idx", "embedding").mapInArrow(emit, COUNT_SCHEMA)
    return counted.groupBy("ranking", "attribute_number", "place").agg(F.sum("chunks").alias("chunks"))
