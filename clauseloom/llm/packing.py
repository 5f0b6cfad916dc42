"""Packing token sequences into windows: non-negative least squares over a length histogram.

Documents longer than a window give whole windows and a remainder.  The histogram
of remainders has fewer than ``window`` entries whatever the number of documents.
All combinations of two or three lengths that fill a window exactly are the columns
of a least-squares problem whose non-negative solution says how often to use each.
Rounded, they cover most remainders uncut.  What is left is packed greedily: laid
end to end by length and cut at the window's end, so at most the last window of a
corpus is padded.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import slices, stored
from clauseloom.operators.sizing import broadcast_if_small

WINDOW = 2048
END_ID = 1
CACHED_WORDS = 900_000  # entries a Python worker keeps
CACHED_LENGTH = 64
STEPS = 200  # of the least-squares solver

_PART_BITS = 40
_ENDING = ("([a-z0-9])([.,;:!?]+) ", r"\1 \2 ")
_PART = b"|"
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of whole texts, encoding each distinct word once.

    The tokenizer drops white space, ignores case, and never has a letter or digit in one
    pre-token with the punctuation behind it.  So texts can be cut at spaces, line breaks
    and before such punctuation, and ASCII letters lowered, without another result.  A text
    that may hold special tokens keeps its case, as theirs counts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {b"": b""}

    def _clean(self, text: str | None) -> bytes:
        data = text.encode() if text else b""
        data = data if b"<|" in data else data.lower()
        return data.replace(b"\n", b" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, END_ID behind them."""
        data = pa.array([self._clean(text) for text in texts], pa.large_binary())
        split = pc.split_pattern(pc.replace_substring_regex(data, *_ENDING), b" ")
        coded = split.values.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn(distinct)
        ids = pa.array([self.known[word] for word in distinct], pa.large_binary()).take(coded.indices)
        starts = np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy()]
        view, end = memoryview(ids.buffers()[2] or b""), array("I", [END_ID]).tobytes()
        for word in distinct:
            if len(word) > CACHED_LENGTH:
                del self.known[word]
        return [bytes(view[i:j]) + end for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]

    def _learn(self, distinct: list[bytes]) -> None:
        """Add the ids of new words; many are encoded at once, parted by a word whose id none of them has."""
        # Special tokens hold that word's character too, so they are encoded alone.
        if len(self.known) > CACHED_WORDS:
            self.known = {b"": b""} | {word: self.known[word] for word in distinct if word in self.known}
        fresh = [word for word in distinct if word not in self.known]
        alone = [word for word in fresh if _PART in word]
        plain = [word for word in fresh if _PART not in word]
        between = self.tokenizer.encode(_PART.decode(), add_special_tokens=False).ids
        groups = [plain[i : i + 100] for i in range(0, len(plain), 100)]
        joined = (b" " + _PART + b" ").join
        found = self.tokenizer.encode_batch_fast([joined(g).decode() for g in groups], add_special_tokens=False)
        for words, x in zip(groups, found, strict=True):
            ids = np.array(x.ids, "<u4")
            ends = (4 * np.flatnonzero(ids == between[0])).tolist()
            data = ids.tobytes()
            starts = [0, *(e + 4 for e in ends)]
            self.known.update(zip(words, map(data.__getitem__, map(slice, starts, [*ends, len(data)])), strict=True))
        found = self.tokenizer.encode_batch_fast([word.decode() for word in alone], add_special_tokens=False)
        self.known.update(zip(alone, [array("I", x.ids).tobytes() for x in found], strict=True))


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenized(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Stored table of documents as ids: row, doc_id, doc_tokens, ids, and how the windows cut them.

    ``row`` is unique: the task's number and a place in it; ``first_full`` counts the
    whole windows before the row in its task and ``place`` the remainders of the same
    length.  Storing fixes them for all later steps.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(window, np.int64)
        row = full = 0
        for batch in slices(batches, "text", 4 << 20):
            out: dict[str, list] = {name: [] for name in ("row", "doc_tokens", "rest", "place", "first_full", "crcs", "ids")}
            for ids in encoder.encode(batch.column("text").to_pylist()):
                n = len(ids) // 4
                rest = n % window
                view = memoryview(ids)
                out["crcs"].append([zlib.crc32(view[i : i + 4 * window]) for i in range(0, len(ids), 4 * window)])
                out["row"].append((part << _PART_BITS) + row)
                out["doc_tokens"].append(n)
                out["rest"].append(rest)
                out["place"].append(int(seen[rest]))
                out["first_full"].append((part << _PART_BITS) + full)
                out["ids"].append(ids)
                seen[rest] += 1
                row += 1
                full += n // window
            longs = [pa.array(out[name], pa.int64()) for name in ("row", "doc_tokens", "rest", "place", "first_full")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *longs, pa.array(out["crcs"], pa.list_(pa.int64())), pa.array(out["ids"], pa.binary())],
                names=["doc_id", "row", "doc_tokens", "rest", "place", "first_full", "crcs", "ids"],
            )

    schema = (
        f"doc_id {kind}, row long, doc_tokens long, rest long, place long, first_full long, crcs array<long>, ids binary"
    )
    return stored(docs.select("doc_id", "text").mapInArrow(run, schema))


def combinations(window: int) -> np.ndarray:
    """All pairs and triples of positive lengths that sum to ``window``; 0 pads the pairs."""
    first = np.arange(1, window // 2 + 1)
    pairs = np.stack([np.zeros_like(first), first, window - first], axis=1)
    a = np.arange(1, window // 3 + 1)
    counts = (window - a) // 2 - a + 1
    a = np.repeat(a, counts)
    b = a + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.concatenate([pairs, np.stack([a, b, window - a - b], axis=1)])


def solve(columns: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring ``columns`` nearest to ``histogram`` (accelerated projected gradient)."""
    window = len(histogram)

    def total(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(columns[:, slot], x, window) for slot in range(3))
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return r[columns].sum(axis=1)

    goal = histogram.astype(float)
    x = np.ones(len(columns))
    for _ in range(12):  # largest eigenvalue
        x = back(total(x))
        norm = np.linalg.norm(x)
        x /= norm
    step = 1 / (1.05 * norm)
    x = ahead = np.zeros(len(columns))
    t = 1.0
    for _ in range(steps):
        rest = total(ahead) - goal
        rest[0] = 0
        new = np.maximum(ahead - step * back(rest), 0)
        following = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / following * (new - x)
        x, t = new, following
    return x


@dataclass
class Plan:
    """Where the remainder with a given rank among those of its length goes.

    Ranks below ``covered[length]`` lie in combination windows: ``keys`` holds
    length << 40 | first rank of each run of uses, ``sequence`` and ``offset`` the
    place of the run's first use.  Later ranks lie in a stream from ``stream[length]``
    on, whose windows start at sequence ``combined``.
    """

    window: int
    covered: np.ndarray
    keys: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    stream: np.ndarray
    combined: int
    sequences: int


def plan(histogram: np.ndarray, steps: int = STEPS) -> Plan:
    """Round the solution and lay out combination windows and the stream behind them.

    Combinations are rounded up in order of their solution, as far as the lengths
    last.  Everything here has a size bounded by the window, not by the documents.
    """
    window = len(histogram)
    columns = combinations(window)
    columns = columns[((histogram[columns] > 0) | (columns == 0)).all(axis=1)]
    left = histogram.astype(np.int64).copy()
    used = np.zeros(window, np.int64)
    runs: list[tuple[int, int, int, int]] = []
    sequences = 0
    if len(columns):
        x = solve(columns, histogram, steps)
        for i in np.argsort(-x, kind="stable"):
            parts = [int(p) for p in columns[i] if p]
            need = {p: parts.count(p) for p in parts}
            times = min(int(np.ceil(x[i] - 1e-9)), *(int(left[p]) // k for p, k in need.items()))
            if times <= 0:
                continue
            offset = 0
            for p in parts:  # each slot takes a run of ``times`` ranks of its length
                runs.append(((p << _PART_BITS) + int(used[p]), sequences, offset, times))
                used[p] += times
                left[p] -= times
                offset += p
            sequences += times
    runs.sort()
    lengths = np.arange(window)
    volume = left * lengths
    volume[0] = 0
    total = int(volume.sum())
    return Plan(
        window,
        used,
        np.array([r[0] for r in runs], np.int64),
        np.array([r[1] for r in runs], np.int64),
        np.array([r[2] for r in runs], np.int64),
        np.cumsum(volume) - volume,
        sequences,
        sequences + -(-total // window),
    )


def _place(batches: Iterator[pa.RecordBatch], chart: Plan) -> Iterator[pa.RecordBatch]:
    """Pieces of the remainders: up to two for each."""
    for batch in batches:
        rest, rank = (batch.column(name).to_numpy() for name in ("rest", "rank"))
        inside = rank < chart.covered[rest]
        key = (rest << _PART_BITS) + rank
        run = np.maximum(np.searchsorted(chart.keys, key, side="right") - 1, 0)
        at = chart.stream[rest] + (rank - chart.covered[rest]) * rest
        sequence = chart.combined + at // chart.window
        offset = at % chart.window
        if len(chart.keys):
            sequence = np.where(inside, chart.sequence[run] + key - chart.keys[run], sequence)
            offset = np.where(inside, chart.offset[run], offset)
        first = np.minimum(rest, chart.window - offset)
        order = np.concatenate([np.arange(len(rest)), np.flatnonzero(first < rest)])
        second = np.arange(len(order)) >= len(rest)
        start = batch.column("doc_tokens").to_numpy()[order] - rest[order] + np.where(second, first[order], 0)
        length = np.where(second, (rest - first)[order], first[order])
        crc = pa.array(batch.column("crc").to_numpy()[order], pa.int64(), mask=(first < rest)[order])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row").take(pa.array(order)),
                batch.column("doc_id").take(pa.array(order)),
                pa.array(start),
                pa.array(length),
                crc,
                batch.column("doc_tokens").take(pa.array(order)),
                pa.array(sequence[order] + second),
                pa.array(np.where(second, 0, offset[order])),
            ],
            names=["row", "doc_id", "start", "length", "crc", "doc_tokens", "sequence_id", "offset"],
        )


def pack(tokens: DataFrame, window: int = WINDOW, steps: int = STEPS) -> DataFrame:
    """Pieces of the documents in ``tokens`` (made by ``tokenized``) and their places.

    Columns: row, doc_id, start, length, crc (of whole remainders and windows, null for
    a piece of a cut remainder), doc_tokens, sequence_id, offset.  Every id lies in one
    piece, the pieces of a sequence leave no gap from 0, and all sequences but possibly
    the last of the stream are full.

    A rank within a length needs no group in one place: tasks count their own, and the
    counts of (task, length) are summed.  Null and empty texts hold the end id alone;
    repeated rows and null keys are documents of their own; an empty table has no pieces.
    """
    kind = tokens.schema["doc_id"].dataType.simpleString()
    narrow = tokens.select(
        "row", "doc_id", "doc_tokens", "rest", "place", F.shiftright("row", _PART_BITS).alias("part"),
        F.coalesce(F.element_at("crcs", -1), F.lit(0)).alias("crc"),
    ).where("rest > 0")
    counts = stored(narrow.groupBy("part", "rest").agg(F.count("*").alias("n")).coalesce(16))
    histogram = np.zeros(window, np.int64)
    for length, n in counts.groupBy("rest").agg(F.sum("n")).collect():  # fewer rows than the window has places
        histogram[length] = n
    chart = plan(histogram, steps)
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "rest", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = narrow.join(starts, ["part", "rest"]).select(
        "row", "doc_id", "doc_tokens", "rest", "crc", (F.col("place") + F.col("before")).alias("rank")
    )
    schema = (
        f"row long, doc_id {kind}, start long, length long, crc long, doc_tokens long, sequence_id long, offset long"
    )
    rests = ranked.mapInArrow(lambda batches: _place(batches, chart), schema)
    full = (
        tokens.where(F.col("doc_tokens") >= window)
        .select(
            "row", "doc_id", "doc_tokens", "first_full",
            F.posexplode(F.slice("crcs", 1, F.floor(F.col("doc_tokens") / window).cast("int"))).alias("k", "crc"),
        )
        .select(
            "row", "doc_id",
            (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "crc",
            "doc_tokens",
            (F.lit(chart.sequences).cast("long") + F.col("first_full") + F.col("k")).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    )
    return rests.unionByName(full)


def with_ids(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """``pieces`` with their ids (little-endian unsigned 32-bit) as a column ``ids``."""
    return (
        pieces.join(tokens.select("row", F.col("ids").alias("_ids")), "row")
        .withColumn("ids", F.expr("substring(_ids, cast(4 * start + 1 as int), cast(4 * length as int))"))
        .drop("_ids")
    )


def checksummed(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """``pieces`` with ``ids_crc32``: known for whole remainders, computed from the ids of cut ones."""
    cut = stored(pieces.where("crc is null"))
    ids = with_ids(broadcast_if_small(cut), tokens)
    return (
        pieces.where("crc is not null")
        .withColumn("ids_crc32", F.col("crc"))
        .unionByName(ids.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
        .drop("crc")
    )
