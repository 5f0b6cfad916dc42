"""Token counts per document without materialising the ids of documents.

SentencePiece turns every space into its word mark and puts one in front of the
text.  No piece of the vocabulary holds a mark behind another character (checked
when the model is loaded), so no merge crosses the place before a run of marks:
each run together with what follows it, a pre-token, is segmented by itself.  A
task counts the pieces of each distinct pre-token once and joins those counts to
the documents' pre-token frequencies.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import slices

MARK = "▁"
CACHED_PRE_TOKENS = 400_000  # entries a Python worker keeps
CACHED_LENGTH = 64  # longer pre-tokens are counted, not kept

_RUN = re.compile(" +[^ ]*")
_COUNTERS: dict[str, PieceCounter] = {}


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without the first of its leading spaces."""
    text = text.replace(MARK, " ")
    parts = text.split(" ")
    return [run[1:] for run in _RUN.findall(f" {text}")] if "" in parts else parts


class PieceCounter:
    """Counts pieces once per distinct pre-token; keeps a bounded table of counts."""

    def __init__(self, model: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("a piece crosses the start of a word: its texts can't be counted by pre-token")
        # A run of one space at the end of a text: alone, the model would take it for an empty text.
        self.last = {"": len(self.model.encode(". ")) - len(self.model.encode("."))}
        self.known: dict[str, int] = dict(self.last)

    def count(self, texts: list[str]) -> list[int]:
        frequencies = [Counter(pre_tokens(text)) if text else {} for text in texts]
        distinct = set().union(*frequencies)
        fresh = [piece for piece in distinct if piece not in self.known]
        counts = dict(zip(fresh, map(len, self.model.encode(fresh, num_threads=1)), strict=True)) if fresh else {}
        if len(self.known) + len(counts) > CACHED_PRE_TOKENS:
            counts |= {piece: self.known[piece] for piece in distinct if piece in self.known}
            self.known = dict(self.last)
        self.known |= counts
        totals = [sum(map(int.__mul__, map(self.known.__getitem__, own), own.values())) for own in frequencies]
        for piece in counts:
            if len(piece) > CACHED_LENGTH:
                self.known.pop(piece, None)
        return totals


def _counter(model: str) -> PieceCounter:
    if model not in _COUNTERS:
        _COUNTERS[model] = PieceCounter(model)
    return _COUNTERS[model]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``key``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``model`` is the path of a SentencePiece model on every node.  Map-only: nothing
    is shuffled, so copies and hot sources don't matter.  A null or empty text has 0
    bytes and 0 tokens; null keys and repeated rows are kept as they are; other
    columns are ignored, whatever they are called; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), sizes.cast(pa.int64()), pa.array(counter.count(texts), pa.int64())],
                names=["key", "n_bytes", "n_tokens"],
            )

    counted = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, n_bytes long, n_tokens long"
    )
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
