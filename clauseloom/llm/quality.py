"""Quality by compression: how much shorter a text gets with good than with bad examples at hand.

Two zstandard dictionaries are trained, one from blocks of well-labelled and one from blocks
of badly labelled texts.  A text is cut into blocks of the same size, so that a dictionary
speaks about all of it and not only about its beginning, and every block is compressed with
both.  The difference of the compressed sizes over the bytes of the text is the evidence.  Where
a text repeats itself neither dictionary helps, so the smaller size over the bytes is weighed
too.  A logistic curve fitted on documents that gave nothing to the dictionaries turns both
into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import discard, slices, stored
from clauseloom.llm.toxicity import held_out

LIMIT = 0.5  # of the evidence on both sides; bytes saved per byte beyond it tell nothing more


@dataclass(frozen=True)
class Options:
    """``sample_rows``: most labelled documents that the model is fitted on (about; chosen by hash).
    ``sample_blocks``: most blocks of each label that a dictionary is trained from, and
    ``blocks_each``: most of them from one document (all chosen by hash, over whole texts).
    ``dictionary``: bytes of a dictionary.  ``block``: bytes compressed at a time.  ``level``: of
    zstandard.  ``ballast``: bytes added to every text's length, so that a few bytes prove little.
    ``limit``: score from which ``predicted`` is 1."""

    sample_rows: int = 20_000
    sample_blocks: int = 20_000
    blocks_each: int = 32
    dictionary: int = 110 << 10
    block: int = 512
    level: int = 3
    ballast: int = 16
    limit: float = 0.3


@dataclass(frozen=True)
class Model:
    """Two dictionaries (``dictionary`` bytes at most) and a logistic curve; travels with the tasks."""

    good: bytes
    bad: bytes
    weights: tuple[float, float, float]  # intercept, difference, size
    options: Options


def cut(data: bytes, size: int) -> list[bytes]:
    return [data[at : at + size] for at in range(0, len(data), size)]


class Evidence:
    """Compressed sizes of texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes, options: Options):
        self.options = options
        self.good, self.bad = self._compressor(good), self._compressor(bad)

    def _compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if not content:
            return zstandard.ZstdCompressor(level=self.options.level, **plain)
        dictionary = zstandard.ZstdCompressionDict(content)
        dictionary.precompute_compress(level=self.options.level)
        return zstandard.ZstdCompressor(level=self.options.level, dict_data=dictionary, **plain)

    def sizes(self, text: str | None) -> tuple[int, int, int]:
        """Bytes of the text, and of its blocks compressed with the good and the bad dictionary."""
        data = (text or "").encode()
        blocks = cut(data, self.options.block)
        good, bad = self.good.compress, self.bad.compress
        return len(data), sum(len(good(b)) for b in blocks), sum(len(bad(b)) for b in blocks)


def evidence(sizes: np.ndarray, options: Options) -> np.ndarray:
    """Two columns: normalised difference of the compressed sizes, above 0 where good examples help
    more, and the smaller of them, normalised."""
    length, good, bad = sizes.reshape(-1, 3).T.astype(float)
    whole = length + options.ballast
    difference = np.clip((bad - good) / whole, -LIMIT, LIMIT)
    return np.column_stack([difference, np.minimum((np.minimum(good, bad) + options.ballast) / whole, 1.0)])


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """Weights of a logistic curve by Newton steps with a weak pull to 0.

    A difference never speaks against the kind whose examples helped: where the fit says so, the
    dictionaries tell nothing and every text gets the share of good ones.
    """
    w = np.zeros(3)
    if not len(y):
        return (0.0, 0.0, 0.0)
    rows = np.column_stack([np.ones(len(x)), x])
    pull = np.array([1e-2, 1e-3, 1e-2])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (p - y) + pull * w
        bend = (rows * (p * (1 - p))[:, None]).T @ rows + np.diag(pull)
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 8.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-9:
            break
    if w[1] < 0:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return (float(np.log(share / (1 - share))), 0.0, 0.0)
    return tuple(map(float, w))


def scores(sizes: np.ndarray, model: Model) -> np.ndarray:
    weights = np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(weights[0] + evidence(sizes, model.options) @ weights[1:], -500, 500)))


def trained(blocks: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of the blocks; of too few blocks, the blocks themselves."""
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:size]


def _sample(docs: DataFrame, labels: DataFrame, options: Options) -> DataFrame:
    """About ``sample_rows`` labelled texts that are not held out: text, good, tuning."""
    usable = labels.where("quality is not null and doc_id is not null").where(~held_out()).select("doc_id", "quality")
    share = min(1.0, options.sample_rows / max(usable.count(), 1))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    tuning = F.crc32(F.col("doc_id").cast("string")) % 5 == 4
    # At most about sample_rows narrow rows: the bound of the broadcast side.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    return stored(texts.select("text", (F.col("quality") > 0).alias("good"), tuning.alias("tuning")))


def _blocks(sample: DataFrame, good: bool, options: Options) -> list[bytes]:
    """At most ``sample_blocks`` distinct blocks, the same ones whatever the layout of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            out: list[bytes] = []
            for text in batch.column("text").to_pylist():
                own = cut(text.encode(), options.block)
                step = max(1, -(-len(own) // options.blocks_each))
                out += own[::step]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["part"])

    parts = sample.where("not tuning").where(F.col("good") == good).select("text").mapInArrow(run, "part binary")
    picked = parts.distinct().orderBy(F.xxhash64("part"), "part").limit(options.sample_blocks)
    return [bytes(row["part"]) for row in picked.collect()]


def train(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> Model:
    """Dictionaries from most of the sampled documents, the curve from those kept apart for tuning.

    Null texts and null labels are left out, repeated rows count each.  Without labels of one
    kind its dictionary is empty; without any, every text scores 0.5.
    """
    sample = _sample(docs, labels, options)
    good, bad = (trained(_blocks(sample, kind, options), options.dictionary) for kind in (True, False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Evidence(good, bad, options)
        for batch in slices(batches, "text", 4 << 20):
            x = evidence(np.array([judge.sizes(text) for text in batch.column("text").to_pylist()]), options)
            yield pa.RecordBatch.from_arrays(
                [batch.column("good").cast(pa.int32()), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["good", "difference", "size"]
            )

    # One short row for each document kept apart.
    rows = sample.where("tuning").select("text", "good").mapInArrow(run, "good int, difference double, size double")
    rows = rows.toPandas().sort_values(["difference", "size", "good"])  # sums whatever the layout
    discard(sample)
    return Model(good, bad, calibrate(rows[["difference", "size"]].to_numpy(float), rows["good"].to_numpy(float)), options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, and n_bytes, good_bytes, bad_bytes.

    Map-only: copies and hot sources don't matter, and a long text is read block by block.  Null
    and empty texts have no evidence and score as the curve says for none; a null key is not
    held out; repeated rows are scored each; other columns are ignored, whatever they are
    called; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Evidence(model.good, model.bad, model.options)
        for batch in slices(batches, "text", 4 << 20):
            sizes = np.array([judge.sizes(text) for text in batch.column("text").to_pylist()], dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores(sizes, model)), *(pa.array(sizes[:, i]) for i in range(3))],
                names=["doc_id", "score", "n_bytes", "good_bytes", "bad_bytes"],
            )

    schema = f"doc_id {kind}, score double, n_bytes long, good_bytes long, bad_bytes long"
    return docs.select("doc_id", "text").mapInArrow(run, schema).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= model.options.limit).cast("int").alias("predicted"),
        "n_bytes",
        "good_bytes",
        "bad_bytes",
    )
