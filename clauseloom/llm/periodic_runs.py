"""Runs: stretches of words that repeat with a period, found by seeds and their extension.

A stretch of ``repeats`` periods agrees with itself, shifted by its period q, over at least
``repeats - 1`` periods.  Periods are searched in bands q, 2q, 4q, ...; the overlap guaranteed
to every period of a band gives the length of its seeds, the k-grams of that band.  As a
k-gram is no shorter than the band's periods, it comes again inside a run exactly one period
later: the pairs of neighbouring occurrences in a document hold every run, and there are no
more of them than words.  Pairs are extended along their diagonal (document, lag); a table of
the furthest place covered on each diagonal skips pairs inside an earlier extension.

k-grams are numbered exactly, by doubling: pairs of numbers of halves.  Words and halves that
don't come again in their document are dropped at once, so long grams cost almost nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import slices

RUN = "start long, length long, period long"


@dataclass(frozen=True)
class Options:
    """``repeats``: periods that a run holds at least (3 or more).  ``least``: words that it holds
    at least.  ``slice_bytes``: texts that are searched together (a longer one stands alone)."""

    repeats: int = 4
    least: int = 6
    slice_bytes: int = 4 << 20


def words_of(text: str | None) -> list[bytes]:
    """Stretches of other bytes than space, tab, line feed, vertical tab, form feed and carriage return."""
    return (text or "").encode().split()


class _Grams:
    """Numbers of the grams of 1, 2, 4, ... words that occur twice in one document."""

    def __init__(self, word: np.ndarray, doc: np.ndarray):
        self.doc = doc
        self.size = len(word)
        places = np.arange(self.size)
        self.levels = [self._numbered(places, doc.astype(np.int64) * (int(word.max(initial=0)) + 1) + word)]

    def _numbered(self, places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose key occurs again, and an array from place to the number of its key (-1: once only)."""
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        number = np.full(self.size, -1, dtype=np.int64)
        number[places[again]] = inverse[again]
        return places[again], number

    def joined(self, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of grams of 2**left words followed by 2**right words, ``right`` at most ``left``."""
        places, first = self.levels[left]
        second = self.levels[right][1]
        after = places + (1 << left)
        inside = after < self.size
        places, after = places[inside], after[inside]
        # Numbers name a document too, so both halves lie in one where the places' documents agree.
        both = (second[after] >= 0) & (self.doc[places] == self.doc[after])
        places = places[both]
        return places, first[places] * self.size + second[after[both]]

    def level(self, wanted: int) -> bool:
        """Number the grams up to 2**wanted words; False where none occurs twice."""
        while len(self.levels) <= wanted:
            last = len(self.levels) - 1
            self.levels.append(self._numbered(*self.joined(last, last)))
        return len(self.levels[wanted][0]) > 0

    def neighbours(self, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of joined grams and the distance to the next place of the same gram."""
        places, keys = self.joined(left, right)
        order = np.argsort(keys, kind="stable")  # places ascend, so they do within a key
        places, keys = places[order], keys[order]
        same = keys[1:] == keys[:-1]
        return places[:-1][same], np.diff(places)[same]


def _overlap(low: int, high: int, options: Options) -> int:
    """Words over which every run with a period in low..high agrees with itself one period later."""
    lowest = options.least // options.repeats  # about where the two bounds below cross
    periods = {min(max(p, low), high) for p in (low, high, lowest, lowest + 1)}
    return min(max(options.least - p, (options.repeats - 1) * p) for p in periods)


def _bands(longest: int, options: Options) -> Iterator[tuple[int, int, int, int]]:
    """Shortest and longest period of each band, and the two levels of grams that its seeds join."""
    low = 1
    while max(options.least, options.repeats * low) <= longest:
        high = 2 * low - 1
        overlap = _overlap(low, high, options)  # 2 * low or more, as repeats is 3 or more
        left = overlap.bit_length() - 1
        rest = overlap - (1 << left)
        if rest:
            yield low, high, left, rest.bit_length() - 1
        else:
            yield low, high, left - 1, left - 1
        low = high + 1


def find_runs(word: np.ndarray, start_of: np.ndarray, options: Options = Options()) -> list[tuple[int, int, int, int]]:
    """All runs of documents laid end to end: (document, start in it, length, period), ordered.

    ``word`` numbers the words, ``start_of`` has the place where each document starts and, last, the end.
    """
    if options.repeats < 3:
        raise ValueError("seeds are as long as the periods they find only from three repeats on")
    lengths = np.diff(start_of)
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    grams = _Grams(word, doc)
    same = word.tolist()
    bounds = start_of.tolist()
    found = []
    for low, high, left, right in _bands(int(lengths.max(initial=0)), options):
        if not grams.level(left):
            break
        places, lags = grams.neighbours(left, right)
        inside = (lags >= low) & (lags <= high)
        places, lags = places[inside], lags[inside]
        order = np.argsort(places, kind="stable")
        places, lags = places[order], lags[order]
        covered: dict[tuple[int, int], int] = {}
        for at, lag, own in zip(places.tolist(), lags.tolist(), doc[places].tolist(), strict=True):
            if at < covered.get((own, lag), -1):
                continue
            first, last = bounds[own], bounds[own + 1] - lag
            begin = at
            while begin > first and same[begin - 1] == same[begin - 1 + lag]:
                begin -= 1
            end = at + 1
            while end < last and same[end] == same[end + lag]:
                end += 1
            covered[own, lag] = end
            length = end - begin + lag
            if length >= max(options.least, options.repeats * lag):
                found.append((own, begin - first, length, lag))
    found.sort(key=lambda run: (run[0], run[1], run[3]))
    return found


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most repeats, compared exactly; ties to the smaller start, then period."""
    best = None
    for run in runs:  # in order of start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds beyond its first period, joined by one space."""
    if runs:
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, options: Options = Options(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``key``, ``n_words``, ``runs`` (by start, then period), ``strongest`` and
    ``collapsed``, the text without what its runs repeat.

    Places and lengths count words.  Map-only: a row is searched where it lies, so copies, hot
    sources and frequent words shuffle nothing; work is n log n for n words of a text, also
    where one word fills it.  A null or empty text has no words, no runs, a null ``strongest``
    and an empty ``collapsed``; null keys and repeated rows are kept as they are; other columns
    are ignored, whatever they are called; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    run_type = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", options.slice_bytes):
            lists = [words_of(value) for value in batch.column("text").to_pylist()]
            numbers: dict[bytes, int] = defaultdict(count().__next__)
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            start_of = np.concatenate([[0], np.cumsum(sizes)])
            word = np.fromiter((numbers[w] for own in lists for w in own), np.int64, int(start_of[-1]))
            runs: list[list[tuple[int, int, int]]] = [[] for _ in lists]
            for own, *rest in find_runs(word, start_of, options):
                runs[own].append(tuple(rest))
            named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs]
            best = [strongest(own) for own in runs]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(sizes),
                    pa.array(named, pa.list_(run_type)),
                    pa.array([b and dict(zip(("start", "length", "period"), b, strict=True)) for b in best], run_type),
                    pa.array([collapsed(*pair).decode() for pair in zip(lists, runs, strict=True)], pa.string()),
                ],
                names=["key", "n_words", "runs", "strongest", "collapsed"],
            )

    schema = f"key {kind}, n_words long, runs array<struct<{_fields()}>>, strongest struct<{_fields()}>, collapsed string"
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
    return found.withColumnRenamed("key", key)


def _fields() -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split() for part in RUN.split(", ")))


def with_planted_periods(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key and the text, where every tenth document (by checksum of its key) goes on periodically.

    With h the CRC-32 of the decimal key, g = h // 10 and n > 0 words: where h % 10 is 0, each
    word i from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8).
    """
    h = F.crc32(F.col(key).cast("string"))
    words = F.filter(F.split(F.col(text), "[ \\t-\\r]+"), lambda w: w != "")
    chosen = docs.select(F.col(key), F.col(text), h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    planted = """array_join(transform(sequence(0, n - 1),
        i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')"""
    return (
        chosen.withColumn("n", F.size("w"))
        .withColumn("g", F.expr("h div 10"))
        .withColumn("a", F.expr("if(n > 0, g % n, 0)"))
        .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
        .select(F.col(key), F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.expr(planted)).otherwise(F.col(text)).alias(text))
    )


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the strongest run and checksums of ``periodic_runs``, computed in the JVM."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    best = F.col("strongest")
    return found.select(
        F.col(key),
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
