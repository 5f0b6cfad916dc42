"""Removal of byte strings that an earlier document holds, by suffix arrays over candidate pieces.

A string of ``length`` bytes holds at least one anchor: the position of its k-gram with
the smallest hash.  Equal strings have equal anchors, so only the surroundings of anchors
that several documents share can hold repeats.  Those pieces are dealt by their anchor.
A task joins its pieces to one text, sorts the suffixes by Lyndon grouping, and reads off
neighbours that agree in ``length`` bytes which is the smallest document of each string.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import slices, stored
from clauseloom.llm.suffix_sort import suffix_array
from clauseloom.llm.vectors import runs
from clauseloom.operators.sizing import broadcast_if_small


@dataclass(frozen=True)
class Options:
    """``length`` of a repeated string in bytes, ``gram`` of an anchor.  ``parts``: ranges of a string's
    start before its anchor that are sorted apart.  ``sorted_bytes``: symbols of one suffix array, about
    (short ones stay in the processor's cache; the pieces of one anchor stay together).
    ``buckets``: shares of the anchors; each is held by one task at a time.  ``doc_buckets``: shares of the
    documents, by which the places of shared anchors travel to their texts."""

    length: int = 50
    gram: int = 16
    parts: int = 4
    sorted_bytes: int = 1 << 14
    flush_bytes: int = 12 << 20
    buckets: int = 256
    doc_buckets: int = 1024

    @property
    def reach(self) -> int:
        """Most bytes of a string before its anchor."""
        return self.length - self.gram


_TABLE = np.random.default_rng(29).integers(0, 1 << 63, 256, np.uint64)


def anchors(data: bytes, options: Options) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are smallest in some string of ``length`` bytes."""
    k, w = options.gram, options.reach + 1
    if len(data) < options.length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _grams(_TABLE[np.frombuffer(data, np.uint8)], k)
    lowest = _sliding(h, w, np.minimum)
    # A k-gram is chosen if the greatest of the minima of the windows around it is its own hash.
    pad = np.zeros(w - 1, np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([pad, lowest, pad]), w, np.maximum) == h)
    return chosen, h[chosen]


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k``; a power of two."""
    n = 1
    while n < k:
        h = h[:-n] * np.uint64(0x9E3779B97F4A7C15) + (h[n:] ^ (h[n:] >> np.uint64(29)))
        n *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    done = 1
    out = values
    while done * 2 <= width:
        out = of(out[:-done], out[done:])
        done *= 2
    if done < width:
        n = len(values) - width + 1
        out = of(out[:n], out[width - done : width - done + n])
    return out


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    return b"".join(texts), np.cumsum([0, *map(len, texts)])


def _anchor_blocks(batches: Iterator[pa.RecordBatch], options: Options) -> Iterator[pa.RecordBatch]:
    """Anchors of a task's documents, packed by bucket.

    Of an anchor that several documents of the task share, the smallest document's goes
    into the exchange; the others are shared already and ride along apart.
    """
    held: list[tuple[np.ndarray, ...]] = []
    docs: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal size
        h, which, place = (np.concatenate(x) for x in zip(*held, strict=True))
        doc = np.concatenate(docs)[which]
        held.clear()
        docs.clear()
        size = 0
        order = np.lexsort((doc, h))
        h, doc, place = h[order], doc[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        last = np.append(first[1:], len(h)) - 1
        shared = np.repeat(doc[first] != doc[last], last - first + 1)
        # One row of each shared hash asks for others; all its rows are known to be wanted.
        ask = ~shared
        ask[first] = True
        bucket = (h >> np.uint64(48)) % np.uint64(options.buckets)
        order = np.lexsort((place, doc, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(options.buckets + 1, dtype=np.uint64))
        rows: dict[str, list] = {"bucket": [], "asked": [], "known": []}
        for b in range(options.buckets):
            own = order[cuts[b] : cuts[b + 1]]
            if len(own):
                asked, known = own[ask[own]], own[shared[own]]
                rows["bucket"].append(b)
                rows["asked"].append(_packed(doc[asked], place[asked], h[asked], shared[asked]))
                rows["known"].append(_packed(doc[known], place[known]))
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["bucket"], pa.int32()), pa.array(rows["asked"], pa.binary()), pa.array(rows["known"], pa.binary())],
            names=["bucket", "asked", "known"],
        )

    for batch in slices(batches, "text", 4 << 20):
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        data, starts = b"".join(texts), np.cumsum([0, *map(len, texts)])
        place, h = anchors(data, options)
        owner = np.searchsorted(starts, place, side="right") - 1
        inside = place + options.gram <= starts[owner + 1]
        place, h, owner = place[inside], h[inside], owner[inside]
        held.append((h, owner + sum(map(len, docs)), place - starts[owner]))
        docs.append(batch.column("doc").to_numpy())
        size += len(data)
        if size > options.flush_bytes:
            yield flush()
    if held:
        yield flush()


def _packed(doc: np.ndarray, place: np.ndarray, *more: np.ndarray) -> bytes:
    """Anchors sorted by document, compressed: steps from document to document, counts, places, 48 bits of hashes, flags.

    A hash that agrees by chance only makes a piece that nothing matches.
    """
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(doc)))
    columns = [np.diff(doc[first], prepend=np.int64(0)), counts.astype("<u4"), (place & 0xFFFF).astype("<u2"), (place >> 16).astype("<u2")]
    if more:
        h, flag = more
        columns += [(h & np.uint64(0xFFFFFFFF)).astype("<u4"), (h >> np.uint64(32) & np.uint64(0xFFFF)).astype("<u2"), flag.astype("u1")]
    head = len(first).to_bytes(8, "little") + len(doc).to_bytes(8, "little")
    return zstandard.compress(b"".join([head, *(c.tobytes() for c in columns)]), 1)


def _unpacked(data: bytes, full: bool) -> list[np.ndarray]:
    """doc, place and, if ``full``, hash and flag of every packed anchor."""
    data = zstandard.decompress(data)
    docs, n = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    at, out = 16, []
    for kind, count in (("<i8", docs), ("<u4", docs), ("<u2", n), ("<u2", n), *((("<u4", n), ("<u2", n), ("u1", n)) if full else ())):
        out.append(np.frombuffer(data, kind, count, at))
        at += count * np.dtype(kind).itemsize
    step, counts, low, high = out[:4]
    found = [np.repeat(np.cumsum(step), counts), low.astype(np.int64) | high.astype(np.int64) << 16]
    return found + ([out[4].astype(np.uint64) | out[5].astype(np.uint64) << np.uint64(32), out[6]] if full else [])


def _shared_places(batches: Iterator[pa.RecordBatch], options: Options) -> Iterator[pa.RecordBatch]:
    """Anchors that several documents share, bucket by bucket, packed by shares of the documents.

    A row holds all places that go to one share, so that rows number as the shares, not as the documents.
    """
    held: list[list[np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        share = ((doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(options.doc_buckets)
        order = np.lexsort((place, doc, share))
        doc, place, share = doc[order], place[order], share[order]
        cuts = [0, *(np.flatnonzero(share[1:] != share[:-1]) + 1).tolist(), len(share)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(share[cuts[:-1]].astype(np.int32)),
                pa.array([_packed(doc[i:j], place[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary()),
            ],
            names=["share", "packed"],
        )

    for table in runs(batches, ("bucket",)):
        asked = [_unpacked(x, True) for x in table.column("asked").to_pylist()]
        doc, place, h, known = (np.concatenate(x) for x in zip(*asked, strict=True))
        order = np.argsort(h, kind="stable")
        doc, place, h, known = doc[order], place[order], h[order], known[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        counts = np.diff(np.append(first, len(h)))
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        wanted = np.repeat(several, counts) & (known == 0)
        held.append([doc[wanted], place[wanted]])
        held += [_unpacked(x, False) for x in table.column("known").to_pylist()]
        if sum(len(x[0]) for x in held) > 1_000_000:
            yield flush()
    if sum(len(x[0]) for x in held):
        yield flush()


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, places): one row for each document of the shares, its places in order."""
    for table in runs(batches, ("share",)):
        doc, place = (np.concatenate(x) for x in zip(*(_unpacked(x, False) for x in table.column("packed").to_pylist()), strict=True))
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        cuts = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[cuts[:-1]]), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(place, pa.int32()))],
            names=["doc", "places"],
        )


def _pieces(batches: Iterator[pa.RecordBatch], options: Options) -> Iterator[pa.RecordBatch]:
    """Surroundings of shared anchors; equal ones of a task are one row with all their (doc, mark, place)."""
    held: dict[tuple[bytes, int], list[int]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        items = list(held.items())
        held.clear()
        size = 0
        for at in range(0, len(items), 20_000):
            part = items[at : at + 20_000]
            h = [xxhash.xxh64_intdigest(piece[left : left + options.gram]) for (piece, left), _ in part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(h, np.uint64).view(np.int64)),
                    pa.array([piece for (piece, _), _ in part], pa.binary()),
                    pa.array([left for (_, left), _ in part], pa.int32()),
                    pa.array([array("q", own).tobytes() for _, own in part], pa.binary()),
                ],
                names=["anchor", "piece", "left", "own"],
            )

    reach, length = options.reach, options.length
    for batch in slices(batches, "text", 4 << 20):
        columns = (batch.column(name).to_pylist() for name in ("doc", "mark", "text", "places"))
        for doc, mark, text, places in zip(*columns, strict=True):
            data = text.encode()
            # Places of another text with the same doc_id may lie beyond this one.
            for place in {p for p in places if p + length - reach <= len(data)}:
                start = place - reach if place > reach else 0
                held.setdefault((data[start : place + length], place - start), []).extend((doc, mark, place))
                size += 1
        if size > 200_000:
            yield from flush()
    yield from flush()


class _Sorter:
    """Smallest document of every string of the pieces given to it, by suffix arrays.

    All strings of a group hold the same bytes around their anchor, its core, and equal strings are of
    one group.  A core is one symbol of the text, which no other group uses.
    """

    def __init__(self, options: Options):
        self.options = options
        self.clear()

    def clear(self) -> None:
        self.symbols: list[int] = []
        self.owner: list[tuple[list[int], int, int] | None] = []
        self.groups = 0

    def group(self) -> int:
        """A symbol for the core of a new group; bytes take 1 to 256."""
        self.groups += 1
        return 256 + self.groups

    def add(self, piece: bytes, doc: int, symbol: int, start: int, end: int) -> list[int]:
        """List of the smallest document of each string of ``piece``, right after ``finish``; the core is at start:end."""
        lows = [doc] * (len(piece) - self.options.length + 1)
        # Symbols of a string, and of what follows the last string's first symbol and ends the piece.
        width = self.options.length - (end - start) + 1
        self.symbols += [byte + 1 for byte in piece[:start]]
        self.symbols.append(symbol)
        self.symbols += [byte + 1 for byte in piece[end:]]
        self.symbols.append(0)
        self.owner += [(lows, i, width) for i in range(len(lows))]
        self.owner += [None] * width
        return lows

    def finish(self) -> None:
        symbols, owner = self.symbols, self.owner
        before: list[int] | None = None
        same: list[tuple[list[int], int]] = []

        def settle() -> None:
            if len(same) > 1:
                lowest = min(low[i] for low, i in same)
                for low, i in same:
                    low[i] = lowest

        for suffix in suffix_array(symbols):
            entry = owner[suffix]
            if entry is None:
                continue
            low, i, width = entry
            string = symbols[suffix : suffix + width]
            if string != before:
                settle()
                same = []
                before = string
            same.append((low, i))
        settle()
        self.clear()


def _spans(batches: Iterator[pa.RecordBatch], options: Options) -> Iterator[pa.RecordBatch]:
    """(doc, mark, start, end) of bytes whose strings a smaller document holds, anchor by anchor."""
    sorter = _Sorter(options)
    waiting: list[tuple[list[int], int, list[int]]] = []
    found: dict[tuple[int, int], list[int]] = {}
    length = options.length
    step = -(-(options.reach + 1) // options.parts)
    ranges = [(low, min(low + step, options.reach + 1)) for low in range(0, options.reach + 1, step)]

    def settle() -> None:
        sorter.finish()
        for own, most, lows in waiting:
            # lows[i] is of the string that starts most - i bytes before the anchor.
            if min(lows) == max(lows):
                stretches = [(lows[0], 0, len(lows))]
            else:
                cuts = [0, *(i for i in range(1, len(lows)) if lows[i] != lows[i - 1]), len(lows)]
                stretches = [(lows[i], i, j) for i, j in zip(cuts, cuts[1:], strict=False)]
            for doc, mark, place in zip(own[::3], own[1::3], own[2::3], strict=True):
                for low, i, j in stretches:
                    if low < doc:
                        found.setdefault((doc, mark), []).extend((place - most + i, place - most + j - 1 + length))
        waiting.clear()

    def flush() -> pa.RecordBatch:
        rows = [(doc, mark, merged(np.array(own, np.int64).reshape(-1, 2)).ravel()) for (doc, mark), own in found.items()]
        found.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
            names=["doc", "mark", "spans"],
        )

    def take(pieces: dict[tuple[bytes, int], list[int]]) -> None:
        """Sort out the strings around one anchor."""
        lowest = {key: min(own[::3]) for key, own in pieces.items()}
        if len(pieces) == 1:
            # One piece alone: its strings are those of its smallest document.
            ((piece, left), own), doc = next(iter(pieces.items())), min(lowest.values())
            if doc != max(own[::3]):
                most, least = left, max(0, left + length - len(piece))
                waiting.append((own, most, [doc] * (most - least + 1)))
            return
        for low, high in ranges:
            groups: dict[bytes, dict[tuple[bytes, int], list[tuple[bytes, int]]]] = {}
            for key in pieces:
                piece, left = key
                # Strings that start ``least`` to ``most`` bytes before the anchor and lie in the piece.
                most, least = min(high - 1, left), max(low, left + length - len(piece))
                if most >= least:
                    shared = piece[left - low : left + length - high + 1]
                    part = (piece[left - most : left - least + length], most)
                    groups.setdefault(shared, {}).setdefault(part, []).append(key)
            for parts in groups.values():
                keys = [key for some in parts.values() for key in some]
                if len(keys) == 1 and lowest[keys[0]] == max(pieces[keys[0]][::3]):
                    continue
                symbol = sorter.group() if len(parts) > 1 else 0
                for (part, most), some in parts.items():
                    doc = min(map(lowest.__getitem__, some))
                    core = (most - low, most - high + 1 + length)
                    lows = sorter.add(part, doc, symbol, *core) if symbol else [doc] * (len(part) - length + 1)
                    waiting.extend((pieces[key], most, lows) for key in some)

    current, pieces = None, {}
    for batch in batches:
        for anchor, piece, left, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if anchor != current:
                if pieces:
                    take(pieces)
                current, pieces = anchor, {}
                if len(sorter.symbols) > options.sorted_bytes or len(waiting) > 100_000:
                    settle()
                    if len(found) > 60_000:
                        yield flush()
            pieces.setdefault((piece, left), []).extend(array("q", own))
    if pieces:
        take(pieces)
    settle()
    yield flush()


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) rows, in order; touching rows join."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > ends[:-1]])
    last = np.append(np.flatnonzero(first)[1:], len(spans)) - 1
    return np.stack([spans[first, 0], ends[last]], axis=1)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 2 << 20):
        out: dict[str, list] = {name: [] for name in ("n_bytes", "n_removed", "n_spans", "kept")}
        spans_of = []
        columns = (batch.column(name).to_pylist() for name in ("text", "usable", "copy", "spans"))
        for text, usable, copy, some in zip(*columns, strict=True):
            data = text.encode() if text else b""
            some = [[0, len(data)]] if copy else some if usable else []
            flat = [x for own in some or [] for x in own]
            spans = merged(np.array(flat, np.int64).reshape(-1, 2)).tolist()
            at, kept = 0, []
            for start, end in spans:
                kept.append(data[at:start])
                at = end
            out["kept"].append(b"".join([*kept, data[at:]]))
            out["n_bytes"].append(len(data))
            out["n_removed"].append(len(data) - len(out["kept"][-1]))
            out["n_spans"].append(len(spans))
            spans_of.append([{"start": s, "end": e} for s, e in spans])
        digests = [hashlib.sha256(x).hexdigest() for x in out["kept"]]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *(pa.array(out[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")),
                pa.array(digests),
                pa.array(spans_of, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(out["kept"], pa.binary()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
        )


def remove_repeats(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """Per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start, end), kept (binary).

    A byte is removed if a string of ``length`` bytes that covers it also starts in a
    document with a smaller doc_id.  Matches don't cross documents; strings are judged on
    the input.  Every repeat is found: anchors and pieces only narrow the search, bytes
    are compared exactly.  ``kept`` may cut a character, so it is binary.

    A task first joins its own equal pieces and anchors, so that a passage in a third of
    all documents sends as many rows as there are tasks, not documents.

    Null and empty texts have 0 bytes; rows with a null doc_id lose nothing and count for no
    other; rows that share a doc_id are no repeats of each other and are judged by their own
    texts; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    # A key without nulls: else Spark filters one side of the two joins and deals the texts twice.
    rows = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), "text",
        F.xxhash64("text").alias("mark"), F.xxhash64(F.lit(1), "text").alias("check"),
    )
    usable = F.col("doc_id").isNotNull() & F.coalesce(F.octet_length("text") >= options.length, F.lit(False))
    # Of equal texts the smallest document speaks; the others lose all their bytes.
    names = rows.where(usable).select("doc", "mark", "check")
    same = names.groupBy("mark", "check").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    same = stored(same.where("first <> last").select("mark", "check", "first"))
    # Only where texts share a doc_id does a mark tell them apart.
    twice = names.groupBy("doc").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
    twice = stored(twice.where("low <> high").select("doc", F.lit(True).alias("twice")))
    flagged = rows.join(broadcast_if_small(same), ["mark", "check"], "left").join(broadcast_if_small(twice), "doc", "left")
    flagged = flagged.select(
        "doc_id", "doc", F.when(F.col("twice"), F.col("mark")).otherwise(F.lit(0).cast("long")).alias("mark"), "text",
        (usable & F.coalesce(F.col("doc") > F.col("first"), F.lit(False))).alias("copy"), usable.alias("usable"),
    )
    blocks = flagged.where("usable and not copy").select("doc", "text").mapInArrow(
        lambda b: _anchor_blocks(b, options), "bucket int, asked binary, known binary"
    )
    places = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        lambda b: _shared_places(b, options), "share int, packed binary"
    )
    places = places.repartition("share").sortWithinPartitions("share").mapInArrow(_by_document, "doc long, places array<int>")
    # Dealt once for both joins: each reads all columns, so that Spark sees one exchange.
    texts = flagged.repartition("doc")
    pieces = texts.join(places, "doc").select(*texts.columns, "places").mapInArrow(
        lambda b: _pieces(b, options), "anchor long, piece binary, left int, own binary"
    )
    spans = (
        pieces.repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(lambda b: _spans(b, options), "doc long, mark long, spans array<long>")
    )
    spans = spans.groupBy("doc", "mark").agg(F.collect_list("spans").alias("spans")).select(
        "doc", F.struct("mark", "spans").alias("of_mark")
    )
    # Few texts share a doc_id: their spans are gathered per doc_id and told apart by the mark.
    spans = spans.groupBy("doc").agg(F.collect_list("of_mark").alias("marked"))
    own = F.filter("marked", lambda x: x["mark"] == F.col("mark"))
    marked = texts.join(spans, "doc", "left").select(
        *texts.columns, F.flatten(F.transform(own, lambda x: x["spans"])).alias("spans")
    )
    return marked.mapInArrow(
        _kept,
        f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<start:long,end:long>>, kept binary",
    )
