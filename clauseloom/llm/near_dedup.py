"""MinHash near-duplicates with sequential Bayesian verification.

Signatures are cut into bands; documents that agree in a band are candidates.  A pair's
signatures are compared batch by batch, and the pair is dropped as soon as the posterior
chance that its similarity reaches the threshold falls below a chosen miss probability.
Survivors are verified on their full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm.common import components, discard, slices, stored
from clauseloom.llm.vectors import matrix, runs
from clauseloom.operators.sizing import broadcast_if_small

CACHED_WORDS = 300_000  # entries a Python worker keeps
SPAN = 8_192  # shingles hashed at a time
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@dataclass(frozen=True)
class Options:
    """``words`` per shingle; ``percent``: least similarity of a link; ``bands`` x ``rows`` hashes.

    With the defaults a pair at the threshold shares no band with a chance of 5e-8.
    ``miss``: chance at which a pair is dropped after ``step`` more hashes.  ``block``: members
    of a bucket in one block (about); a task compares two blocks at a time.
    """

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    step: int = 16
    miss: float = 1e-6
    block: int = 2_048
    seed: int = 3


class Shingles:
    """Distinct shingles of texts as 64-bit hashes."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}
        rng = np.random.default_rng(20)
        self.odd = rng.integers(0, 1 << 62, words, np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, text: str | None) -> np.ndarray:
        """Sorted hashes of the runs of ``words`` words; of all words where there are fewer."""
        words = text.encode().lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        hashes = np.empty(len(words), np.uint64)
        try:
            hashes[:] = [known[w] for w in words]
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            hashes[:] = [known[w] for w in words]
            for w in set(words):
                if len(w) > 64:
                    del known[w]
        k = min(self.words, len(words))
        n = len(words) - k + 1
        mixed = np.full(n, k, np.uint64)
        for i in range(k):
            mixed = (mixed ^ hashes[i : i + n]) * self.odd[i]
            mixed ^= mixed >> np.uint64(31)
        return np.unique(mixed)


def signature(shingles: np.ndarray, options: Options) -> np.ndarray:
    """Smallest values of the shingles under each hash function."""
    rng = np.random.default_rng(options.seed)
    count = options.bands * options.rows
    odd = rng.integers(0, 1 << 62, count, np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, count, np.uint64)
    lowest = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), SPAN):
        part = shingles[at : at + SPAN]
        lowest = np.minimum(lowest, (odd[:, None] * part[None, :] + shift[:, None]).min(axis=1))
    return (lowest >> np.uint64(32)).astype("<u4")


def needed_matches(options: Options) -> list[tuple[int, int]]:
    """(hashes compared, fewest that must agree): below, the posterior of reaching the threshold is under ``miss``.

    The prior is uniform: after m of n matches the similarity is Beta(m + 1, n - m + 1), whose
    tail from t on is the chance of at most m successes in n + 1 trials at t.
    """
    t = options.percent / 100
    out = []
    for n in range(options.step, options.bands * options.rows + 1, options.step):
        tail, least = 0.0, n
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= options.miss:
                least = m
                break
        out.append((n, least))
    return out


def signed(docs: DataFrame, options: Options, key: str, text: str) -> DataFrame:
    """Stored rows (key, n, class, sig): set size, a hash of the whole set, signature; null for empty sets."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(options.words)
        for batch in slices(batches, "text", 8 << 20):
            sets = [shingles.of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s, options).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["key", "n", "class", "sig"],
            )

    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return stored(chosen.mapInArrow(run, f"key {kind}, n long, class binary, sig binary"))


def _agreeing(first: np.ndarray, second: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Matches of each pair of signatures, -1 for those that were dropped on the way."""
    alive = np.arange(len(first))
    matches = np.zeros(len(first), np.int64)
    start = 0
    for n, least in needed:
        matches[alive] += (first[alive, start:n] == second[alive, start:n]).sum(axis=1)
        lost = matches[alive] < least
        matches[alive[lost]] = -1
        alive = alive[~lost]
        start = n
    return matches


def plausible(pairs: DataFrame, signatures: DataFrame, options: Options) -> DataFrame:
    """The pairs (a, b) that outlast the comparison of their signatures."""
    needed = needed_matches(options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matches = _agreeing(matrix(batch.column("sig_a"), "<u4"), matrix(batch.column("sig_b"), "<u4"), needed)
            yield batch.select(["a", "b"]).filter(pa.array(matches >= 0))

    both = pairs.join(signatures.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(
        signatures.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b"
    )
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """True if the similarity of two sorted sets reaches ``percent``."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


@contextmanager
def short_batches(spark: SparkSession, rows: int = 256):
    """Few rows per Arrow batch while jobs run whose rows hold whole texts."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def linked(pairs: DataFrame, docs: DataFrame, options: Options) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold; ``docs`` has node and text.

    The pairs' texts are fetched by two equi-joins; a document with many partners is split
    over tasks, and the set of one text serves the rows that follow it.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(options.words)
        last: tuple[str | None, np.ndarray] = ("", np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if one != last[0]:
                    last = (one, shingles.of(one))
                x, y = last[1], shingles.of(two)
                keep.append(alike(x, y, options.percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with short_batches(docs.sparkSession):
        wanted = stored(wanted)
        texts = stored(docs.join(broadcast_if_small(wanted), "node", "left_semi"))
        both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(
            texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"
        )
        found = stored(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"))
    discard(wanted)
    discard(texts)
    return found


def _candidates(table: pa.Table, sig: np.ndarray, component: np.ndarray, options: Options) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its partners in another component) of a block pair; one of each pair is minor.

    A pair is looked at in the first band that it shares, in the one block pair where it meets.
    Components that the caller joins meanwhile count.
    """
    bands = sig.reshape(len(sig), options.bands, options.rows)
    node, minor, leader, side, band = (table.column(name).to_numpy() for name in ("node", "minor", "leader", "side", "band"))
    apart = table.column("i")[0] != table.column("j")[0]
    for x in np.flatnonzero((minor > 0) & (node != leader)):
        other = (component != component[x]) & (node != leader) & ((minor == 0) | (node < node[x]))
        if apart:
            other &= side != side[x]
        other = np.flatnonzero(other)
        yield int(x), other[(bands[other] == bands[x]).all(axis=2).argmax(axis=1) == band[x]]


def _plausible_members(batches: Iterator[pa.RecordBatch], options: Options) -> Iterator[pa.RecordBatch]:
    """The rows of each block pair whose signature stays plausible with some partner's, without the signatures."""
    needed = needed_matches(options)
    for table in runs(batches, ("bucket", "i", "j")):
        sig = matrix(table.column("sig"), "<u4")
        wanted = np.zeros(len(sig), bool)
        for x, other in _candidates(table, sig, table.column("component").to_numpy(), options):
            found = other[_agreeing(np.broadcast_to(sig[x], (len(other), sig.shape[1])), sig[other], needed) >= 0]
            wanted[found] = True
            wanted[x] |= len(found) > 0
        yield from table.drop_columns(["sig"]).filter(pa.array(wanted)).to_batches()


def _links_in(batches: Iterator[pa.RecordBatch], options: Options) -> Iterator[pa.RecordBatch]:
    """Links between the components of each block pair, verified on full sets; only links leave the task.

    A pair is looked at no more once its components have been joined.
    """
    needed = needed_matches(options)
    shingles = Shingles(options.words)
    for table in runs(batches, ("bucket", "i", "j")):
        sig = matrix(table.column("sig"), "<u4")
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy().copy()
        texts = table.column("text")
        sets: dict[int, np.ndarray] = {}
        links: list[tuple[int, int]] = []
        for i, other in _candidates(table, sig, component, options):
            matches = _agreeing(np.broadcast_to(sig[i], (len(other), sig.shape[1])), sig[other], needed)
            for j in other[np.argsort(-matches, kind="stable")][: int((matches >= 0).sum())].tolist():
                if component[j] == component[i]:
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = shingles.of(texts[k].as_py())
                if alike(sets[i], sets[j], options.percent):
                    links.append((int(node[i]), int(node[j])))
                    component[component == component[j]] = component[i]
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _block_pairs(shared: DataFrame, component: DataFrame, options: Options) -> DataFrame:
    """Members of buckets with several components, dealt to pairs of blocks: of each pair of
    components one is outside the bucket's largest.

    The members outside it and those inside have blocks of their own, of about ``block`` each.
    Every block of the former meets every block, so a block pair holds about two blocks at most.
    """
    placed = shared.drop("size").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = placed.groupBy("bucket", "component").agg(F.count("*").alias("members"))
    largest = counts.groupBy("bucket").agg(
        F.max_by("component", F.struct("members", "component")).alias("largest"),
        F.max("members").alias("inside"), F.sum("members").alias("size"), F.count("*").alias("parts"),
    ).where("parts > 1")
    minor = F.col("component") != F.col("largest")
    deal = F.xxhash64("node", "bucket")
    return (
        placed.join(largest, "bucket")
        .withColumn("outer", F.ceil((F.col("size") - F.col("inside")) / options.block).cast("int"))
        .withColumn("inner", F.ceil(F.col("inside") / options.block).cast("int"))
        .withColumn("minor", minor.cast("int"))
        .withColumn("own", F.when(minor, F.pmod(deal, "outer")).otherwise(F.col("outer") + F.pmod(deal, "inner")).cast("int"))
        .withColumn("last", F.when(minor, F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .select(
            "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") <= F.col("other")).cast("int").alias("side"), "band", "node", "component", "minor", "leader",
        )
    )


def _remaining(shared: DataFrame, component: DataFrame, signatures: DataFrame, docs: DataFrame, options: Options) -> DataFrame:
    """Stored links (a, b) in buckets that hold several components.

    Block pairs are screened on signatures alone; texts are fetched only for the members that
    stay plausible with another.
    """
    dealt = _block_pairs(shared, component, options)

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")

    screened = gathered(dealt.join(signatures, "node").select(*dealt.columns, "sig"))
    spread = stored(screened.mapInArrow(lambda batches: _plausible_members(batches, options), dealt.schema))
    wanted = stored(spread.select("node").distinct())
    texts = docs.join(broadcast_if_small(wanted), "node", "left_semi").dropDuplicates(["node"])
    carried = stored(texts.join(signatures, "node"))
    with short_batches(docs.sparkSession):
        found = stored(
            gathered(spread.join(carried, "node")).mapInArrow(lambda batches: _links_in(batches, options), "a long, b long")
        )
    for table in (spread, wanted, carried):
        discard(table)
    return found


def near_duplicates(docs: DataFrame, options: Options = Options(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: key, n_shingles, component_id, kept.

    ``component_id`` is the smallest key reachable by links of similarity ``percent`` or
    more; ``kept`` tells that it is the row's own.  Rows with equal shingle sets are one
    node.  The first pairs to be verified are each bucket's smallest key with the others.
    In buckets whose members then lie in several components, all pairs of different
    components are compared, block by block and inside the tasks; only links leave them.
    So no link is lost however large a bucket, and pairs within a component are never made.

    Words are runs of characters other than ASCII white space, A-Z lowered.  Null and
    empty texts have an empty set, link with nothing and are kept; so are rows with a null
    key, whose component is null.  Rows that share a key are linked whatever their texts;
    for further links one of the texts counts.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = signed(docs, options, key, text)
    known = rows.where("n > 0 and key is not null").withColumn("node", F.col("key").cast("long"))
    copies = known.groupBy("class").agg(F.min("node").alias("node"), F.first("sig").alias("sig"))
    copies = stored(copies)
    signatures = copies.select("node", "sig").dropDuplicates(["node"])
    width = 4 * options.rows
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(options.bands - 1)),
        lambda i: F.xxhash64(i, F.col("sig").substr(i * width + 1, F.lit(width))),
    )
    cells = signatures.select("node", F.posexplode(bands).alias("band", "bucket"))
    sizes = cells.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("leader")).where("size > 1")
    shared = stored(cells.join(sizes, "bucket"))
    texts = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text")).where("node is not null")

    tested = stored(
        plausible(shared.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(),
                  signatures, options)
    )
    same_key = known.join(copies.select("class", F.col("node").alias("own")), "class").where("own <> node")
    same_key = same_key.select(F.col("node").alias("key"), F.col("own")).distinct()
    # A key that is another class's smallest joins the two classes.
    clash = same_key.join(signatures.select(F.col("node").alias("key")), "key").select(
        F.col("key").alias("a"), F.col("own").alias("b")
    )
    several = same_key.groupBy("key").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("a", "b")
    links = linked(tested, texts, options)
    component = components(links.unionByName(clash).unionByName(several))
    more = _remaining(shared.where("size > 2"), component, signatures, texts, options)
    if not more.isEmpty():
        component = _merged(component, more)
    nodes = copies.select("class", "node").join(component, "node", "left")
    nodes = nodes.select("class", F.coalesce("component", "node").alias("component"))
    return rows.join(nodes, "class", "left").select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNotNull(), F.coalesce("component", F.col("key").cast("long"))).alias("component_id"),
        F.when(F.col("key").isNotNull(), F.coalesce("component", F.col("key").cast("long")) == F.col("key"))
        .otherwise(F.lit(True))
        .alias("kept"),
    )


def _merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """Components of the nodes after more links between them."""

    def named(side: str) -> DataFrame:
        return component.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))

    between = links.join(named("a"), "a", "left").join(named("b"), "b", "left")
    between = between.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    joined = components(between).select(F.col("node").alias("component"), F.col("component").alias("low"))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    every = component.join(ends, "node", "full").select("node", F.coalesce("component", "node").alias("component"))
    return stored(every.join(joined, "component", "left").select("node", F.coalesce("low", "component").alias("component")))


def without_near_duplicates(docs: DataFrame, options: Options = Options(), key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does: the one with the smallest key.

    Of rows that repeat a key one stays.  Rows with a null key stay.
    """
    found = near_duplicates(docs, options, key)
    gone = stored(found.where("not kept").select(key).distinct())
    rest = docs.join(broadcast_if_small(gone), key, "left_anti")
    repeated = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    repeated = stored(repeated)
    if not repeated.isEmpty():
        repeated = broadcast_if_small(repeated)
        once = rest.join(repeated, key, "left_semi").dropDuplicates([key])
        rest = rest.join(repeated, key, "left_anti").unionByName(once)
    return rest.select(docs.columns)
