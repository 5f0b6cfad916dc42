"""A stored postings index with block bounds: exact BM25 top-k that reads few postings.

The index is written once, as Parquet files sorted by term, and asked many times.  A row holds
the postings of one term in one block of chunks (numbers divided by the block size), so no row
grows with the corpus; a file holds the rows of some blocks.  A small table beside it has, for each
row, the greatest saturated frequency in it.  Weighed by a query, these bound what a chunk of a
block can score: the most promising blocks of every query are scored first, and of the others only
those whose bound reaches the k-th score found so far.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions.text import tokens
from clauseloom.operators.lexical import B, EPSILON, K1, SCALE, query_terms
from clauseloom.operators.ordered import top_k
from clauseloom.operators.sizing import broadcast_if_small, fits
from clauseloom.session import stored

BLOCK = 1024  # chunk numbers of one block
FIRST_BLOCKS = 4  # blocks of a query that are scored before any bound is known
ENTRIES = "array<struct<doc_idx: long, tf: int, length: long>>"
SLACK = 1e-9  # sums of bounds and of scores may differ in their last digits
TASK_BLOCKS = 16  # blocks that a task writes or scores
CROWDED = 4  # chunks for each number of a block, beyond which the block is not gathered in Python
NAMED_TERMS = 2000  # terms that are named to the Parquet reader, which then skips other row groups


def saturation(frequency: Column, length: Column, average: float, k1: float, b: float) -> Column:
    pivot = (1 - b) + b * (length / F.lit(average + EPSILON))
    return frequency * (k1 + 1) / (frequency + k1 * pivot + EPSILON)


@dataclass(frozen=True)
class PostingsIndex:
    """``postings``: term, block, entries (doc_idx, tf, length by doc_idx); ``bounds``: term, block,
    chunks (with the term), best (greatest saturated frequency); ``chunks``: doc_idx."""

    postings: DataFrame
    bounds: DataFrame
    chunks: DataFrame
    documents: int
    average_length: float
    k1: float
    b: float


def write_index(chunks: DataFrame, path: str, block: int = BLOCK, k1: float = K1, b: float = B) -> PostingsIndex:
    """Write the index of ``chunks`` (doc_idx, content) to ``path`` and open it.

    Texts travel once, to the task of their block, where they are counted, grouped and written;
    postings do not travel.  A frequent term is spread over as many rows as it has blocks.
    """
    spark = chunks.sparkSession
    chunks = chunks.select(F.col("doc_idx").cast("long").alias("doc_idx"), "content")
    chunks.select("doc_idx").write.mode("overwrite").parquet(f"{path}/chunks")
    numbers = spark.read.parquet(f"{path}/chunks")
    documents = numbers.count()
    in_block = F.expr(f"doc_idx div {block}").alias("block")
    sizes = numbers.groupBy(in_block).count()
    crowded = stored(sizes.where(F.col("block").isNull() | (F.col("count") > CROWDED * block)).select("block"))
    rows = chunks.select(in_block, "doc_idx", "content")
    tasks = max(spark.sparkContext.defaultParallelism, documents // (block * TASK_BLOCKS) + 1)
    if fits(crowded, 0):
        postings = _gathered(rows, tasks)
    else:
        many = F.broadcast(crowded) if fits(crowded) else crowded
        in_many = rows["block"].eqNullSafe(many["block"])
        postings = _gathered(rows.join(many, in_many, "left_anti"), tasks)
        postings = postings.unionByName(_collected(rows.join(many, in_many, "left_semi")))
    (
        postings.sortWithinPartitions("term", "block")
        .write.option("parquet.bloom.filter.enabled#term", "true")
        .option("compression", "zstd")
        .mode("overwrite")
        .parquet(f"{path}/postings")
    )
    postings = spark.read.parquet(f"{path}/postings")
    words = postings.select(F.explode("entries.tf").alias("tf")).agg(F.sum("tf")).first()[0]
    average = (words or 0) / documents if documents else 0.0
    saturated = lambda entry: saturation(entry["tf"], entry["length"], average, k1, b)
    # Most terms of a block occur in one chunk of it, which needs no pass over an array.
    best = F.when(F.size("entries") == 1, saturated(F.col("entries")[0])).otherwise(F.array_max(F.transform("entries", saturated)))
    bounds = postings.select("term", "block", F.size("entries").cast("long").alias("chunks"), best.alias("best"))
    bounds.write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/bounds")
    totals = [(documents, average, k1, b)]
    totals = spark.createDataFrame(totals, "documents long, average_length double, k1 double, b double")
    # Written last: an index without totals is not complete and can't be opened.
    totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> PostingsIndex:
    tables = [spark.read.parquet(f"{path}/{name}") for name in ("postings", "bounds", "chunks")]
    return PostingsIndex(*tables, *spark.read.parquet(f"{path}/totals").first())


def _gathered(rows: DataFrame, tasks: int) -> DataFrame:
    """(term, block, entries) of ``rows`` (block, doc_idx, content), whose blocks are gathered one at a time."""
    dealt = rows.repartition(tasks, "block").sortWithinPartitions("block", "doc_idx")
    counted = dealt.select("block", "doc_idx", tokens(F.col("content")).alias("terms"))
    return counted.mapInArrow(_block_postings, f"term string, block long, entries {ENTRIES}")


def _collected(rows: DataFrame) -> DataFrame:
    """The same of blocks with too many chunks to be gathered: each distinct term of a chunk travels to its row."""
    single = rows.select("block", "doc_idx", tokens(F.col("content")).alias("terms")).mapInArrow(
        _counted, "term string, block long, doc_idx long, tf int, length long"
    )
    entries = F.sort_array(F.collect_list(F.struct("doc_idx", "tf", "length")))
    return single.groupBy("term", "block").agg(entries.alias("entries"))


def _counts(terms: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms in order, and by term and row: number of the term, row, frequency, length of the row."""
    length = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = terms.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = np.repeat(np.arange(len(length)), length)
    keys, counts = np.unique(place[coded.indices.to_numpy(zero_copy_only=False)] * max(len(length), 1) + row, return_counts=True)
    term, row = np.divmod(keys, max(len(length), 1))
    return coded.dictionary.take(pa.array(order)), term, row, counts, length[row]


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, block, doc_idx, tf, length) of each distinct term of each row."""
    for batch in batches:
        terms, term, row, counts, length = _counts(batch.column("terms"))
        row = pa.array(row)
        columns = [terms.take(pa.array(term)), batch.column("block").take(row), batch.column("doc_idx").take(row)]
        columns += [pa.array(counts, pa.int32()), pa.array(length)]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "block", "doc_idx", "tf", "length"])


def _block_postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, block, entries) of rows that are sorted by block and number; holds the texts of one block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for start, stop in zip(cuts, cuts[1:]):
            if held and stop > start and held[0].column("block")[0].as_py() != block[start]:
                yield _postings_of(held)
                held = []
            if stop > start:
                held.append(batch.slice(start, stop - start))
    if held:
        yield _postings_of(held)


def _postings_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    terms, term, row, counts, length = _counts(pa.concat_arrays([batch.column("terms") for batch in held]))
    doc_idx = pa.concat_arrays([batch.column("doc_idx") for batch in held]).take(pa.array(row))
    entries = pa.StructArray.from_arrays([doc_idx, pa.array(counts, pa.int32()), pa.array(length)], ["doc_idx", "tf", "length"])
    offsets = pa.array(np.searchsorted(term, np.arange(len(terms) + 1)), pa.int32())
    block = pa.repeat(held[0].column("block")[0], len(terms))
    return pa.RecordBatch.from_arrays([terms, block, pa.ListArray.from_arrays(offsets, entries)], names=["term", "block", "entries"])


def _weights(index: PostingsIndex, queries: DataFrame) -> DataFrame:
    """(attribute_number, term, weight) of the terms of the queries that the index has."""
    spread = _named(index.bounds, queries).groupBy("term").agg(F.sum("chunks").alias("spread"))
    idf = F.log((index.documents - F.col("spread") + 0.5) / (F.col("spread") + 0.5) + EPSILON)
    weighed = queries.join(broadcast_if_small(stored(spread)), "term").withColumn("weight", F.col("query_frequency") * idf)
    return stored(weighed.select("attribute_number", "term", "weight"))


def _weighed(index: PostingsIndex, queries: DataFrame) -> DataFrame:
    """(attribute_number, term, block, weight, bound) of the index rows that the queries, or their weights, ask for."""
    weights = queries if "weight" in queries.columns else _weights(index, queries)
    # A chunk of the block may lack the term, so a term that counts against it bounds nothing.
    bound = F.greatest(F.col("weight") * F.col("best"), F.lit(0.0)).alias("bound")
    listed = index.bounds.join(broadcast_if_small(weights), "term")
    return listed.select("attribute_number", "term", "block", "weight", bound)


def _named(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows of the index with a term of the queries."""
    terms = queries.select("term").distinct()
    if fits(terms, NAMED_TERMS):
        rows = rows.where(F.col("term").isin([row.term for row in terms.collect()]))
    return rows.join(broadcast_if_small(terms), "term", "left_semi")


def _scores(index: PostingsIndex, weighed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Scores of all chunks that share a term with an attribute, in the blocks asked for (attribute_number, block)."""
    asked = weighed.groupBy("term").agg(F.collect_set(F.struct("attribute_number", "weight")).alias("asked"))
    wanted = blocks.groupBy("block").agg(F.collect_set("attribute_number").alias("wanted"))
    listed = blocks.select("block").distinct()
    tasks = max(listed.sparkSession.sparkContext.defaultParallelism, listed.count() // TASK_BLOCKS + 1)
    postings = index.postings.join(F.broadcast(listed), "block", "left_semi") if fits(listed) else index.postings
    # Each row of the index travels once, to its block, however many attributes ask for it.
    if fits(asked):
        met = _named(postings, weighed).repartition(tasks, "block").join(F.broadcast(asked), "term")
    else:
        met = postings.join(asked, "term").select("block", "entries", "asked").repartition(tasks, "block")
    met = met.join(F.broadcast(wanted) if fits(blocks) else wanted, "block")
    entry, ask = F.col("entry"), F.col("ask")
    part = ask["weight"] * saturation(entry["tf"], entry["length"], index.average_length, index.k1, index.b)
    # Whole numbers add up alike in any order, so equal texts get equal scores.  Halves go away from zero,
    # as F.round has them, which takes each number through its decimal text.
    whole = F.when(part < 0, -F.floor(0.5 - part * SCALE)).otherwise(F.floor(part * SCALE + 0.5))
    return (
        met.select("block", "entries", "wanted", F.explode("asked").alias("ask"))
        .where(F.array_contains("wanted", ask["attribute_number"]))
        .select("block", "ask", F.explode("entries").alias("entry"))
        .groupBy("block", ask["attribute_number"].alias("attribute_number"), entry["doc_idx"].alias("doc_idx"))
        .agg((F.sum(whole) / SCALE).alias("bm25_score"))
        .drop("block")
    )


def _order() -> list[Column]:
    return [F.desc("bm25_score"), F.asc("doc_idx")]


@dataclass(frozen=True)
class Answer:
    """``top``: attribute_number, doc_idx, bm25_score, rank.  ``blocks``: attribute_number, blocks
    (that hold a term of it) and scored (of them), which shows what the bounds spared."""

    top: DataFrame
    blocks: DataFrame


def bm25_top_k(index: PostingsIndex, attributes: DataFrame, k: int = 20) -> Answer:
    """The ``k`` best chunks of each attribute, exactly.

    A chunk that shares no term scores 0 and outranks those with a negative score; such chunks
    are added, by number, to attributes with fewer than ``k`` positive scores, whose blocks are
    all scored.
    """
    numbers = attributes.select("attribute_number").distinct()
    weights = _weights(index, stored(query_terms(attributes)))
    weighed = _weighed(index, weights)
    bounds = stored(weighed.groupBy("attribute_number", "block").agg(F.sum("bound").alias("bound")))
    first = top_k(bounds, ["attribute_number"], [F.desc("bound"), F.asc("block")], FIRST_BLOCKS, "turn").drop("turn", "bound")
    # Of the scores of blocks only the best of each attribute are kept.
    best = lambda scores: top_k(scores, ["attribute_number"], _order(), k)
    early = stored(best(_scores(index, weights, first)))
    reached = early.where(F.col("rank") == k).select("attribute_number", F.col("bm25_score").alias("reached"))
    # One row for each attribute; without k positive scores every block counts.
    rest = bounds.join(first, ["attribute_number", "block"], "left_anti").join(
        broadcast_if_small(reached), "attribute_number", "left"
    )
    open_ = F.coalesce(F.col("reached"), F.lit(0.0)) <= 0
    rest = stored(rest.where(open_ | (F.col("bound") >= F.col("reached") - SLACK)).select("attribute_number", "block"))
    kept = stored(best(early.drop("rank").unionByName(best(_scores(index, weights, rest)).drop("rank")))).drop("rank")
    positive = kept.where("bm25_score > 0").groupBy("attribute_number").count().where(F.col("count") >= k)
    short = numbers.join(positive, "attribute_number", "left_anti")
    candidates = kept.unionByName(_unmatched(index, short, weights, bounds, k))
    top = best(candidates).select("attribute_number", "doc_idx", "bm25_score", "rank")
    scored = first.unionByName(rest).groupBy("attribute_number").agg(F.count("*").alias("scored"))
    blocks = bounds.groupBy("attribute_number").agg(F.count("*").alias("blocks")).join(scored, "attribute_number")
    return Answer(top, blocks)


def _unmatched(index: PostingsIndex, short: DataFrame, weights: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
    """Score 0 for the first ``k`` chunks without a shared term of each attribute in ``short``.

    Looks at the first chunks by number, and the postings that reach them, at more each time until
    all attributes have ``k`` or there are no more; how far depends on the chunks that do share a term.
    """
    asked = [row.attribute_number for row in short.collect()]  # bounded by the dictionary
    zero = "attribute_number long, doc_idx long, bm25_score double"
    if not asked:
        return index.chunks.sparkSession.createDataFrame([], zero)
    each = F.explode(F.array(*(F.lit(number).cast("long") for number in asked))).alias("attribute_number")
    weights, blocks = (df.join(F.broadcast(short), "attribute_number", "left_semi") for df in (weights, bounds))
    blocks = blocks.select("attribute_number", "block")
    taken = 2 * k
    while True:
        heads = index.chunks.orderBy("doc_idx").limit(taken)
        last = F.lit(heads.agg(F.max("doc_idx")).first()[0]).cast("long")
        reached = replace(index, postings=index.postings.where(F.col("entries")[0]["doc_idx"] <= last))
        sharing = _scores(reached, weights, blocks).where(F.col("doc_idx") <= last)
        free = heads.select(each, "doc_idx").join(sharing, ["attribute_number", "doc_idx"], "left_anti")
        found = stored(top_k(free, ["attribute_number"], [F.asc("doc_idx")], k).select("attribute_number", "doc_idx"))
        least = found.groupBy("attribute_number").count().where(F.col("count") >= k).count()
        if least == len(asked) or taken >= index.documents:
            return found.select("attribute_number", "doc_idx", F.lit(0.0).alias("bm25_score"))
        taken *= 4
