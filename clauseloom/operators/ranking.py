"""Dense, lexical and fused rankings of chunks per attribute."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.lexicon import ATTRIBUTE_CAPS
from clauseloom.functions.text import preview
from clauseloom.functions.vectors import similarity
from clauseloom.operators.ordered import group_rank, merge_top_k, top_k
from clauseloom.operators.scoring import (
    BLOCK_ROWS,
    Contenders,
    ScoredBlock,
    Scorer,
    pairs,
    place_counts,
    scored_blocks,
    source_best,
    task_best,
)
from clauseloom.operators.sizing import BROADCAST_ROWS, fits
from clauseloom.session import stored

RRF_K = 20
GLOBAL_TOP_K = 20
SOURCE_TOP_K = 15
FUSED_DIGITS = 12  # of fused scores that are told apart
CELL = ["attribute_number", "source_file"]
CANDIDATES = 1_000_000  # rows whose exact ranks are counted together


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _single_ranking(attributes: DataFrame, chunks: DataFrame, ranking: str, score: str, k: int, metric: str) -> DataFrame:
    blocks = scored_blocks(attributes, chunks, metric, lexical=ranking == "bm25")
    best = _union([task_best(block.rows, block.scorer, k, (ranking,)) for block in blocks])
    order = [F.desc(score), F.asc("doc_idx")]
    return merge_top_k(best, ["attribute_number"], order, k).select("attribute_number", "doc_idx", score, "rank")


def dense_top_k(attributes: DataFrame, chunks: DataFrame, k: int = GLOBAL_TOP_K, metric: str = "l2sq") -> DataFrame:
    """The ``k`` most similar chunks of each attribute."""
    return _single_ranking(attributes, chunks, "dense", "dense_similarity", k, metric)


def bm25_top_k(attributes: DataFrame, chunks: DataFrame, k: int = GLOBAL_TOP_K) -> DataFrame:
    """The ``k`` best BM25 chunks of each attribute; chunks scoring 0 outrank negative ones."""
    return _single_ranking(attributes, chunks, "bm25", "bm25_score", k, "l2sq")


def _fused(df: DataFrame, rrf_k: int) -> DataFrame:
    return (
        df.withColumn("rrf_dense", 1.0 / (F.col("dense_rank") + rrf_k))
        .withColumn("rrf_bm25", 1.0 / (F.col("bm25_rank") + rrf_k))
        .withColumn("rrf_score", F.col("rrf_dense") + F.col("rrf_bm25"))
    )


def fused_order() -> list[Column]:
    return [F.round("rrf_score", FUSED_DIGITS).desc(), F.col("doc_idx").asc()]


def rrf_scores(attributes: DataFrame, chunks: DataFrame, rrf_k: int = RRF_K, metric: str = "l2sq") -> DataFrame:
    """Both ranks and the fused score of every (attribute, chunk) pair.

    Needed where the depth of the answer is not bounded.  The narrow pair rows are stored, so that
    every text is scored once, and pass two range shuffles, one per ranking;
    no attribute's list is gathered in one task.  A chunk without a vector gets
    the rank behind the last dense one and similarity 0.0.
    """
    scored = stored(_union([pairs(block.rows, block.scorer) for block in scored_blocks(attributes, chunks, metric)]))
    by_dense = group_rank(
        scored, ["attribute_number"], [F.col("dense_similarity").desc_nulls_last(), F.col("doc_idx").asc()], "dense_rank"
    )
    ranked = group_rank(by_dense, ["attribute_number"], [F.col("bm25_score").desc(), F.col("doc_idx").asc()], "bm25_rank")
    lengths = scored.groupBy("attribute_number").agg(
        F.count("dense_similarity").alias("_dense"), F.count("*").alias("_all")
    )
    if fits(attributes):
        # One row per attribute; a join by attribute would gather whole lists.
        lengths = F.broadcast(lengths)
    behind = F.when(F.col("_dense") > 0, F.col("_dense")).otherwise(F.col("_all")) + 1
    ranked = ranked.join(lengths, "attribute_number").withColumn(
        "dense_rank", F.when(F.col("dense_similarity").isNull(), behind).otherwise(F.col("dense_rank"))
    )
    ranked = ranked.withColumn("dense_similarity", F.coalesce("dense_similarity", F.lit(0.0)))
    return _fused(ranked.drop("_dense", "_all"), rrf_k)


def rrf_top_k(
    attributes: DataFrame, chunks: DataFrame, k: int = GLOBAL_TOP_K, rrf_k: int = RRF_K, metric: str = "l2sq"
) -> DataFrame:
    """The ``k`` best fused chunks of each attribute, without ranking the whole corpus.

    A chunk outside the first ``depth`` places of both lists scores at most
    ``2 / (rrf_k + depth + 1)``.  With ``depth = rrf_k + 2k`` that is below
    ``1 / (rrf_k + k)``, which the first ``k`` chunks of either list exceed, so
    the union of both heads holds every answer.  One pass finds the heads, a
    second one counts how many chunks beat each candidate in either list, which
    gives the exact ranks.  Chunks are never shuffled.
    """
    depth = rrf_k + 2 * k
    results = []
    for block in scored_blocks(attributes, chunks, metric):
        heads = task_best(block.rows, block.scorer, depth)
        heads = merge_top_k(_with_score(heads), ["ranking", "attribute_number"], [F.desc("_score"), F.asc("doc_idx")], depth)
        # At most 2 * depth rows per attribute of the block.
        rows = heads.select("attribute_number", "doc_idx", "dense_similarity", "bm25_score").toArrow().to_pandas()
        rows = rows.drop_duplicates(["attribute_number", "doc_idx"], ignore_index=True)
        results.append(_candidates(chunks, _with_ranks(block, block.scorer, rows)))
    return top_k(_fused(_union(results), rrf_k), ["attribute_number"], fused_order(), k)


def _with_score(heads: DataFrame) -> DataFrame:
    score = F.when(F.col("ranking") == "dense", F.col("dense_similarity")).otherwise(F.col("bm25_score"))
    return heads.withColumn("_score", score)


def _with_ranks(block: ScoredBlock, scorer: Scorer, rows: pd.DataFrame) -> pd.DataFrame:
    """Candidate rows with ``dense_rank``, ``bm25_rank`` and ``behind``, counted over all chunks.

    ``behind`` is the dense rank of a chunk without a vector.
    """
    contenders: dict[tuple[str, int], Contenders] = {}
    order: dict[tuple[str, int], np.ndarray] = {}
    for number, places in rows.groupby("attribute_number").indices.items():
        for ranking, field in (("dense", "dense_similarity"), ("bm25", "bm25_score")):
            score = rows[field].to_numpy(dtype=float)[places]
            usable = places[~np.isnan(score)]
            if len(usable):
                ids, score = rows["doc_idx"].to_numpy()[usable], rows[field].to_numpy(dtype=float)[usable]
                best = np.lexsort((ids, -score))
                contenders[ranking, int(number)] = Contenders(score[best], ids[best])
                order[ranking, int(number)] = usable[best]

    # At most one count for each candidate and two more for each attribute.
    counts = place_counts(block.rows, scorer, contenders).toArrow().to_pandas()
    ranks = {"dense": np.full(len(rows), -1, dtype=np.int64), "bm25": np.full(len(rows), -1, dtype=np.int64)}
    totals: dict[int, int] = {}
    for (ranking, number), found in counts.groupby(["ranking", "attribute_number"]):
        if ranking == "total":
            totals[int(number)] = int(found["chunks"].sum())
            continue
        own = order[ranking, int(number)]
        ahead = np.zeros(len(own) + 1, dtype=np.int64)
        ahead[found["place"].to_numpy()] = found["chunks"].to_numpy()
        # A chunk at place p is behind p candidates, so those at places up to one's own are ahead of it.
        ranks[ranking][own] = np.cumsum(ahead)[: len(own)] + 1
    behind = rows["attribute_number"].map(lambda number: (totals.get(int(number)) or block.stats.documents) + 1)
    behind = behind.to_numpy(dtype=np.int64)
    return rows.assign(
        behind=behind, dense_rank=np.where(ranks["dense"] < 0, behind, ranks["dense"]), bm25_rank=ranks["bm25"]
    )


CANDIDATE_COLUMNS = pa.schema(
    [("attribute_number", pa.int64()), ("doc_idx", pa.int64()), ("dense_similarity", pa.float64()),
     ("bm25_score", pa.float64()), ("dense_rank", pa.int64()), ("bm25_rank", pa.int64())]
)


def _candidates(chunks: DataFrame, rows: pd.DataFrame, extra: tuple[pa.Field, ...] = ()) -> DataFrame:
    rows = rows.assign(dense_similarity=rows["dense_similarity"].fillna(0.0))
    schema = pa.schema([*CANDIDATE_COLUMNS, *extra])
    return chunks.sparkSession.createDataFrame(pa.Table.from_pandas(rows[schema.names], schema, preserve_index=False))


def rrf_per_source(
    attributes: DataFrame, chunks: DataFrame, k: int = SOURCE_TOP_K, rrf_k: int = RRF_K, metric: str = "l2sq",
    limit: int = CANDIDATES,
) -> DataFrame:
    """The ``k`` best fused chunks of each attribute in each source file, by a threshold algorithm.

    Ranks are those among all chunks.  Of every cell (attribute, source) the tasks hand on the
    heads of both rankings, bounded in depth.  One pass counts the exact ranks of their rows.  A
    chunk of the cell in neither head ranks behind the last row of both, which bounds its fused
    score; where the k-th best row beats that bound, the cell is done.  Cells that are not are
    asked again, alone and twice as deep.

    ``limit`` bounds the candidates that are counted together: the dictionary is cut into blocks
    by it.  Where even the cells of one attribute pass it (sources with few chunks each, whose
    heads would be all pairs), and for cells still open at that depth, all pairs of the
    attributes concerned are ranked (``rrf_scores``), with the same result.
    """
    sources = chunks.select("source_file").distinct().count()
    depth = 2 * k
    block_rows = limit // max(2 * depth * sources, 1)
    if not block_rows:
        return _ranked_in_source(rrf_scores(attributes, chunks, rrf_k, metric), k)
    results, open_attributes = [], set()
    for block in scored_blocks(attributes, chunks, metric, block_rows=min(block_rows, BLOCK_ROWS)):
        rows, left = _source_heads(block, k, rrf_k, depth, limit)
        open_attributes |= left
        results.append(_candidates(chunks, rows[~rows["attribute_number"].isin(left)], (pa.field("source_file", pa.string()),)))
    found = _fused(_union(results), rrf_k)
    if open_attributes:
        # Their numbers are bounded by the dictionary's blocks.
        numbers = attributes.sparkSession.createDataFrame([(n,) for n in sorted(open_attributes)], "attribute_number long")
        again = attributes.join(F.broadcast(numbers), "attribute_number", "left_semi")
        full = rrf_scores(again, chunks, rrf_k, metric)
        found = found.unionByName(full.select(found.columns))
    return _ranked_in_source(found, k)


def _ranked_in_source(fused: DataFrame, k: int) -> DataFrame:
    return top_k(fused, ["attribute_number", "source_file"], fused_order(), k, "rank_in_source")


def _source_heads(block: ScoredBlock, k: int, rrf_k: int, depth: int, limit: int) -> tuple[pd.DataFrame, set[int]]:
    """Candidates that hold the ``k`` best of every cell, and the attributes for which that stays unsure."""
    scorer, cells, finished = block.scorer, None, []
    tasks = block.rows.rdd.getNumPartitions()
    while True:
        heads = merge_top_k(
            _with_score(source_best(block.rows, scorer, depth, cells)),
            ["ranking", "attribute_number", "source_file"], [F.desc("_score"), F.asc("doc_idx")], depth, tasks=tasks,
        )
        # At most 2 * depth rows per cell, and no more than limit of them.
        heads = heads.drop("_score", "rank").toArrow().to_pandas()
        rows = heads.drop_duplicates(["attribute_number", "doc_idx"], ignore_index=True).drop(columns="ranking")
        rows = _with_ranks(block, scorer, rows)
        sure = _sure_cells(heads, rows, k, rrf_k, depth)
        cell = pd.MultiIndex.from_frame(rows[["attribute_number", "source_file"]])
        finished.append(_leading(rows[cell.isin(sure[sure].index)], k, rrf_k))
        unsure = sure[~sure].index
        if not len(unsure):
            return pd.concat(finished, ignore_index=True), set()
        depth *= 2
        left = {int(number) for number in unsure.get_level_values(0)}
        if len(unsure) * 2 * depth > limit:
            return pd.concat(finished, ignore_index=True), left
        scorer = scorer.only(left)
        column = {int(number): i for i, number in enumerate(scorer.numbers)}
        wanted: dict[str | None, list[int]] = {}
        for number, source in unsure:
            wanted.setdefault(None if pd.isna(source) else source, []).append(column[int(number)])
        cells = {source: np.array(own) for source, own in wanted.items()}


def _kth_fused(rows: pd.DataFrame, k: int, rrf_k: int) -> pd.Series:
    """For each row the ``k``-th best fused score of its cell; the least, where there are fewer."""
    fused = np.round(1 / (rows["dense_rank"] + rrf_k) + 1 / (rows["bm25_rank"] + rrf_k), FUSED_DIGITS)
    scored = rows[CELL].assign(fused=fused).sort_values("fused", ascending=False)
    first = scored[scored.groupby(CELL, dropna=False).cumcount() < k]
    return rows[CELL].assign(at=np.arange(len(rows))).merge(
        first.groupby(CELL, dropna=False, as_index=False)["fused"].min(), on=CELL
    ).set_index("at")["fused"].reindex(np.arange(len(rows))).set_axis(rows.index)


def _leading(rows: pd.DataFrame, k: int, rrf_k: int) -> pd.DataFrame:
    """The rows that can be among the ``k`` best of their cell; equal scores are told apart later."""
    fused = 1 / (rows["dense_rank"] + rrf_k) + 1 / (rows["bm25_rank"] + rrf_k)
    return rows[fused >= _kth_fused(rows, k, rrf_k) - 10 * 10.0**-FUSED_DIGITS]


def _sure_cells(heads: pd.DataFrame, rows: pd.DataFrame, k: int, rrf_k: int, depth: int) -> pd.Series:
    """For each cell: True where no chunk outside its heads can be among its ``k`` best."""
    ranked = heads.merge(rows[["attribute_number", "doc_idx", "dense_rank", "bm25_rank", "behind"]], on=["attribute_number", "doc_idx"])
    groups = {ranking: ranked[ranked["ranking"] == ranking].groupby(CELL, dropna=False) for ranking in ("dense", "bm25")}
    table = pd.DataFrame(
        {"seen": groups["bm25"].size(), "last_bm25": groups["bm25"]["bm25_rank"].max(), "behind": groups["bm25"]["behind"].max()}
    )
    table["seen_dense"] = groups["dense"].size().reindex(table.index, fill_value=0)
    last_dense = groups["dense"]["dense_rank"].max().reindex(table.index)
    # All vectors of a head that isn't full are known; an unseen chunk then has none.
    next_dense = np.where(table["seen_dense"] >= depth, last_dense + 1, table["behind"])
    bound = np.round(1 / (next_dense + rrf_k) + 1 / (table["last_bm25"] + 1 + rrf_k), FUSED_DIGITS)
    kept = rows[["attribute_number", "source_file"]].assign(kth=_kth_fused(rows, k, rrf_k))
    kept = kept.groupby(CELL, dropna=False)["kth"].first().reindex(table.index)
    # Equal scores go by the chunk's number, so only a clear lead settles a cell.
    return (table["seen"] < depth) | (kept > bound + 10.0**-FUSED_DIGITS)


def format_matches(
    matches: DataFrame,
    chunks: DataFrame,
    attributes: DataFrame,
    preview_length: int = 150,
    per_attribute: int | None = None,
) -> DataFrame:
    """Matches with the chunk's text and metadata and the attribute's name.

    ``per_attribute`` states how many matches an attribute has at most.  When that
    bounds the matches tightly enough they are broadcast and the chunk texts are
    not shuffled.
    """
    if per_attribute is not None and fits(attributes, BROADCAST_ROWS // per_attribute):
        matches = F.broadcast(matches)
    details = chunks.select(
        "doc_idx",
        F.coalesce("page_number", F.lit(0)).cast("int").alias("page"),
        F.coalesce(F.nullif("header_path", F.lit("")), F.lit("No header")).alias("section"),
        F.coalesce("chunk_id", F.lit("")).alias("chunk_id"),
        F.coalesce("source_file", F.lit("unknown")).alias("source_file"),
        preview(F.col("content"), preview_length).alias("content_preview"),
        F.col("content").alias("full_content"),
    )
    if "source_file" in matches.columns:
        matches = matches.drop("source_file")
    names = attributes.select("attribute_number", "attribute_name")
    return details.join(matches, "doc_idx").join(names, "attribute_number")


def match_stats(matches: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Average and best scores per attribute over the kept matches."""
    return matches.groupBy("attribute_number").agg(
        F.count("*").alias("matches"),
        F.avg("rrf_score").alias("avg_rrf_score"),
        F.max("rrf_score").alias("max_rrf_score"),
        F.avg("dense_similarity").alias("avg_dense_score"),
        F.avg("bm25_score").alias("avg_bm25_score"),
        F.count_if(F.col("rrf_score") > threshold).alias("high_rrf_matches"),
    )


def cap_matches(
    matches: DataFrame, rank: str = "rank", caps: Mapping[int, int] = ATTRIBUTE_CAPS
) -> DataFrame:
    """Keep the first matches of each attribute up to its cap; other attributes keep all.

    The rank column already restarts where the cap applies (per attribute, or
    per attribute and source), so no further ranking is needed.
    """
    if not caps:
        return matches
    cap = F.lit(None).cast("int")
    for number, limit in caps.items():
        cap = F.when(F.col("attribute_number") == number, F.lit(limit)).otherwise(cap)
    return matches.where(F.col(rank) <= F.coalesce(cap, F.col(rank)))


def dense_matches(attributes: DataFrame, chunks: DataFrame, k: int = 10, metric: str = "l2sq") -> DataFrame:
    """Dense-only matching with similarities rounded to four digits."""
    return dense_top_k(attributes, chunks, k, metric).select(
        "attribute_number", "doc_idx", F.round("dense_similarity", 4).alias("similarity"), "rank"
    )


def dense_match_stats(matches: DataFrame, threshold: float = 0.7, digits: int = 4) -> DataFrame:
    return matches.groupBy("attribute_number").agg(
        F.round(F.avg("similarity"), digits).alias("avg_similarity"),
        F.max("similarity").alias("max_similarity"),
        F.count_if(F.col("similarity") > threshold).alias("high_confidence_matches"),
    )


def nearest_chunks(chunks: DataFrame, vector: list[float], k: int = 3, metric: str = "l2sq") -> DataFrame:
    """The ``k`` chunks nearest to one query vector."""
    query = F.array(*[F.lit(float(value)) for value in vector])
    scored = chunks.where(F.col("embedding").isNotNull()).select(
        "doc_idx", F.round(similarity(F.col("embedding"), query, metric), 12).alias("similarity")
    ).where("similarity is not null")
    return scored.orderBy(F.desc("similarity"), F.asc("doc_idx")).limit(k)
