"""Writers. Partitioned tables are the default; JSON trees are built only here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.text import file_slug, file_stem
from clauseloom.operators.report import table_text
from clauseloom.sources.named_files import write_named
from clauseloom.sources.versions import Version, append_rows, replace_collections


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk rows as JSON, one file ``<stem>_chunks.json`` per source file; ``read_chunks`` reads them.

    The order in a file is that of the chunk's index, where there is one, then of its id.
    """
    order = [name for name in ("chunk_index", "chunk_id") if name in chunks.columns]
    values = F.to_json(F.struct(*chunks.columns)).alias("value")
    write_named(chunks.select(file_stem(F.col("source_file")).alias("file"), values, *order), path, order, "_chunks.json")


def replace_collection(rows: DataFrame, path: str, key: str = "row_id") -> Version:
    """Replace the collections present in ``rows`` at once; other collections stay.  ``read_collections`` reads them."""
    return replace_collections(rows, path, key)


def add_to_collection(rows: DataFrame, path: str, key: str = "row_id") -> Version:
    """Append rows whose id the table does not hold yet; rows without a vector are left out."""
    return append_rows(rows.where(F.size("embedding") > 0), path, key)


def write_datasets(clauses: DataFrame, path: str) -> None:
    """Clauses as JSON, one file per collection and source slug; ``read_clauses`` reads them."""
    name = F.concat("collection_key", F.lit("_"), file_slug(F.col("source_file")), F.lit("_dataset"))
    value = F.to_json(F.struct(*clauses.columns)).alias("value")
    write_named(clauses.select(name.alias("file"), value, "chunk_id"), path, ["chunk_id"])


def write_classified(classified: DataFrame, path: str, standard_path: str) -> None:
    """All classified clauses, and the standard ones on their own. Inputs are never rewritten."""
    classified.write.mode("overwrite").partitionBy("contract").parquet(path)
    written = classified.sparkSession.read.parquet(path)
    written.where(F.col("is_standard") == 1).write.mode("overwrite").partitionBy("contract").parquet(standard_path)


def match_struct(rank: str) -> Column:
    breakdown = F.struct(
        "dense_similarity",
        "bm25_score",
        "dense_rank",
        "bm25_rank",
        F.col("rrf_dense").alias("rrf_contribution_dense"),
        F.col("rrf_bm25").alias("rrf_contribution_bm25"),
    )
    return F.struct(
        F.col(rank).alias(rank),
        "rrf_score",
        "page",
        "section",
        "chunk_id",
        "source_file",
        "content_preview",
        "full_content",
        breakdown.alias("score_breakdown"),
    )


def similarity_documents(matches: DataFrame, stats: DataFrame, rank: str, per_source: bool = False) -> DataFrame:
    """One JSON value per attribute, or per attribute and source.

    Each value holds at most the top-k matches of its key, whatever the number
    of sources.
    """
    keys = ["attribute_number", "attribute_name"] + (["source_file"] if per_source else [])
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("_order"), match_struct(rank).alias("match"))))
    listed = matches.groupBy(*keys).agg(F.transform(ordered, lambda row: row["match"]).alias("top_matches"))
    tree = F.struct(
        F.struct(F.col("attribute_number").alias("number"), F.col("attribute_name").alias("name")).alias("attribute_info"),
        F.struct(*[name for name in stats.columns if name != "attribute_number"]).alias("statistics"),
        F.col("top_matches"),
    )
    return listed.join(stats, "attribute_number").select(*keys, F.to_json(tree).alias("document"))


def collection_documents(
    matches: DataFrame, stats: DataFrame, rank: str, key: str, name: str, top_k: int, per_source: bool = False
) -> DataFrame:
    """(attribute_number, document): the layout that ``read_similarities`` reads, one document per attribute.

    Each has ``collection_info`` and a ``matches`` map with the attribute's entry: its
    info, statistics, and the matches in order, per source if asked.
    """
    entry = F.struct(F.col(rank).alias("_order"), match_struct(rank).withField("rank", F.col(rank)).alias("match"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda row: row["match"])
    by = ["attribute_number", "attribute_name"]
    if per_source:
        listed = matches.groupBy(*by, "source_file").agg(ordered.alias("found")).groupBy(*by).agg(
            F.map_from_entries(F.collect_list(F.struct("source_file", "found"))).alias("per_source_top_matches")
        )
    else:
        listed = matches.groupBy(*by).agg(ordered.alias("top_matches"))
    mode = "per_source" if per_source else "global"
    info = F.struct(
        F.lit(key).alias("collection_key"), F.lit(name).alias("collection_name"), F.lit(mode).alias("mode"), F.lit(top_k).alias("top_k")
    )
    found = F.struct(
        F.struct(F.col("attribute_number").alias("number"), F.col("attribute_name").alias("name")).alias("attribute_info"),
        F.struct(*[column for column in stats.columns if column != "attribute_number"]).alias("statistics"),
        listed.columns[-1],
    )
    tree = F.struct(info.alias("collection_info"), F.create_map(F.col("attribute_name"), found).alias("matches"))
    return listed.join(stats, "attribute_number").select("attribute_number", F.to_json(tree).alias("document"))


def write_similarities(documents: DataFrame, path: str) -> None:
    """Documents as JSON lines; ``read_similarities`` reads them with ``lines=True``."""
    documents.select("document").write.mode("overwrite").text(path)


def write_markdown_pages(pages: DataFrame, path: str) -> None:
    """Page texts in page order, one file ``<stem>.md`` per source file; ``read_markdown`` reads them."""
    named = pages.select(file_stem(F.col("source_file")).alias("file"), "value", "page_number")
    write_named(named, path, ["page_number"], ".md", "text")


def dense_report(matches: DataFrame, stats: DataFrame, top: int = 3) -> str:
    """Markdown tables of the dense-only matcher: one line per attribute, then the best matches."""
    best = matches.where(F.col("rank") <= top).select("attribute_number", "rank", "doc_idx", "similarity").collect()
    summary = stats.select("attribute_number", "avg_similarity", "max_similarity", "high_confidence_matches").collect()
    parts = [
        table_text("Dense ranking by attribute", ("attribute", "mean", "best", "confident"), sorted(map(tuple, summary))),
        table_text("Best chunks", ("attribute", "place", "chunk", "similarity"), sorted(map(tuple, best))),
    ]
    return "\n".join(part for part in parts if part)


def match_report(matches: DataFrame, stats: DataFrame, rank: str = "rank", top: int = 3, digits: int = 6) -> str:
    """Markdown tables of the fused ranking: one line per attribute, then the best ``top`` matches.

    Only ``top`` rows per attribute of the dictionary are collected.
    """
    shown = lambda name: F.format_string(f"%.{digits}f", name).alias(name)
    means = ("avg_rrf_score", "max_rrf_score", "avg_dense_score", "avg_bm25_score")
    summary = stats.select("attribute_number", *map(shown, means), "high_rrf_matches").collect()
    columns = ("attribute_number", "attribute_name", rank, "page", "section", shown("rrf_score"), "dense_rank", "bm25_rank", "content_preview")
    best = matches.where(F.col(rank) <= top).select(*columns).collect()
    parts = [
        table_text("Fused ranking by attribute", ("attribute", "mean", "best", "dense mean", "BM25 mean", "strong"), sorted(map(tuple, summary))),
        table_text(
            "Best chunks", ("attribute", "name", "place", "page", "section", "score", "dense place", "BM25 place", "text"),
            sorted(map(tuple, best), key=lambda row: (row[0], row[2])),
        ),
    ]
    return "\n".join(part for part in parts if part)
