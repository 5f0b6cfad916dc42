"""Readers for the file formats the engine exchanges, all with fixed schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom import schemas
from clauseloom.functions.markdown import page_markdown
from clauseloom.functions.text import file_stem, strip

FILE_NAME = "source_file"


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, document_id, value): one row per non-blank markdown file; the id is its path."""
    files = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.where(strip(F.col("value")) != "").select(
        F.col("_metadata.file_name").alias(FILE_NAME), F.col("_metadata.file_path").alias("document_id"), "value"
    )


def _read_rows(spark: SparkSession, path: str, schema: str, pattern: str) -> DataFrame:
    # Unparsable files give rows of NULLs only, which are dropped.
    rows = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", pattern)
        .json(path)
        .withColumn("file_name", F.col("_metadata.file_name"))
    )
    columns = [name for name in rows.columns if name != "file_name"]
    return rows.where(F.coalesce(*[F.when(F.col(name).isNotNull(), F.lit(True)) for name in columns], F.lit(False)))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files, each holding an array of chunks or a single one."""
    return _read_rows(spark, path, schemas.CHUNKS, "*_chunks.json")


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    return _read_rows(spark, path, schemas.ATTRIBUTES, "*.json")


def read_clauses(spark: SparkSession, path: str, contracts_only: bool = False) -> DataFrame:
    """Clause datasets with their file name; optionally only files of redacted contracts."""
    rows = _read_rows(spark, path, schemas.CLAUSES, "*.json")
    return rows.where(F.lower("file_name").contains("redacted")) if contracts_only else rows


def read_similarities(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Ranking results flattened to one row per match, in file order.

    Each file holds one document, or with ``lines`` one document per line.

    Template results list matches per attribute; contract results nest them
    once more per source file.
    """
    documents = spark.read.schema(schemas.SIMILARITY).option("multiLine", not lines).json(path)
    by_attribute = documents.select("collection_info", F.explode("matches").alias("attribute_name", "found"))
    listed = F.coalesce("found.top_matches", "found.matches")
    base = [
        F.col("collection_info.collection_key").alias("collection_key"),
        F.col("collection_info.collection_name").alias("collection_name"),
        F.col("found.attribute_info.number").try_cast("int").alias("attribute_number"),
        F.col("attribute_name"),
    ]
    templates = by_attribute.select(*base, F.posexplode(listed).alias("position", "match"))
    contracts = by_attribute.select(
        *base, F.explode("found.per_source_top_matches").alias("_source", "_matches")
    ).select(
        "collection_key", "collection_name", "attribute_number", "attribute_name", F.posexplode("_matches").alias("position", "match")
    )
    return templates.unionByName(contracts).select(
        "collection_key",
        "collection_name",
        "attribute_number",
        "attribute_name",
        (F.col("position") + 1).alias("position"),
        "match.rank",
        "match.rank_in_global",
        "match.page",
        "match.section",
        "match.chunk_id",
        "match.source_file",
        "match.rrf_score",
        "match.score_breakdown.dense_similarity",
        "match.score_breakdown.bm25_score",
        "match.content_preview",
        F.col("match.full_content").alias("full_content_raw"),
    )


def read_metrics(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The dashboard metrics file as tables: clauses, contracts, attributes, corpus, timings."""
    document = spark.read.schema(schemas.METRICS).option("multiLine", True).json(path)
    return {
        "corpus": document.select("corpus.*"),
        "clauses": document.select(F.inline("clauses")),
        "contracts": document.select(F.inline("contracts")),
        "attributes": document.select(F.explode("attributes").alias("attribute", "value")).select("attribute", "value.*"),
        "timings": document.select(F.explode("processing.timings").alias("contract_id", "seconds")),
    }


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """An attribute sheet with a header row; ``row_index`` is the 0-based data row.

    CSV is read by Spark.  A workbook needs pandas' Excel support on the driver;
    such a sheet is a small, hand-written file.
    """
    if path.endswith((".xls", ".xlsx")):
        frame = pd.read_excel(path)
        frame = frame.astype(object).where(frame.notna(), None)
        frame.columns = [str(name) for name in frame.columns]
        frame.insert(0, "row_index", range(len(frame)))
        columns = ", ".join(f"`{name}` string" for name in frame.columns[1:])
        rows = [
            tuple([row[0], *[None if value is None else str(value) for value in row[1:]]])
            for row in frame.itertuples(index=False)
        ]
        return spark.createDataFrame(rows, f"row_index long, {columns}")
    # One small file read by one task keeps its row order.
    sheet = spark.read.option("header", True).option("multiLine", True).csv(path)
    return sheet.select(F.monotonically_increasing_id().alias("row_index"), *[F.col(f"`{name}`") for name in sheet.columns])


PageParser = Callable[[str, bytes], Iterable[tuple[int, list[str], bool]]]


def parse_documents(spark: SparkSession, path: str, parser: PageParser) -> DataFrame:
    """(source_file, page_number, value) from binary documents.

    ``parser(name, content)`` yields (page number, text blocks, came from OCR)
    and runs inside the tasks, one document at a time.  Large files that were cut
    into batches of pages come back together by ``chunking.recombine_batches``.
    """
    files = spark.read.format("binaryFile").load(path)

    def parse(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"]):
                rows = [(name, number, list(blocks), ocr) for number, blocks, ocr in parser(name, content)]
                if rows:
                    yield pd.DataFrame(rows, columns=["source_file", "page_number", "blocks", "ocr"])

    schema = "source_file string, page_number int, blocks array<string>, ocr boolean"
    parsed = files.select(F.col("_metadata.file_name").alias("name"), "content").mapInPandas(parse, schema)
    return parsed.select("source_file", "page_number", page_markdown(F.col("page_number"), F.col("blocks"), F.col("ocr")).alias("value"))


def not_processed(inputs: DataFrame, outputs: DataFrame, suffix: str = "") -> DataFrame:
    """Inputs whose stem has no output yet."""
    done = outputs.select(F.concat(file_stem(F.col("source_file")), F.lit(suffix)).alias("_stem")).distinct()
    return inputs.withColumn("_stem", F.concat(file_stem(F.col("source_file")), F.lit(suffix))).join(done, "_stem", "left_anti").drop("_stem")
