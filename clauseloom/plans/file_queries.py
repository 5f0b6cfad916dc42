"""Queries that write files to the shared folder and read them again, and streams over them, with their SQL twins."""

from __future__ import annotations

import re
import uuid
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import markdown
from clauseloom.functions.text import strip, token_count
from clauseloom.operators import clauses
from clauseloom.plans import driver_tables as tables
from clauseloom.plans.oracles import CLASSIFIED, CLAUSES, MESSAGES, _preprocess, _strip, _words
from clauseloom.plans.pipeline import STEPS, Pipeline
from clauseloom.session import ensure_checkpoint_dir
from clauseloom.sources import scans, sinks
from clauseloom.sources.named_files import write_named
from clauseloom.streaming.ingest import keep_histories, latest_histories, session_histories, stateful_session

PAGES_PER_FILE = 200
CLAUSES_PER_DOCUMENT = 500
KEPT_MESSAGES = 3
SESSIONS_PER_STORE = 20_000


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return tables.spread(tables.table(spark, folder, "documents"), "doc_id")


def _long(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def markdown_roundtrip(spark, folder):
    """Documents as pages of markdown files, read and split into pages again."""
    path = _folder(spark, "markdown")
    number = F.col("doc_id").cast("int")
    pages = _documents(spark, folder).select(
        F.concat(F.lit("pages_"), F.floor(number / PAGES_PER_FILE).cast("string"), F.lit(".pdf")).alias("source_file"),
        number.alias("page_number"),
        markdown.page_markdown(number, F.array("text"), F.lit(False)).alias("value"),
    )
    sinks.write_markdown_pages(pages, path)
    read = scans.read_markdown(spark, path).select(_file("source_file", ".md"), F.inline(markdown.pages(F.col("value"))))
    return read.select("file", _long("page_number"), F.sha2(strip(F.col("content")), 256).alias("content_sha"))


def _file(name: str, suffix: str) -> Column:
    """The name that a file or its piece was written for."""
    return F.regexp_replace(name, rf"(\.[0-9]{{4,}})?{re.escape(suffix)}$", "").alias("file")


def chunks_roundtrip(spark, folder):
    """Chunk files per source, written as arrays of JSON and read again."""
    path = _folder(spark, "chunks")
    rows = _documents(spark, folder).select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.floor(F.col("n_chars") / 1000).cast("int").alias("page_number"),
        F.concat(F.lit("section:"), F.col("lang")).alias("header_path"),
        F.col("doc_id").cast("int").alias("chunk_index"),
        F.col("text").alias("content"),
        token_count(F.col("text")).cast("int").alias("token_count"),
        F.concat("source", F.lit(".md")).alias("source_file"),
        F.lit("contract").alias("document_type"),
    )
    sinks.write_chunks(rows, path)
    return scans.read_chunks(spark, path).select(
        _file("file_name", "_chunks.json"), "chunk_id", _long("page_number"), "header_path", _long("chunk_index"),
        F.sha2("content", 256).alias("content_sha"), _long("token_count"), "source_file", "document_type",
    )


def attributes_roundtrip(spark, folder):
    """The attribute dictionary as JSON files of one attribute definition each hundred numbers, read again."""
    path = _folder(spark, "attributes")
    rows = tables.attributes(spark, folder).select(
        F.concat(F.lit("attribute_"), F.col("attribute_number").cast("string")).alias("chunk_id"),
        F.col("attribute_number").cast("int").alias("attribute_number"),
        "attribute_name",
        "content",
        token_count(F.col("content")).cast("int").alias("token_count"),
        F.lit("dictionary.csv").alias("source_file"),
        F.lit("attribute_definition").alias("document_type"),
    )
    file = F.concat(F.lit("attributes_"), F.floor(F.col("attribute_number") / 100).cast("string")).alias("file")
    written = rows.select(file, F.to_json(F.struct(*rows.columns)).alias("value"), "attribute_number")
    write_named(written, path, ["attribute_number"])
    return scans.read_attributes(spark, path).select(
        _file("file_name", ".json"), _long("attribute_number"), "attribute_name", F.sha2("content", 256).alias("content_sha"),
        _long("token_count"), "document_type",
    )


def _metadata_rows(spark: SparkSession, folder: str) -> DataFrame:
    marked = F.replace(F.col("raw_text"), F.lit(" of "), F.lit(" [Redacted] "))
    rows = tables.clauses(spark, folder).select(
        "collection_key", "attribute_number", "attribute_name", F.concat("contract", F.lit(".v1.md")).alias("source_file"),
        F.floor(F.col("n_chars") / 1000).cast("int").alias("page"), F.concat(F.lit("section:"), F.col("state")).alias("section"),
        F.concat(F.lit("c"), F.col("clause_id").cast("string")).alias("chunk_id"), (F.col("n_chars") / 8).alias("rrf_score"),
        (F.col("n_chars") / 4).alias("bm25_score"), marked.alias("full_content_raw"),
        F.col("is_standard").cast("int").alias("isStandard"),
    )
    return clauses.enrich(rows)


def clause_metadata(spark, folder):
    """The flat columns that are stored next to a clause's vector."""
    return clauses.metadata(_metadata_rows(spark, folder), "table").select(
        "collection_key", _long("attribute_number"), "attribute_name", "source_file", _long("page"), "section", "chunk_id",
        "rrf_score", "bm25_score", _long("preprocessed_token_count"), "has_redaction", "preprocessed_sha256", "embedding_type",
        "embedding_source",
    )


def datasets_roundtrip(spark, folder):
    """Clause datasets per collection and source, written as arrays of JSON; those of contracts are read again."""
    path = _folder(spark, "datasets")
    sinks.write_datasets(_metadata_rows(spark, folder), path)
    return scans.read_clauses(spark, path, contracts_only=True).select(
        _file("file_name", ".json"), "chunk_id", "collection_key", _long("attribute_number"), _long("page"), "rrf_score",
        _long("isStandard"), "preprocessed_sha256", F.sha2("full_content_raw", 256).alias("content_sha"),
    )


def classified_roundtrip(spark, folder):
    """The cascade's clauses as one table, and the standard ones as another, both read again."""
    path = _folder(spark, "classified")
    sinks.write_classified(tables.classified(spark, folder), f"{path}/all", f"{path}/standard")
    read = [
        spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("kind"), "contract", "clause_id", _long("is_standard"), "classification_step")
        for name in ("all", "standard")
    ]
    return read[0].unionByName(read[1])


def metrics_roundtrip(spark, folder):
    """Metrics documents of at most 500 clauses each, one file per contract, read as a table of clauses."""
    path = _folder(spark, "metrics")
    clause = F.struct(
        F.concat(F.lit("doc_"), F.col("clause_id").cast("string")).alias("chunk_id"),
        F.concat(F.lit("contract_"), F.col("contract")).alias("contract_id"),
        F.col("attribute_name").alias("assigned_attribute"),
        token_count(F.col("raw_text")).cast("int").alias("token_length"),
        (F.col("n_chars") / 8).alias("similarity"),
    )
    bucket = F.floor(F.col("clause_id") / CLAUSES_PER_DOCUMENT).alias("bucket")
    listed = tables.clauses(spark, folder).groupBy("contract", bucket).agg(F.collect_list(clause).alias("clauses"))
    written = listed.select(F.col("contract").alias("file"), F.to_json(F.struct("clauses")).alias("value"), "bucket")
    write_named(written, path, ["bucket"])
    found = scans.read_metrics(spark, path)["clauses"]
    return found.select("chunk_id", "contract_id", "assigned_attribute", _long("token_length"), "similarity")


def session_stream(spark, folder):
    """Messages arrive as a stream of files, some sessions are cleared; the last three messages of each session."""
    path = _folder(spark, "sessions")
    told = tables.messages(spark, folder).select(
        F.col("session_id").cast("string").alias("session_id"), F.col("seq").cast("long").alias("seq"), "role", F.col("text").alias("content")
    )
    # Every third session is cleared up to its message 1, whenever that event arrives.
    cleared = told.where((F.col("session_id").cast("long") % 3 == 0) & (F.col("seq") == 1)).withColumn("role", F.lit("clear"))
    events = told.unionByName(cleared).repartition(3, "seq", "role")
    events.write.parquet(f"{path}/events")
    sessions = told.agg(F.approx_count_distinct("session_id")).first()[0]
    own = stateful_session(spark, 1 + sessions // SESSIONS_PER_STORE)
    stream = own.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/events")
    keep_histories(session_histories(stream, KEPT_MESSAGES), f"{path}/snapshots", f"{path}/state").awaitTermination()
    snapshots = spark.read.parquet(f"{path}/snapshots")
    return latest_histories(snapshots).select(_long("session_id"), "seq", "role", "content")


def resumed_chain(spark, folder):
    """Rank, prepare, classify and summarise four collections, then again with another limit: the ranking stands.

    The summary of the second run, next to whether its ranked and classified tables were made again.
    """
    vectors = tables.table(spark, folder, "embeddings").select(
        F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("chunk_id"), "embedding"
    )

    def stored_vectors(rows: DataFrame) -> DataFrame:
        return rows.join(vectors, "chunk_id", "left")

    path = _folder(spark, "chain")
    chunks = tables.chunks(spark, folder).withColumn("collection_key", tables.collection_key(F.col("state"))).drop("state")
    run = partial(Pipeline, spark, path, metric="cosine", embedder=stored_vectors)
    first = run()
    first.store("chunks", chunks)
    first.store("attributes", tables.attributes(spark, folder))
    chain = (chunks, None, ("TNstandard", "WAstandard"), ("TNredacted", "WAredacted"), STEPS[1:])
    first.run(*chain)
    again = run(thresholds=tables.CASCADE_THRESHOLDS)
    summary = again.run(*chain)
    made = [F.lit(any(name.startswith(step) for name in again.made)).alias(f"{step}_again") for step in ("matches", "classified")]
    return summary.select("*", *made)


FILE_QUERIES = {
    "resumed_chain": resumed_chain,
    "markdown_roundtrip": markdown_roundtrip,
    "chunks_roundtrip": chunks_roundtrip,
    "attributes_roundtrip": attributes_roundtrip,
    "clause_metadata": clause_metadata,
    "datasets_roundtrip": datasets_roundtrip,
    "classified_roundtrip": classified_roundtrip,
    "metrics_roundtrip": metrics_roundtrip,
    "session_stream": session_stream,
}

_MARKED = "replace(raw_text, ' of ', ' [Redacted] ')"
_METADATA = f"""{CLAUSES}, m AS (SELECT *, {_MARKED} AS raw, {_preprocess(_MARKED)} AS t FROM clauses)"""

FILE_ORACLES = {
    "markdown_roundtrip": f"""SELECT 'pages_' || (doc_id // {PAGES_PER_FILE}) AS file, doc_id::BIGINT AS page_number,
  sha256({_strip("coalesce(text, '')")}) AS content_sha FROM documents""",
    "chunks_roundtrip": f"""SELECT source AS file, 'c' || doc_id AS chunk_id, (n_chars // 1000)::BIGINT AS page_number,
  'section:' || lang AS header_path, doc_id::BIGINT AS chunk_index, sha256(text) AS content_sha,
  len({_words('text')})::BIGINT AS token_count, source || '.md' AS source_file, 'contract' AS document_type FROM documents""",
    "attributes_roundtrip": f"""SELECT 'attributes_' || ((item_id + 1) // 100) AS file, (item_id + 1)::BIGINT AS attribute_number,
  'attribute_' || (item_id + 1) AS attribute_name, sha256(text) AS content_sha, len({_words('text')})::BIGINT AS token_count,
  'attribute_definition' AS document_type FROM benchmark""",
    "clause_metadata": f"""WITH {_METADATA} SELECT collection_key, attribute_number::BIGINT AS attribute_number,
  'attribute_' || attribute_number AS attribute_name, contract || '.v1.md' AS source_file, (n_chars // 1000)::BIGINT AS page,
  'section:' || state AS section, 'c' || clause_id AS chunk_id, n_chars / 8.0::DOUBLE AS rrf_score,
  n_chars / 4.0::DOUBLE AS bm25_score, len({_words('t')})::BIGINT AS preprocessed_token_count,
  contains(raw, '[Redacted]') AS has_redaction, sha256(t) AS preprocessed_sha256, 'table' AS embedding_type,
  'processed_dataset' AS embedding_source FROM m""",
    "datasets_roundtrip": f"""WITH {_METADATA} SELECT collection_key || '_' || contract || '_v1_dataset' AS file,
  'c' || clause_id AS chunk_id, collection_key, attribute_number::BIGINT AS attribute_number,
  (n_chars // 1000)::BIGINT AS page, n_chars / 8.0::DOUBLE AS rrf_score, is_standard::BIGINT AS "isStandard",
  sha256(t) AS preprocessed_sha256, sha256(raw) AS content_sha FROM m WHERE contains(lower(collection_key), 'redacted')""",
    "classified_roundtrip": f"""WITH {CLASSIFIED} SELECT 'all' AS kind, contract, clause_id, is_standard::BIGINT AS is_standard,
  classification_step FROM classified
UNION ALL SELECT 'standard', contract, clause_id, is_standard::BIGINT, classification_step FROM classified WHERE is_standard = 1""",
    "metrics_roundtrip": f"""WITH {CLAUSES} SELECT 'doc_' || clause_id AS chunk_id, 'contract_' || contract AS contract_id,
  'attribute_' || attribute_number AS assigned_attribute, len({_words('raw_text')})::BIGINT AS token_length,
  n_chars / 8.0::DOUBLE AS similarity FROM clauses""",
    "session_stream": f"""WITH {MESSAGES} SELECT session_id::BIGINT AS session_id, seq::BIGINT AS seq, role, text AS content FROM msg
WHERE NOT (session_id % 3 = 0 AND seq <= 1)
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= {KEPT_MESSAGES}""",
}
