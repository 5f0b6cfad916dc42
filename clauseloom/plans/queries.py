"""Every operator as a query over the test tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseloom.functions import markdown, text, vectors
from clauseloom.functions.lexicon import ATTRIBUTE_TERMS, CHUNK_CONTENT_TERMS, RULE_PATTERNS
from clauseloom.operators import charts, chunking, classify, clauses, lexical, postings, ranking, report, search
from clauseloom.operators.nearest import nearest_template
from clauseloom.operators.ordered import top_k
from clauseloom.operators.sizing import fits
from clauseloom.plans import driver_tables as tables
from clauseloom.session import ensure_checkpoint_dir
from clauseloom.sources import versions
from clauseloom.sources.scans import not_processed, read_similarities
from clauseloom.sources.sinks import collection_documents, similarity_documents, write_similarities
from clauseloom.streaming.ingest import ingest, stream_chunks

Query = Callable[[SparkSession, str], DataFrame]

CAPS = {1: 7, 2: 7, 3: 3, 4: 5, 5: 5}
QUERY_TEXT = "of Attention to que"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return tables.spread(tables.table(spark, folder, "documents"), "doc_id")


def _long(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def _six(name: str) -> Column:
    """Scores are shown with six digits; they are ranked with twelve."""
    return F.round(name, 6).alias(name)


# --- ranking -------------------------------------------------------------------


def corpus_counts(spark, folder):
    attributes, chunks = tables.attributes(spark, folder), tables.chunks(spark, folder)
    terms = lexical.query_terms(attributes)
    return lexical.corpus_counts(chunks, terms, small=fits(terms))


def bm25_scores(spark, folder):
    found = lexical.bm25_scores(tables.attributes(spark, folder), tables.chunks(spark, folder))
    return found.withColumn("bm25_score", _six("bm25_score"))


def bm25_topk(spark, folder):
    found = ranking.bm25_top_k(tables.attributes(spark, folder), tables.chunks(spark, folder))
    return found.select("attribute_number", "doc_idx", _six("bm25_score"), _long("rank"))


def _postings(spark, folder) -> postings.PostingsIndex:
    """An index of the chunks, written to the shared folder and opened from there."""
    path = f"{ensure_checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"
    return postings.write_index(tables.chunk_texts(spark, folder), path, block=256)


def bm25_index_topk(spark, folder):
    found = postings.bm25_top_k(_postings(spark, folder), tables.attributes(spark, folder)).top
    return found.select("attribute_number", "doc_idx", _six("bm25_score"), _long("rank"))


def bm25_index_skipping(spark, folder):
    """Blocks that hold a word of the attribute, and those of them that the bounds leave to be scored."""
    found = postings.bm25_top_k(_postings(spark, folder), tables.attributes(spark, folder), k=1).blocks
    return found.select("attribute_number", "blocks", "scored")


def dense_topk(spark, folder):
    found = ranking.dense_top_k(tables.attributes(spark, folder), tables.chunks(spark, folder))
    return found.select("attribute_number", "doc_idx", _six("dense_similarity"), _long("rank"))


def _scaled(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Attributes and chunks whose vectors have other lengths than one, zero among them."""
    times = lambda factor: F.transform("embedding", lambda x: x.cast("double") * factor)
    attributes = tables.attributes(spark, folder).withColumn("embedding", times(F.col("attribute_number") % 3 + 1))
    return attributes, tables.chunks(spark, folder).withColumn("embedding", times(F.col("doc_idx") % 4))


def dense_topk_scaled(spark, folder, metric="l2sq"):
    found = ranking.dense_top_k(*_scaled(spark, folder), metric=metric)
    return found.select("attribute_number", "doc_idx", _six("dense_similarity"), _long("rank"))


def nearest_template_scaled(spark, folder, metric="l2sq"):
    """Scaled vectors, every clause twice under one id; both plans, told apart by ``plan``."""
    templates, candidates = tables.templates_and_candidates(tables.clauses(spark, folder))
    scaled = lambda name: F.transform("embedding", lambda x: x.cast("double") * (F.col(name) % 4))
    templates = templates.withColumn("embedding", scaled("template_id"))
    once = candidates.withColumn("embedding", scaled("clause_id"))
    again = once.withColumn("embedding", F.reverse("embedding"))
    cell = ["state", "attribute_number"]
    frames = []
    for plan, sizes in (("broadcast", {}), ("blocks", {"broadcast_limit": 0, "template_block": 8, "clause_block": 16})):
        found = nearest_template(once.unionByName(again), templates, cell, metric, **sizes)
        frames.append(found.select(F.lit(plan).alias("plan"), "clause_id", _six("similarity"), "template_id"))
    return frames[0].unionByName(frames[1])


def _fused_columns(found: DataFrame, *extra: str) -> DataFrame:
    return found.select(
        "attribute_number",
        "doc_idx",
        *extra,
        _six("dense_similarity"),
        _six("bm25_score"),
        "dense_rank",
        "bm25_rank",
        F.round("rrf_score", 10).alias("rrf_score"),
    )


def rrf_topk(spark, folder):
    found = ranking.rrf_top_k(tables.attributes(spark, folder), tables.chunks(spark, folder))
    return _fused_columns(found.withColumn("rank", _long("rank")), "rank")


def rrf_all_in_one(spark, folder):
    found = ranking.rrf_top_k(tables.attributes(spark, folder), tables.chunks(spark, folder), k=10, rrf_k=60)
    return _fused_columns(found.withColumn("rank", _long("rank")), "rank")


def rrf_scores(spark, folder):
    return _fused_columns(ranking.rrf_scores(tables.attributes(spark, folder), tables.chunks(spark, folder)))


def _per_source(spark, folder):
    return ranking.rrf_per_source(tables.attributes(spark, folder), tables.chunks(spark, folder))


def rrf_per_source_topk(spark, folder):
    found = _per_source(spark, folder).withColumn("rank_in_source", _long("rank_in_source"))
    return _fused_columns(found, "source_file", "rank_in_source")


def format_matches(spark, folder):
    attributes, chunks = tables.attributes(spark, folder), tables.chunks(spark, folder)
    found = ranking.format_matches(ranking.rrf_top_k(attributes, chunks), chunks, attributes, per_attribute=20)
    return found.select(
        "attribute_number", "attribute_name", _long("rank"), "chunk_id", "source_file", _long("page"), "section",
        "content_preview", text.sha256(F.col("full_content")).alias("content_sha"),
    )


def _stats(stats: DataFrame) -> DataFrame:
    rounded = [
        F.round(name, 8).alias(name) for name in ("avg_rrf_score", "max_rrf_score", "avg_dense_score", "avg_bm25_score")
    ]
    return stats.select("attribute_number", "matches", *rounded, "high_rrf_matches")


def match_stats(spark, folder):
    return _stats(ranking.match_stats(ranking.rrf_top_k(tables.attributes(spark, folder), tables.chunks(spark, folder))))


def per_source_match_stats(spark, folder):
    return _stats(ranking.match_stats(_per_source(spark, folder)))


def attribute_caps(spark, folder):
    kept = ranking.cap_matches(_per_source(spark, folder), "rank_in_source", CAPS)
    return kept.select("attribute_number", "source_file", "doc_idx", _long("rank_in_source"))


def dense_only_matcher(spark, folder):
    found = ranking.dense_matches(tables.attributes(spark, folder), tables.chunks(spark, folder))
    return found.select("attribute_number", "doc_idx", "similarity", _long("rank"))


def dense_only_stats(spark, folder):
    matches = ranking.dense_matches(tables.attributes(spark, folder), tables.chunks(spark, folder))
    # Means of ten four-digit values often lie exactly between two four-digit ones.
    return ranking.dense_match_stats(matches, digits=6)


def nearest_three(spark, folder):
    found = ranking.nearest_chunks(tables.chunks(spark, folder), [(-1.0) ** i / 8 for i in range(64)])
    return found.withColumn("similarity", _six("similarity"))


def similarity_json(spark, folder):
    attributes, chunks = tables.attributes(spark, folder), tables.chunks(spark, folder)
    matches = ranking.format_matches(ranking.rrf_top_k(attributes, chunks), chunks, attributes, per_attribute=20)
    documents = similarity_documents(matches, ranking.match_stats(matches), "rank")
    return documents.select("attribute_number", "attribute_name", "document")


def _written_and_read(documents: DataFrame) -> DataFrame:
    """The matches of similarity documents after a round trip through files in the shared folder."""
    spark = documents.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/similarities-{uuid.uuid4().hex}"
    write_similarities(documents, path)
    return read_similarities(spark, path, lines=True).select(
        "collection_key", _long("attribute_number"), "attribute_name", _long("position"), _long("rank"), "chunk_id", "source_file",
        F.round("rrf_score", 10).alias("rrf_score"), _six("dense_similarity"), _six("bm25_score"),
    )


def collection_versions(spark, folder):
    """Replace, append and replace again in one table, then read its newest and its first version."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/collections-{uuid.uuid4().hex}"
    rows = _documents(spark, folder).select(
        F.col("doc_id").cast("string").alias("row_id"), F.col("source").alias("collection_key"), "lang", _long("n_chars")
    )
    versions.replace_collections(rows.where("lang <> 'de'"), path)
    # Ids that are held stay as they are, whatever the appended rows say.
    versions.append_rows(rows.withColumn("n_chars", -F.col("n_chars")), path)
    second = rows.where(F.col("collection_key").rlike("[02468]$")).withColumn("n_chars", 2 * F.col("n_chars"))
    versions.replace_collections(second, path)
    newest = versions.read_collections(spark, path).withColumn("version", F.lit("newest"))
    return newest.unionByName(versions.read_collections(spark, path, 1).withColumn("version", F.lit("first")))


def similarity_roundtrip(spark, folder):
    attributes, chunks = tables.attributes(spark, folder), tables.chunks(spark, folder)
    matches = ranking.format_matches(ranking.rrf_top_k(attributes, chunks), chunks, attributes, per_attribute=20)
    return _written_and_read(collection_documents(matches, ranking.match_stats(matches), "rank", "tables", "Tables", 20))


def similarity_roundtrip_per_source(spark, folder):
    attributes, chunks = tables.attributes(spark, folder), tables.chunks(spark, folder)
    matches = ranking.format_matches(ranking.rrf_per_source(attributes, chunks, k=2), chunks, attributes, per_attribute=None)
    stats = ranking.match_stats(matches)
    return _written_and_read(collection_documents(matches, stats, "rank_in_source", "tables", "Tables", 2, per_source=True))


# --- text ------------------------------------------------------------------------


def tokens(spark, folder):
    found = text.tokens(F.col("text"))
    return _documents(spark, folder).select(
        "doc_id", F.size(found).cast("long").alias("tokens"), F.sha2(F.array_join(found, " "), 256).alias("token_sha")
    )


def clean_text(spark, folder):
    return _documents(spark, folder).select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


def preprocess_text(spark, folder):
    return _documents(spark, folder).select("doc_id", text.preprocess_text(F.col("text")).alias("preprocessed"))


def token_counts(spark, folder):
    return _documents(spark, folder).select("doc_id", text.token_count(F.col("text")).cast("long").alias("token_count"))


def lemma_rules(spark, folder):
    words = _documents(spark, folder).select(F.explode(text.tokens(F.col("text"))).alias("word"))
    return (
        words.groupBy("word")
        .agg(F.count("*").alias("occurrences"))
        .groupBy(text.light_stem(F.col("word")).alias("stem"))
        .agg(F.count("*").alias("words"), F.sum("occurrences").alias("occurrences"))
    )


def redaction_detect(spark, folder):
    marked = F.col("text")
    for plain, mark in ((" of ", " [Redacted] "), (" la ", " xxXx "), (" und ", " \u2588\u2588 "), (" de ", " [[de]] ")):
        marked = F.replace(marked, F.lit(plain), F.lit(mark))
    return _documents(spark, folder).select("doc_id", F.inline(F.array(text.redaction(marked))))


def chunk_flags(spark, folder):
    terms = {**CHUNK_CONTENT_TERMS, "contains_network": ("tion", "que la"), "contains_claims": ("der ",)}
    rows = tables.chunks(spark, folder)
    header = F.when(F.col("doc_idx") % 3 == 0, F.lit("document_content")).otherwise(
        F.concat(F.lit("section:Definitions > Clause:"), F.col("state"))
    )
    flags = text.chunk_flags(F.col("content"), header, text.token_count(F.col("content")), F.col("page_number"), terms)
    return rows.select("doc_idx", *flags)


def attribute_flags(spark, folder):
    terms = {**ATTRIBUTE_TERMS, "has_provider": ("tion",), "has_claims": ("la ", "der ")}
    return tables.attributes(spark, folder).select("attribute_number", *text.attribute_flags(F.col("content"), terms))


def page_range(spark, folder):
    return _documents(spark, folder).select(
        "doc_id", text.page_range(F.floor(F.col("n_chars") / 100).cast("int")).alias("page_range")
    )


def embedding_text(spark, folder):
    rows = tables.chunks(spark, folder)
    header = F.when(F.col("doc_idx") % 3 == 0, F.lit("document_content")).otherwise(F.col("header_path"))
    return rows.select("doc_idx", text.text_to_embed(header, F.col("content")).alias("text_to_embed"))


def sha256_ids(spark, folder):
    rows = tables.clauses(spark, folder)
    prepared = rows.withColumn("preprocessed_sha256", text.sha256(text.preprocess_text(F.col("raw_text"))))
    identified = clauses.with_row_id(
        prepared.select(
            "clause_id",
            "collection_key",
            (F.col("attribute_number") - 1).alias("attribute_number"),
            F.concat("contract", F.lit(".v1.md")).alias("source_file"),
            F.when(F.col("clause_id") % 4 > 0, F.concat(F.lit("c"), F.col("clause_id").cast("string"))).alias("chunk_id"),
            F.floor(F.col("n_chars") / 1000).cast("int").alias("page"),
            "preprocessed_sha256",
        ),
        "::para",
    )
    return identified.select("clause_id", "preprocessed_sha256", "row_id")


def file_slugs(spark, folder):
    pages = tables.table(spark, folder, "pages")
    return pages.select(
        "page_id", text.file_stem(F.col("url")).alias("stem"), text.file_slug(F.col("url")).alias("slug")
    )


def collection_states(spark, folder):
    key = tables.collection_key(F.col("lang"))
    rows = _documents(spark, folder).select(
        text.state_of_collection(key).alias("state"),
        text.state_in_name(F.concat(F.col("source"), key)).alias("state_in_name"),
        clauses.collection_kind(key).alias("kind"),
    )
    return rows.groupBy("state", "state_in_name", "kind").agg(F.count("*").alias("chunks"))


def l2_normalize(spark, folder):
    rows = tables.table(spark, folder, "embeddings")
    scaled = F.transform("embedding", lambda value: value.cast("double") * F.col("label"))
    unit = vectors.l2_normalize(scaled)
    return rows.select(
        "vec_id",
        F.round(F.element_at(unit, 1), 6).alias("first"),
        F.round(F.element_at(unit, -1), 6).alias("last"),
        F.round(vectors.similarity(F.col("embedding"), unit), 4).alias("similarity"),
    )


def clause_number(spark, folder):
    rows = tables.search_rows(spark, folder)
    section = F.when(F.col("row_index") % 3 > 0, F.col("section"))
    return rows.select("row_index", text.clause_number(section).alias("clause_number"))


def query_keywords(spark, folder):
    return tables.messages(spark, folder).select(
        "session_id", "seq", F.array_join(text.query_keywords(F.col("text")), "|").alias("keywords")
    )


def intent_parse(spark, folder):
    found = search.intents(tables.messages(spark, folder))
    return found.select("session_id", "seq", "contract_filter", _long("standard_filter"))


def single_line(spark, folder):
    answer = F.concat(F.lit(" Answer: "), F.col("text"))
    return tables.messages(spark, folder).select("session_id", "seq", text.single_line(answer).alias("line"))


# --- parsing -----------------------------------------------------------------------


def format_markdown(spark, folder):
    def mark(line, index):
        return (
            F.when(index % 4 == 1, F.concat(F.lit("Section IV "), line))
            .when(index % 4 == 2, F.concat(F.lit(" 12."), index.cast("string"), F.lit(".3 "), line))
            .when(index % 8 == 3, F.concat(F.lit("// "), line))
            .otherwise(line)
        )

    marked = F.array_join(F.transform(F.split("text", "\n"), mark), "\n")
    return _documents(spark, folder).select("doc_id", markdown.format_markdown(marked).alias("markdown"))


def table_to_md(spark, folder):
    rows = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    return _documents(spark, folder).select("doc_id", markdown.table_to_markdown(rows).alias("markdown"))


def parse_pages(spark, folder):
    return chunking.split_pages(tables.markdown_documents(spark, folder)).select(
        "source_file", _long("page_number"), "content"
    )


def _sections(documents: DataFrame) -> DataFrame:
    rows = chunking.document_sections(documents).select("document_id", "source_file", F.inline("sections"))
    return rows.withColumn("header_path", chunking.header_path())


def header_paths(spark, folder):
    return _sections(tables.markdown_documents(spark, folder)).select(
        "source_file", _long("page_number"), _long("section_no"), "header_path", "content"
    )


def header_paths_repeated(spark, folder):
    return _sections(tables.repeated_pages(spark, folder)).select(
        "document_id", "source_file", _long("segment_no"), _long("page_number"), _long("section_no"), "header_path", "content"
    )


def header_paths_of_rows(spark, folder):
    """Documents that come as one row per page: headers pass from row to row by a scan of summaries."""
    sections = chunking.header_sections(chunking.split_pages(tables.repeated_pages(spark, folder)))
    return chunking.carry_headers(sections).select(
        "document_id", "source_file", _long("segment_no"), _long("page_number"), _long("section_no"),
        chunking.header_path().alias("header_path"), "content",
    )


def chunk_ids(spark, folder):
    """Header sections as whole pieces, so that ids can be checked without the splitter."""
    sections = chunking.document_sections(tables.markdown_documents(spark, folder))
    whole = F.transform("sections", lambda s: F.array(F.struct(F.lit(0).alias("start"), s["content"].alias("content"))))
    return chunking.number_chunks(sections, whole).select(
        "chunk_id", _long("page_number"), _long("chunk_index"), _long("token_count"), text.sha256(F.col("content")).alias("sha")
    )


def _solid(column: Column) -> Column:
    """Characters that are no white space."""
    return F.char_length(F.regexp_replace(column, text.SPACES, ""))


def _coverage(chunks: DataFrame, texts: DataFrame, keys: list[str], size: Column, overlap: Column) -> DataFrame:
    """What must hold for the chunks of any text: ``chunks`` has start and content, ``texts`` the whole ``text``."""
    window = Window.partitionBy(*keys).orderBy("start")
    end = F.col("start") + F.char_length("content")
    before = F.coalesce(F.lag(end).over(window), F.lit(0))
    shared = F.substring("content", F.lit(1), F.greatest(before - F.col("start"), F.lit(0)))
    placed = chunks.withColumn("shared", shared).withColumn("later", F.lead("start").over(window) > F.col("start"))
    return (
        placed.join(texts, keys)
        .groupBy(*keys)
        .agg(
            F.sum(_solid(F.col("content")) - _solid(F.col("shared"))).alias("covered"),
            F.bool_and(F.substring("text", F.col("start") + 1, F.char_length("content")) == F.col("content")).alias("in_place"),
            F.coalesce(F.bool_and("later"), F.lit(True)).alias("in_order"),
            F.bool_and(size).alias("within_size"),
            F.bool_and(overlap).alias("within_overlap"),
        )
    )


def chunk_documents_coverage(spark, folder):
    """Chunks hold every character of their section that is no white space, in order, within size and overlap."""
    documents = tables.markdown_documents(spark, folder)
    keys = ["document_id", "segment_no", "section_no"]
    texts = _sections(documents).select(*keys, F.col("content").alias("text"))
    words = text.token_count(F.col("shared"))
    found = _coverage(chunking.placed_chunks(documents, 60, 20), texts, keys, F.col("token_count") <= 60, words <= 20)
    return found.withColumn("segment_no", _long("segment_no")).withColumn("section_no", _long("section_no"))


def chunk_large_documents_coverage(spark, folder):
    documents = tables.markdown_documents(spark, folder)
    texts = documents.select(F.col("source_file").alias("document_id"), F.col("value").alias("text"))
    size, shared = F.char_length("content") <= 1000, F.char_length("shared") <= 200
    return _coverage(chunking.placed_large_chunks(documents), texts, ["document_id"], size, shared)


def chunk_documents(spark, folder):
    return chunking.chunk_documents(tables.markdown_documents(spark, folder), size=60, overlap=20)


def chunk_large_documents(spark, folder):
    return chunking.chunk_large_documents(tables.markdown_documents(spark, folder))


def wa_chunk_metadata(spark, folder):
    documents = tables.markdown_documents(spark, folder)
    parts = documents.select("doc_id", F.posexplode(F.split("value", "\n\n")).alias("part", "chunk"))
    fields = parts.select("doc_id", _long("part"), *markdown.large_file_fields(F.col("chunk")))
    return fields.withColumn("page", _long("page"))


def attribute_rows(spark, folder):
    items = tables.table(spark, folder, "benchmark")
    sheet = items.select(
        F.col("item_id").alias("row_index"),
        F.when(F.col("item_id") % 7 != 3, F.element_at(F.split("text", " "), 1)).alias("name"),
        F.when(F.col("item_id") % 5 != 0, F.col("text")).alias("definition"),
        F.concat(F.lit(" \u2588\u2588 "), F.col("text")).alias("example"),
    )
    found = chunking.attribute_rows(sheet, "row_index", ["name", "definition", "example"], "sheet.csv")
    return found.withColumn("attribute_number", _long("attribute_number")).withColumn("token_count", _long("token_count"))


def page_batches(spark, folder):
    pages = chunking.split_pages(tables.markdown_documents(spark, folder))
    batches = chunking.page_batches(pages, 3)
    return batches.groupBy("source_file", _long("batch_no")).agg(
        F.count("*").alias("pages"), F.min("page_number").cast("long").alias("first_page")
    )


def recombine_batches(spark, folder):
    """Every document as three batches whose page numbers restart."""
    documents = tables.markdown_documents(spark, folder)
    batches = documents.select(
        "source_file",
        F.inline(
            F.transform(
                F.sequence(F.lit(1), F.lit(3)), lambda number: F.struct(number.alias("batch_no"), F.col("value").alias("value"))
            )
        ),
    )
    found = chunking.recombine_batches(batches, 20)
    return found.select("source_file", _long("block_no"), text.sha256(F.col("value")).alias("sha"))


def unprocessed_documents(spark, folder):
    """Documents of the corpus that have no label yet."""
    documents = _documents(spark, folder)
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    inputs = documents.select("doc_id", F.concat(name, F.lit(".pdf")).alias("source_file"))
    outputs = tables.table(spark, folder, "labels").select(F.concat(name, F.lit(".md")).alias("source_file"))
    return not_processed(inputs, outputs).select("doc_id", "source_file")


def incremental_ingest(spark, folder):
    """Stream the documents file into a prepared table, then read the table."""
    target = f"{ensure_checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    # As a pattern, the path may name a single file or a folder of files.
    chunks = stream_chunks(spark, f"{folder}/documents.{{parquet}}", schema).withColumnRenamed("text", "content")
    ingest(chunks, f"{target}/table", f"{target}/state").awaitTermination()
    return spark.read.parquet(f"{target}/table").select(
        "doc_id", F.col("preprocessed_token_count").cast("long").alias("token_count"), "preprocessed_sha256"
    )


# --- classification ------------------------------------------------------------------


def exact_match_flag(spark, folder):
    templates, candidates = tables.templates_and_candidates(tables.clauses(spark, folder))
    return classify.exact_match(candidates, templates).select("clause_id", _long("is_standard"))


def exact_match_only(spark, folder):
    templates, candidates = tables.templates_and_candidates(tables.clauses(spark, folder))
    return classify.exact_only(candidates, templates).select("clause_id", "state", _long("attribute_number"))


def nearest_template_query(spark, folder):
    templates, candidates = tables.templates_and_candidates(tables.clauses(spark, folder))
    return nearest_template(candidates, templates, ["state", "attribute_number"]).select(
        "clause_id", _six("similarity"), "template_id"
    )


def nearest_template_blocks(spark, folder):
    """The same answer from the shuffled plan with small blocks."""
    templates, candidates = tables.templates_and_candidates(tables.clauses(spark, folder))
    cell = ["state", "attribute_number"]
    found = nearest_template(candidates, templates, cell, "cosine", broadcast_limit=0, template_block=8, clause_block=16)
    return found.select("clause_id", _six("similarity"), "template_id")


def best_template(spark, folder):
    templates, candidates = tables.templates_and_candidates(tables.clauses(spark, folder))
    scored = classify.score_against_templates(candidates, templates, "cosine")
    return scored.select(
        "clause_id", _six("semantic_similarity"), _six("paraphrase_similarity"), text.sha256(F.col("template_text")).alias("template_sha")
    )


def rule_flags(spark, folder):
    rules = (*RULE_PATTERNS, *tables.TABLE_RULES)
    found = _documents(spark, folder).select(
        "doc_id", classify.rule_flags(text.preprocess_text(F.col("text")), rules).alias("flags")
    )
    return found.select("doc_id", F.size("flags").cast("long").alias("hits"), F.array_join("flags", "; ").alias("flags"))


def _label(number):
    names = (classify.ENTAILMENT, classify.NEUTRAL, classify.CONTRADICTION)
    result = F.lit(None).cast("string")
    for value, name in enumerate(names):
        result = F.when(number == value, F.lit(name)).otherwise(result)
    return result


def nli_truth_table(spark, folder):
    """Every label pair, with missing labels, over the documents."""
    documents = _documents(spark, folder)
    paraphrase = (F.col("n_chars") % 40) / 40.0
    found = classify.entailment_verdict(_label(F.col("n_chars") % 4), _label(F.col("doc_id") % 4), paraphrase)
    return documents.select("doc_id", F.inline(F.array(found))).select("doc_id", _long("standard"), "reason")


def negation_jaccard(spark, folder):
    """Each conversation turn against the turn before it."""
    turns = tables.table(spark, folder, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("template_text"))
    paired = classify.add_following_word_negations(turns.join(before, ["conv_id", "turn"]), tables.TABLE_NEGATORS)
    verdict = classify.negation_verdict(F.col("candidate_negations"), F.col("template_negations"))
    return paired.select("conv_id", "turn", F.inline(F.array(verdict)))


def classify_cascade(spark, folder):
    templates, candidates = tables.templates_and_candidates(tables.clauses(spark, folder))
    found = tables.cascade(templates, candidates)
    return found.select(
        "clause_id",
        _long("is_standard"),
        "classification_step",
        _six("semantic_similarity"),
        _six("paraphrase_similarity"),
        "nli_reasoning",
        "negation_reasoning",
        F.array_join("rule_flags", "; ").alias("rule_flags"),
    )


# --- report ----------------------------------------------------------------------------


def summary_all(spark, folder):
    found = report.summary(tables.classified(spark, folder))
    return found.withColumn("standard_percentage", F.round("standard_percentage", 6))


def summary_overall(spark, folder):
    found = report.overall(tables.classified(spark, folder))
    return found.withColumn("standard_percentage", F.round("standard_percentage", 6))


def _breakdown(column: str) -> Query:
    def query(spark, folder):
        found = report.breakdown(tables.classified(spark, folder), F.col(column), "key")
        return found.withColumn("standard_percentage", F.round("standard_percentage", 6))

    return query


def summary_by_contract(spark, folder):
    found = report.summary(tables.classified(spark, folder))
    return found.where(F.col("section").startswith("contract_")).select("section", "contract", "key", "total", "standard")


def rule_flag_top10(spark, folder):
    return report.flag_histogram(tables.classified(spark, folder))


def similarity_means(spark, folder):
    found = report.similarity_means(tables.classified(spark, folder))
    return found.select(
        F.round("avg_semantic", 6).alias("avg_semantic"),
        "semantic_values",
        F.round("avg_paraphrase", 6).alias("avg_paraphrase"),
        "paraphrase_values",
    )


def similarity_values(spark, folder):
    return report.similarity_values(tables.classified(spark, folder))


def contract_summary(spark, folder):
    return report.contract_summary(tables.classified(spark, folder))


def non_standard_listing(spark, folder):
    return report.non_standard_rows(tables.classified(spark, folder), "SRC1").select("contract", "clause_id", "state")


def non_standard_counts(spark, folder):
    return report.non_standard_counts(tables.classified(spark, folder), keep_empty=True)


# --- charts ------------------------------------------------------------------------------


def pie_standard(spark, folder):
    return charts.standard_pie(tables.metric_contracts(spark, folder))


def token_histogram(spark, folder):
    found = charts.histogram(tables.metric_clauses(spark, folder), "token_length")
    return found.withColumn("bin", _long("bin"))


def token_stats(spark, folder):
    found = charts.length_stats(tables.metric_clauses(spark, folder))
    return found.withColumn("min", _long("min")).withColumn("max", _long("max"))


def heatmap_attr_state(spark, folder):
    return charts.heatmap(tables.metric_clauses(spark, folder, similar=True), tables.metric_contracts(spark, folder))


def contract_bar(spark, folder):
    return charts.contract_bars(tables.metric_contracts(spark, folder))


def attribute_bar(spark, folder):
    return charts.attribute_bars(tables.metric_clauses(spark, folder, judged=True))


def similarity_boxplot(spark, folder):
    return charts.similarity_box(tables.metric_clauses(spark, folder, similar=True))


def similarity_outliers(spark, folder):
    return charts.similarity_outliers(tables.metric_clauses(spark, folder, similar=True))


def scatter_len_sim(spark, folder):
    found = charts.length_scatter(tables.metric_clauses(spark, folder, judged=True))
    return found.withColumn("x", _long("x"))


def processing_timeline(spark, folder):
    return charts.processing_timeline(tables.timings(spark, folder), tables.metric_contracts(spark, folder))


def wordcloud(spark, folder):
    return charts.word_cloud(tables.metric_clauses(spark, folder))


# --- search and chat -----------------------------------------------------------------------


def keyword_search(spark, folder):
    found = search.search(tables.search_rows(spark, folder), QUERY_TEXT, contract="SRC1", is_standard=1)
    return found.select(
        "source_filename", "row_index", "attribute_name", _long("page"), "clause_number", _long("is_standard"), "full_content_raw"
    )


def keyword_search_first_rows(spark, folder):
    found = search.search(tables.search_rows(spark, folder), QUERY_TEXT, rows_per_file=search.ROWS_PER_FILE)
    return found.select(
        "source_filename", "row_index", "attribute_name", _long("page"), "clause_number", _long("is_standard"), "full_content_raw"
    )


def evidence_prompt(spark, folder):
    return search.prompt(search.search(tables.search_rows(spark, folder), QUERY_TEXT), QUERY_TEXT)


def fallback_answer(spark, folder):
    rows = tables.search_rows(spark, folder)
    counted = search.fallback_answer(search.matching(rows, QUERY_TEXT, is_standard=0), 0)
    item = search.fallback_answer(search.matching(rows, QUERY_TEXT), None)
    nothing = search.fallback_answer(search.matching(rows, "zzzz unknownword"), None)
    kinds = [("count", counted), ("item", item), ("nothing", nothing)]
    frames = [frame.select(F.lit(kind).alias("kind"), "answer") for kind, frame in kinds]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def last_20_messages(spark, folder):
    """Sessions by role, so that one session holds about half of all messages."""
    rows = tables.messages(spark, folder).select(
        F.col("role").alias("session_id"), (F.col("session_id") * 100 + F.col("seq")).alias("seq"), "text"
    )
    return search.recent_messages(rows)


def session_history(spark, folder):
    recent = search.recent_messages(tables.messages(spark, folder), 3)
    return recent.select("session_id", "seq", "role", "text")


def _first_session(messages: DataFrame) -> str:
    return messages.agg(F.min(F.col("session_id").cast("long"))).first()[0]


def history_read(spark, folder):
    messages = tables.messages(spark, folder)
    return search.session_history(messages, _first_session(messages)).select(_long("session_id"), "seq", "text")


def history_clear(spark, folder):
    messages = tables.messages(spark, folder)
    return search.clear_session(messages, _first_session(messages)).select(_long("session_id"), "seq", "text")


def first_rows_per_file(spark, folder):
    rows = tables.search_rows(spark, folder)
    found = top_k(rows, ["source_filename"], [F.asc("row_index")], search.ROWS_PER_FILE, "position")
    return found.select("source_filename", "row_index", _long("position"))


QUERIES: dict[str, Query] = {
    "corpus_counts": corpus_counts,
    "bm25_scores": bm25_scores,
    "bm25_topk": bm25_topk,
    "bm25_index_topk": bm25_index_topk,
    "bm25_index_skipping": bm25_index_skipping,
    "dense_topk": dense_topk,
    "dense_topk_scaled": dense_topk_scaled,
    "dense_topk_scaled_cosine": partial(dense_topk_scaled, metric="cosine"),
    "rrf_topk": rrf_topk,
    "rrf_all_in_one": rrf_all_in_one,
    "rrf_scores": rrf_scores,
    "rrf_per_source_topk": rrf_per_source_topk,
    "format_matches": format_matches,
    "match_stats": match_stats,
    "per_source_match_stats": per_source_match_stats,
    "attribute_caps": attribute_caps,
    "dense_only_matcher": dense_only_matcher,
    "dense_only_stats": dense_only_stats,
    "nearest_three": nearest_three,
    "similarity_json": similarity_json,
    "similarity_roundtrip": similarity_roundtrip,
    "collection_versions": collection_versions,
    "similarity_roundtrip_per_source": similarity_roundtrip_per_source,
    "tokens": tokens,
    "clean_text": clean_text,
    "preprocess_text": preprocess_text,
    "token_counts": token_counts,
    "lemma_rules": lemma_rules,
    "redaction_detect": redaction_detect,
    "chunk_flags": chunk_flags,
    "attribute_flags": attribute_flags,
    "page_range": page_range,
    "embedding_text": embedding_text,
    "sha256_ids": sha256_ids,
    "file_slugs": file_slugs,
    "collection_states": collection_states,
    "l2_normalize": l2_normalize,
    "clause_number": clause_number,
    "query_keywords": query_keywords,
    "intent_parse": intent_parse,
    "single_line": single_line,
    "format_markdown": format_markdown,
    "table_to_md": table_to_md,
    "parse_pages": parse_pages,
    "header_paths": header_paths,
    "chunk_ids": chunk_ids,
    "header_paths_repeated": header_paths_repeated,
    "header_paths_of_rows": header_paths_of_rows,
    "chunk_documents_coverage": chunk_documents_coverage,
    "chunk_large_documents_coverage": chunk_large_documents_coverage,
    "chunk_documents": chunk_documents,
    "chunk_large_documents": chunk_large_documents,
    "wa_chunk_metadata": wa_chunk_metadata,
    "attribute_rows": attribute_rows,
    "page_batches": page_batches,
    "recombine_batches": recombine_batches,
    "unprocessed_documents": unprocessed_documents,
    "incremental_ingest": incremental_ingest,
    "exact_match_flag": exact_match_flag,
    "exact_match_only": exact_match_only,
    "nearest_template": nearest_template_query,
    "nearest_template_blocks": nearest_template_blocks,
    "nearest_template_scaled": nearest_template_scaled,
    "nearest_template_scaled_cosine": partial(nearest_template_scaled, metric="cosine"),
    "best_template": best_template,
    "rule_flags": rule_flags,
    "nli_truth_table": nli_truth_table,
    "negation_jaccard": negation_jaccard,
    "classify_cascade": classify_cascade,
    "summary_all": summary_all,
    "summary_overall": summary_overall,
    "summary_by_step": _breakdown("classification_step"),
    "summary_by_attribute": _breakdown("attribute_number"),
    "summary_by_state": _breakdown("state"),
    "summary_by_contract": summary_by_contract,
    "rule_flag_top10": rule_flag_top10,
    "similarity_means": similarity_means,
    "similarity_values": similarity_values,
    "contract_summary": contract_summary,
    "non_standard_listing": non_standard_listing,
    "non_standard_counts": non_standard_counts,
    "pie_standard": pie_standard,
    "token_histogram": token_histogram,
    "token_stats": token_stats,
    "heatmap_attr_state": heatmap_attr_state,
    "contract_bar": contract_bar,
    "attribute_bar": attribute_bar,
    "similarity_boxplot": similarity_boxplot,
    "similarity_outliers": similarity_outliers,
    "scatter_len_sim": scatter_len_sim,
    "processing_timeline": processing_timeline,
    "wordcloud": wordcloud,
    "keyword_search": keyword_search,
    "keyword_search_first_rows": keyword_search_first_rows,
    "evidence_prompt": evidence_prompt,
    "history_read": history_read,
    "history_clear": history_clear,
    "fallback_answer": fallback_answer,
    "last_20_messages": last_20_messages,
    "session_history": session_history,
    "first_rows_per_file": first_rows_per_file,
}
