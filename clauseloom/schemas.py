"""Column layout of the engine's tables."""

from __future__ import annotations

CHUNKS = (
    "chunk_id string, page_number int, header_path string, chunk_index int, content string, token_count int, "
    "source_file string, document_type string"
)
ATTRIBUTES = (
    "chunk_id string, attribute_number int, attribute_name string, content string, token_count int, "
    "source_file string, document_type string"
)
CLAUSES = (
    "collection_key string, collection_name string, attribute_number int, attribute_name string, rank int, "
    "rank_in_global int, page int, section string, chunk_id string, source_file string, rrf_score double, "
    "dense_similarity double, bm25_score double, content_preview string, full_content_raw string, "
    "preprocessed_final_content string, preprocessed_token_count int, preprocessed_sha256 string, "
    "has_redaction boolean, redaction_snippet string, isStandard int, classification_step string, "
    "classification_reasoning string, semantic_similarity double, paraphrase_similarity double, "
    "nli_reasoning string, negation_reasoning string, rule_flags array<string>"
)
MATCH = (
    "struct<rank:int, rank_in_global:int, rrf_score:double, page:int, section:string, chunk_id:string, "
    "source_file:string, content_preview:string, full_content:string, "
    "score_breakdown:struct<dense_similarity:double, bm25_score:double, dense_rank:int, bm25_rank:int, "
    "rrf_contribution_dense:double, rrf_contribution_bm25:double>>"
)
# A ranking result: maps keyed by attribute name and, for contracts, by source file.
SIMILARITY = (
    "collection_info struct<collection_key:string, collection_name:string, mode:string, top_k:int>, "
    "matches map<string, struct<"
    "attribute_info:struct<number:string, name:string, content_preview:string>, "
    f"top_matches:array<{MATCH}>, matches:array<{MATCH}>, "
    f"per_source_top_matches:map<string, array<{MATCH}>>>>"
)
METRIC_CLAUSES = (
    "chunk_id string, contract_id string, assigned_attribute string, token_length int, similarity double, "
    "classification string, text_snippet string"
)
METRIC_CONTRACTS = (
    "contract_id string, state string, standard_count int, nonstandard_count int, num_chunks int"
)
METRIC_ATTRIBUTE = (
    "struct<standard_count:int, nonstandard_count:int, occurrences:int, avg_similarity:double, "
    "per_state_avg_similarity:map<string,double>>"
)
METRICS = (
    "corpus struct<standard_count:int, nonstandard_count:int>, "
    f"clauses array<struct<{', '.join(f'{n}:{t}' for n, t in (c.split(' ') for c in METRIC_CLAUSES.split(', ')))}>>, "
    f"contracts array<struct<{', '.join(f'{n}:{t}' for n, t in (c.split(' ') for c in METRIC_CONTRACTS.split(', ')))}>>, "
    f"attributes map<string, {METRIC_ATTRIBUTE}>, "
    "processing struct<timings:map<string,double>>"
)
MESSAGES = "session_id string, seq bigint, role string, content string"
