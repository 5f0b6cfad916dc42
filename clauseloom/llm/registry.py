"""The queries over the given tables, one for each operator, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import (
    embedding_dedup,
    mixing,
    near_dedup,
    neighbours,
    packing,
    periodic_runs,
    prefix_trie,
    quality,
    secrets,
    suffix_dedup,
    token_counts,
    toxicity,
    url_reputation,
)
from clauseloom.llm.common import table


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), mixing.Target(repetitions=4.0))


def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), near_dedup.Options(words=4))


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents")).drop("n_spans")


def op4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    tokens = packing.tokenized(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.checksummed(packing.pack(tokens), tokens).drop("row")


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents")).drop("spans", "kept")


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op9_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    judged = url_reputation.judge(table(spark, folder, "pages"), outcomes)
    return judged.withColumn("reputation", F.round("reputation", 6))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = periodic_runs.with_planted_periods(table(spark, folder, "documents"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    turns = prefix_trie.with_borrowed_heads(prefix_trie.ordered_turns(conversations))
    return prefix_trie.prefix_trie(turns, conversations.where("conv_id is not null").select("conv_id"))


QUERIES = {name: run for name, run in globals().items() if name.startswith("op")}
_REACHED = """reach AS (SELECT id AS x, id AS y FROM ids UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
lowest AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)"""

_NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{url_reputation.UPPER}', '{url_reputation.LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4
    THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
ids AS (SELECT doc_id AS id FROM documents),
{_REACHED}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN lowest ON x = doc_id"""

_EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
ids AS (SELECT vec_id AS id FROM embeddings),
{_REACHED},
counts AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN counts USING (vec_id) JOIN lowest ON lowest.x = vec_id"""

ORACLES = {
    "op2_near_dedup": _NEAR_DEDUP,
    "op8_embedding_dedup": _EMBEDDING_DEDUP,
    "op9_url_reputation": url_reputation.oracle_sql(),
    "op13_prefix_trie": prefix_trie.oracle_sql(),
}
