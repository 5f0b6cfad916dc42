"""DuckDB SQL with the same answers, written independently of the Spark plans."""

from __future__ import annotations

from collections.abc import Callable

from clauseloom.functions.lexicon import (
    NUMBER_WORDS,
    RULE_PATTERNS,
    STOP_WORDS,
    WORDCLOUD_STOP_WORDS,
)
from clauseloom.plans.driver_tables import TABLE_NEGATORS, TABLE_RULES

BLOCK = "\N{FULL BLOCK}"
SPACE = r"[\s\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _list(values) -> str:
    return "(" + ", ".join(f"'{value}'" for value in values) + ")"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> '')"


def _tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '([\p{{L}}\p{{N}}_]+)', 1)"


def _preprocess(x: str) -> str:
    return rf"""array_to_string(list_transform(list_filter(
        regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g'), '\s+'),
        lambda w: w <> '' AND w NOT IN {_list(STOP_WORDS)}),
        lambda w: CASE WHEN regexp_matches(w, '[0-9]') OR w IN {_list(NUMBER_WORDS)} THEN 'num' ELSE w END), ' ')"""


def _flags(x: str, rules) -> str:
    hits = ", ".join(
        f"CASE WHEN regexp_matches(lower({x}), '{pattern}') THEN '{group}: {pattern}' END" for group, pattern in rules
    )
    return f"list_filter([{hits}], lambda f: f IS NOT NULL)"


# --- ranking -------------------------------------------------------------------

CHUNKS = """
chunks AS (
  SELECT d.doc_id AS doc_idx, d.text AS content, d.source AS source_file, d.lang AS state, d.n_chars,
         e.embedding::DOUBLE[] AS v
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
attrs AS (
  SELECT b.item_id + 1 AS attribute_number, b.text AS content, e.embedding::DOUBLE[] AS v
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)"""

COUNTS = rf"""{CHUNKS},
toks AS (SELECT doc_idx, {_tokens('content')} AS t FROM chunks),
q AS (SELECT attribute_number, term, count(*) AS qtf
      FROM (SELECT attribute_number, unnest({_tokens('content')}) AS term FROM attrs) GROUP BY ALL),
tf AS (SELECT doc_idx, term, count(*) AS tf FROM (SELECT doc_idx, unnest(t) AS term FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, sum(len(t))::DOUBLE / count(*) AS avgdl FROM toks)"""

def _l2(a: str, b: str) -> str:
    """1 - squared distance, from the vectors' own lengths."""
    return f"1 - (list_dot_product({a}, {a}) + list_dot_product({b}, {b}) - 2 * list_dot_product({a}, {b}))"


BM25 = f"""{COUNTS},
bm AS (
  SELECT q.attribute_number, tf.doc_idx,
    sum(round((q.qtf * ln((n - df + 0.5) / (df + 0.5) + 1e-9) * tf * 2.2
      / (tf + 1.2 * (0.25 + 0.75 * len(toks.t) / (avgdl + 1e-9)) + 1e-9)) * 1e12)::HUGEINT)::DOUBLE / 1e12 AS bm25_score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN toks USING (doc_idx), st GROUP BY ALL)"""


def _fused(rrf_k: int) -> str:
    return f"""{BM25},
pairs AS (
  SELECT a.attribute_number, c.doc_idx, c.source_file,
    round({_l2('a.v', 'c.v')}, 12) AS dense, coalesce(bm.bm25_score, 0.0) + 0.0 AS bm25
  FROM attrs a CROSS JOIN chunks c
  LEFT JOIN bm ON bm.attribute_number = a.attribute_number AND bm.doc_idx = c.doc_idx),
ranked AS (
  SELECT *,
    CASE WHEN dense IS NOT NULL
         THEN row_number() OVER (PARTITION BY attribute_number ORDER BY dense DESC NULLS LAST, doc_idx)
         ELSE coalesce(nullif(count(dense) OVER (PARTITION BY attribute_number), 0),
                       count(*) OVER (PARTITION BY attribute_number)) + 1 END AS dense_rank,
    row_number() OVER (PARTITION BY attribute_number ORDER BY bm25 DESC, doc_idx) AS bm25_rank
  FROM pairs),
fused AS (
  SELECT attribute_number, doc_idx, source_file, coalesce(dense, 0.0) AS dense_similarity, bm25 AS bm25_score,
    dense_rank, bm25_rank, 1.0::DOUBLE / ({rrf_k} + dense_rank) + 1.0::DOUBLE / ({rrf_k} + bm25_rank) AS rrf
  FROM ranked),
top AS (
  SELECT *, row_number() OVER (PARTITION BY attribute_number ORDER BY round(rrf, 12) DESC, doc_idx) AS rank FROM fused),
per_source AS (
  SELECT *, row_number() OVER (PARTITION BY attribute_number, source_file ORDER BY round(rrf, 12) DESC, doc_idx)
    AS rank_in_source FROM fused)"""


FUSED = _fused(20)
FUSED_COLUMNS = "round(dense_similarity, 6) AS dense_similarity, round(bm25_score, 6) AS bm25_score, dense_rank, bm25_rank, round(rrf, 10) AS rrf_score"
STATS = """SELECT attribute_number, count(*) AS matches, round(avg(rrf), 8) AS avg_rrf_score,
  round(max(rrf), 8) AS max_rrf_score, round(avg(dense_similarity), 8) AS avg_dense_score,
  round(avg(bm25_score), 8) AS avg_bm25_score, count(*) FILTER (rrf > 0.01) AS high_rrf_matches"""

DENSE = f"""{CHUNKS},
dense AS (
  SELECT a.attribute_number, c.doc_idx, round({_l2('a.v', 'c.v')}, 12) AS dense_similarity
  FROM attrs a, chunks c WHERE a.v IS NOT NULL AND c.v IS NOT NULL),
dense_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY attribute_number ORDER BY dense_similarity DESC, doc_idx) AS rank FROM dense)"""

QUERY_VECTOR = "list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 THEN 0.125 ELSE -0.125 END)::DOUBLE[]"

# --- clauses -------------------------------------------------------------------

LANG_KEY = """CASE lang WHEN 'en' THEN 'TNredacted' WHEN 'fr' THEN 'WAredacted' WHEN 'de' THEN 'TNstandard'
  ELSE 'WAstandard' END"""

CLAUSES = f"""
clauses AS (
  SELECT d.doc_id AS clause_id, d.source AS contract, d.lang AS state, {LANG_KEY} AS collection_key,
    d.n_chars % 5 + 1 AS attribute_number, d.text AS raw_text, d.n_chars, l.quality AS is_standard, l.toxic,
    e.embedding::DOUBLE[] AS v
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

SPLIT = f"""{CLAUSES},
prepared AS (SELECT *, {_preprocess('raw_text')} AS text,
  list_transform(v, lambda x, i: x * ((i - 1) % 4 + 1)) AS weighted FROM clauses),
templates AS (SELECT * FROM prepared WHERE is_standard = 1),
candidates AS (SELECT * FROM prepared WHERE is_standard IS DISTINCT FROM 1),
flagged AS (
  SELECT c.*, CASE WHEN c.text <> '' AND EXISTS (
    SELECT 1 FROM templates t WHERE t.state = c.state AND t.attribute_number = c.attribute_number AND t.text = c.text)
    THEN 1 ELSE 0 END AS exact FROM candidates c)"""


def _cosine(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"


def _dense_scaled(similarity: Callable[[str, str], str]) -> str:
    return f"""WITH {CHUNKS},
a AS (SELECT attribute_number, list_transform(v, lambda x: x * (attribute_number % 3 + 1)) AS v FROM attrs WHERE v IS NOT NULL),
c AS (SELECT doc_idx, list_transform(v, lambda x: x * (doc_idx % 4)) AS v FROM chunks WHERE v IS NOT NULL),
dense AS (SELECT attribute_number, doc_idx, round({similarity('a.v', 'c.v')}, 12) AS s FROM a, c)
SELECT attribute_number, doc_idx, round(s, 6) AS dense_similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY attribute_number ORDER BY s DESC, doc_idx) AS rank FROM dense
  WHERE s IS NOT NULL AND NOT isnan(s)) WHERE rank <= 20"""


def _nearest_scaled(similarity: Callable[[str, str], str]) -> str:
    return f"""WITH {SPLIT},
t AS (SELECT clause_id AS template_id, state, attribute_number, list_transform(v, lambda x: x * (clause_id % 4)) AS v
  FROM templates WHERE v IS NOT NULL),
once AS (SELECT clause_id, state, attribute_number, list_transform(v, lambda x: x * (clause_id % 4)) AS v
  FROM candidates WHERE v IS NOT NULL),
both_ways AS (SELECT * FROM once UNION ALL SELECT clause_id, state, attribute_number, list_reverse(v) FROM once),
s AS (SELECT c.clause_id, t.template_id, round({similarity('c.v', 't.v')}, 12) AS s
  FROM both_ways c JOIN t ON t.state = c.state AND t.attribute_number = c.attribute_number)
SELECT plan, clause_id, round(s, 6) AS similarity, template_id FROM s, (VALUES ('broadcast'), ('blocks')) p(plan)
WHERE s IS NOT NULL AND NOT isnan(s)
QUALIFY row_number() OVER (PARTITION BY plan, clause_id ORDER BY s DESC, template_id) = 1"""


def _nearest(name: str, vector: str, scale: Callable[[str, str], str]) -> str:
    return f"""{name} AS (
  SELECT clause_id, similarity, template_id, template_text FROM (
    SELECT *, row_number() OVER (PARTITION BY clause_id ORDER BY similarity DESC, template_id) AS rn FROM (
      SELECT c.clause_id, t.clause_id AS template_id, t.text AS template_text,
        round({scale(f'c.{vector}', f't.{vector}')}, 12) AS similarity
      FROM candidates c JOIN templates t ON t.state = c.state AND t.attribute_number = c.attribute_number
      WHERE c.v IS NOT NULL AND t.v IS NOT NULL)) WHERE rn = 1)"""


SCORED = f"""{SPLIT},
{_nearest('semantic', 'v', _cosine)},
{_nearest('paraphrase', 'weighted', _cosine)},
scored AS (
  SELECT f.*, coalesce(s.similarity, 0.0) AS semantic_similarity, coalesce(p.similarity, 0.0) AS paraphrase_similarity,
    coalesce(p.template_text, '') AS template_text
  FROM flagged f LEFT JOIN semantic s USING (clause_id) LEFT JOIN paraphrase p USING (clause_id))"""


def _distinct_words(x: str) -> str:
    return f"list_distinct({_words(x)})"


def _containment(premise: str, hypothesis: str) -> str:
    return f"""CASE WHEN len(list_filter({_distinct_words(hypothesis)},
      lambda w: NOT list_contains({_distinct_words(premise)}, w))) = 0 THEN 0
    WHEN len(list_intersect({_distinct_words(premise)}, {_distinct_words(hypothesis)})) = 0 THEN 2 ELSE 1 END"""


def _negations(x: str, negators) -> str:
    """Heads (the following word) of all negators, in order."""
    words = _words(f"lower({x})")
    return f"""list_transform(list_filter(list_zip({words}, list_append({words}[2:], '')),
      lambda p: p[1] IN {_list(negators)}), lambda p: p[2])"""


NEGATION_CASE = """CASE
  WHEN len(cn) <> len(tn) THEN 'Different negation counts: candidate=' || len(cn) || ', template=' || len(tn)
  WHEN len(cn) = 0 THEN 'No negations in either text' ELSE 'Negation scope similarity: ' || printf('%.2f', floor(100.0::DOUBLE
    * len(list_intersect(list_distinct(cn), list_distinct(tn))) / len(list_distinct(list_concat(cn, tn))) + 0.5::DOUBLE) / 100) END"""
NEGATION_KEPT = """(len(cn) = len(tn) AND (len(cn) = 0 OR
  len(list_intersect(list_distinct(cn), list_distinct(tn)))::DOUBLE / len(list_distinct(list_concat(cn, tn))) >= 0.5))"""

CASCADE_RULES = (*RULE_PATTERNS, ("exceptions", r"\bzu\b"), ("reanchoring", r"\bnum\b"))

JUDGED = f"""{SCORED},
staged AS (
  SELECT *, CASE WHEN exact = 1 THEN 'step1_exact_match' WHEN text = '' THEN 'error'
    WHEN semantic_similarity >= 0.30 THEN 'step2_semantic'
    WHEN paraphrase_similarity < 0.05 THEN 'step3_paraphrase_failed' END AS early,
    {_containment('template_text', 'text')} AS f, {_containment('text', 'template_text')} AS b,
    {_negations('text', ('el', 'eau', 'ment'))} AS cn, {_negations('template_text', ('el', 'eau', 'ment'))} AS tn,
    {_flags('text', CASCADE_RULES)} AS flags
  FROM scored),
judged AS (
  SELECT *, {NEGATION_CASE} AS negation, {NEGATION_KEPT} AS kept,
    CASE WHEN f = 0 AND b = 0 THEN 'Both-way entailment: meanings aligned'
      WHEN f = 2 OR b = 2 THEN 'Contradiction detected'
      WHEN f = 1 AND b = 1 AND paraphrase_similarity >= 0.12 THEN 'Neutral NLI but high paraphrase similarity: '
        || printf('%.3f', floor(paraphrase_similarity * 1000 + 0.5::DOUBLE) / 1000)
      ELSE 'One-way or neutral entailment (pred1=' || f || ', pred2=' || b || ')' END AS nli,
    (f = 0 AND b = 0) OR (f = 1 AND b = 1 AND paraphrase_similarity >= 0.12) AS passed
  FROM staged)"""

DECIDED = """CASE WHEN early IN ('step1_exact_match', 'step2_semantic') THEN 1 WHEN early IS NOT NULL THEN 0
    WHEN len(flags) = 0 AND kept AND passed THEN 1 ELSE 0 END::BIGINT AS is_standard,
  coalesce(early, CASE WHEN len(flags) > 0 THEN 'step6_rule_flags' WHEN NOT kept THEN 'step5_negation'
    ELSE 'step4_nli' END) AS classification_step,
  CASE WHEN early IS NULL OR early IN ('step2_semantic', 'step3_paraphrase_failed') THEN round(semantic_similarity, 6) END
    AS semantic_similarity,
  CASE WHEN early IS NULL OR early = 'step3_paraphrase_failed' THEN round(paraphrase_similarity, 6) END AS paraphrase_similarity"""

CASCADE = f"""WITH {JUDGED}
SELECT clause_id, {DECIDED},
  CASE WHEN early IS NULL THEN nli END AS nli_reasoning,
  CASE WHEN early IS NULL THEN negation END AS negation_reasoning,
  CASE WHEN early IS NULL THEN array_to_string(flags, '; ') END AS rule_flags
FROM judged"""

# --- classified, metrics, search rows --------------------------------------------

CLASSIFIED = f"""{JUDGED},
classified AS (SELECT clause_id, contract, state, attribute_number, {DECIDED}, CASE WHEN early IS NULL THEN flags END AS flags FROM judged)"""

BREAKDOWN = """SELECT {key} AS key, count(*) AS total, count(*) FILTER (is_standard = 1) AS standard,
  round(count(*) FILTER (is_standard = 1) / count(*)::DOUBLE * 100, 6) AS standard_percentage"""

SUMMARY_SETS = (
    ("overall", "NULL", "NULL"),
    ("step", "NULL", "coalesce(classification_step, 'unknown')"),
    ("attribute", "NULL", "attribute_number::VARCHAR"),
    ("state", "NULL", "state"),
    ("contract_step", "contract", "coalesce(classification_step, 'unknown')"),
    ("contract_attribute", "contract", "attribute_number::VARCHAR"),
)


def _summary(sections) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS section, {contract}::VARCHAR AS contract, {key}::VARCHAR AS key, count(*) AS total,
          count(*) FILTER (is_standard = 1) AS standard,
          count(*) - count(*) FILTER (is_standard = 1) AS non_standard,
          round(count(*) FILTER (is_standard = 1) / count(*)::DOUBLE * 100, 6) AS standard_percentage
        FROM classified GROUP BY ALL"""
        for name, contract, key in sections
    )


METRICS = f"""{CLASSIFIED},
nearest_of_all AS (SELECT c.clause_id, round(max(round({_cosine('c.v', 't.v')}, 12)), 6) AS similarity
  FROM clauses c JOIN templates t ON t.state = c.state AND t.attribute_number = c.attribute_number
  WHERE c.v IS NOT NULL AND t.v IS NOT NULL GROUP BY c.clause_id),
m AS (
  SELECT 'doc_' || clause_id AS chunk_id, 'contract_' || contract AS contract_id,
    CASE WHEN n_chars % 7 <> 0 THEN 'attribute_' || attribute_number END AS assigned_attribute,
    len({_words('raw_text')}) AS token_length, similarity, raw_text AS text_snippet,
    CASE WHEN clauses.is_standard = 1 OR judged_as = 1 THEN 'standard' ELSE 'nonstandard' END AS classification
  FROM clauses LEFT JOIN nearest_of_all USING (clause_id)
  LEFT JOIN (SELECT clause_id, is_standard AS judged_as FROM classified) USING (clause_id)),
k AS (
  SELECT 'contract_' || contract AS contract_id, first(state ORDER BY n_chars, clause_id) AS state,
    count(*) FILTER (is_standard = 1) AS standard_count, count(*) FILTER (is_standard = 0) AS nonstandard_count,
    count(*) AS num_chunks
  FROM clauses GROUP BY ALL)"""

BOX = f"""{METRICS},
sims AS (SELECT assigned_attribute AS attribute, chunk_id, coalesce(similarity, 0.0) AS s FROM m
  WHERE assigned_attribute IS NOT NULL),
lists AS (SELECT attribute, list_sort(list(s)) AS l, count(*) AS n, avg(s) AS mean FROM sims GROUP BY attribute),
box AS (SELECT attribute, n, mean, l[1] AS lo, l[n // 4 + 1] AS q1, l[n // 2 + 1] AS med, l[3 * n // 4 + 1] AS q3,
  l[n] AS hi FROM lists),
out AS (SELECT sims.attribute, chunk_id, s FROM sims JOIN box USING (attribute)
  WHERE s < q1 - 1.5 * (q3 - q1) OR s > q3 + 1.5 * (q3 - q1))"""

SEARCH = """
rows AS (
  SELECT d.source AS source_filename, d.doc_id AS row_index, 'attribute_' || (d.n_chars % 5 + 1) AS attribute_name,
    d.n_chars // 1000 AS page, (d.n_chars % 5 + 1) || '.1' AS clause_number, l.quality AS is_standard, d.text
  FROM documents d LEFT JOIN labels l USING (doc_id)),
first_rows AS (
  SELECT *, row_number() OVER (PARTITION BY source_filename ORDER BY row_index) AS position FROM rows
  QUALIFY position <= 30),
hits AS (
  SELECT * FROM rows
  WHERE contains(lower(attribute_name || ' ' || text), 'attention') OR contains(lower(attribute_name || ' ' || text), 'que'))"""

ITEM = """'Contract=' || source_filename || '; Attr=' || attribute_name || '; Clause=' || clause_number || '; Page=' || page
  || '; Standard=' || coalesce(is_standard::VARCHAR, 'N/A')"""

MESSAGES = """
msg AS (
  SELECT conv_id AS session_id, turn AS seq, role, text || CASE turn % 6
    WHEN 1 THEN ' show TN contract ' || (conv_id % 13)
    WHEN 2 THEN ' which are non-standard in WA ?'
    WHEN 3 THEN ' Non standard terms in tn'
    WHEN 4 THEN ' are standard in contract1' ELSE '' END AS text
  FROM conversations)"""

# --- markdown ----------------------------------------------------------------------

MARKDOWN = """
md AS (
  SELECT doc_id, 'doc_' || doc_id || '.md' AS document_id, 'doc_' || doc_id || '.md' AS source_file,
    array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
      CASE WHEN (i - 1) % 7 = 0 THEN '--- Page ' || ((i - 1) // 7 + 1) || ' ---' || chr(10) ELSE '' END
      || CASE WHEN (i - 1) % 11 = 4 THEN '### ' WHEN (i - 1) % 5 = 1 THEN '# ' WHEN (i - 1) % 5 = 3 THEN '## ' ELSE '' END
      || x || CASE WHEN (i - 1) % 3 = 0 THEN chr(10) ELSE '' END), chr(10)) AS value
  FROM documents)"""

CLEAN = r"regexp_replace(regexp_replace({}, '--- Page [0-9]+ \(OCR\) ---', '', 'g'), '\|\s*\|\s*\|\s*\n\|\s*---\s*\|\s*---\s*\|', '', 'g')"

# Page numbers that come again, OCR marks, empty table heads, and file names that documents share.
REPEATED = """
md AS (
  SELECT doc_id::VARCHAR AS document_id, 'file_' || (doc_id % 7) || '.md' AS source_file,
    array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
      CASE WHEN (i - 1) % 3 = 0 THEN '--- Page ' || (((i - 1) // 3) % 2 + 1) || ' ---' || chr(10) ELSE '' END
      || CASE WHEN (i - 1) % 5 = 1 THEN '# ' WHEN (i - 1) % 5 = 3 THEN '## ' ELSE '' END || x
      || CASE WHEN (i - 1) % 4 = 2 THEN chr(10) || '--- Page 9 (OCR) ---' WHEN (i - 1) % 4 = 3
        THEN chr(10) || '| | |' || chr(10) || '| --- | --- |' ELSE '' END), chr(10)) AS value
  FROM documents)"""

PAGES_OF = rf"""
page_lists AS (
  SELECT document_id, source_file, regexp_extract_all(value, '--- Page ([0-9]+) ---', 1) AS numbers,
    regexp_split_to_array(value, '--- Page [0-9]+ ---') AS parts
  FROM md WHERE {_strip('value')} <> ''),
page_rows AS (
  SELECT document_id, source_file, i AS segment_no, numbers[i]::BIGINT AS page_number,
    {_strip(CLEAN.format('parts[i + 1]'))} AS content
  FROM (SELECT *, unnest(range(1, len(numbers) + 1)) AS i FROM page_lists))"""

SECTIONS_OF = rf"""
lines AS (
  SELECT document_id, source_file, segment_no, page_number, i AS line_no,
    {_strip(r"regexp_replace(l[i], '[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]', '', 'g')")} AS line
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT *, string_split(content, chr(10)) AS l FROM page_rows))),
marked AS (
  SELECT *, CASE WHEN regexp_matches(line, '^#{{1,3}}( |$)') THEN len(regexp_extract(line, '^#+')) ELSE 0 END AS lvl
  FROM lines),
stated AS (
  SELECT *,
    max(CASE WHEN lvl = 1 THEN line_no END) OVER w AS a1, max(CASE WHEN lvl = 2 THEN line_no END) OVER w AS a2,
    max(CASE WHEN lvl = 3 THEN line_no END) OVER w AS a3
  FROM marked WINDOW w AS (PARTITION BY document_id, segment_no ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
titled AS (
  SELECT s.*, {_strip("regexp_replace(h1.line, '^#+', '')")} AS section,
    CASE WHEN s.a2 > coalesce(s.a1, 0) THEN {_strip("regexp_replace(h2.line, '^#+', '')")} END AS clause,
    CASE WHEN s.a3 > greatest(coalesce(s.a1, 0), coalesce(s.a2, 0))
      THEN {_strip("regexp_replace(h3.line, '^#+', '')")} END AS subclause
  FROM stated s
  LEFT JOIN marked h1 ON h1.document_id = s.document_id AND h1.segment_no = s.segment_no AND h1.line_no = s.a1
  LEFT JOIN marked h2 ON h2.document_id = s.document_id AND h2.segment_no = s.segment_no AND h2.line_no = s.a2
  LEFT JOIN marked h3 ON h3.document_id = s.document_id AND h3.segment_no = s.segment_no AND h3.line_no = s.a3),
body AS (
  SELECT *, coalesce(section, chr(1)) || chr(2) || coalesce(clause, chr(1)) || chr(2) || coalesce(subclause, chr(1)) AS meta
  FROM titled WHERE lvl = 0 AND line <> ''),
stepped AS (
  SELECT *, CASE WHEN meta IS DISTINCT FROM lag(meta) OVER w THEN 1 ELSE 0 END AS fresh,
    line_no - lag(line_no) OVER w AS gap
  FROM body WINDOW w AS (PARTITION BY document_id, segment_no ORDER BY line_no)),
numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY document_id, segment_no ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_no FROM stepped),
sections AS (
  SELECT document_id, source_file, segment_no, page_number, section_no, any_value(section) AS section, any_value(clause) AS clause,
    any_value(subclause) AS subclause,
    string_agg(CASE WHEN fresh = 1 THEN '' WHEN gap > 1 THEN '  ' || chr(10) ELSE chr(10) END || line, '' ORDER BY line_no)
      AS content
  FROM numbered GROUP BY document_id, source_file, segment_no, page_number, section_no),
carried AS (
  SELECT *, section IS NULL AND clause IS NULL AND subclause IS NULL AS bare,
    last_value(section IGNORE NULLS) OVER w AS s0, last_value(clause IGNORE NULLS) OVER w AS c0,
    last_value(subclause IGNORE NULLS) OVER w AS u0
  FROM sections WINDOW w AS (PARTITION BY document_id ORDER BY segment_no, section_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
paths AS (
  SELECT document_id, source_file, segment_no, page_number, section_no, content, coalesce(nullif(concat_ws(' > ',
    'section:' || CASE WHEN bare THEN s0 ELSE section END, 'clause:' || CASE WHEN bare THEN c0 ELSE clause END,
    'subclause:' || CASE WHEN bare THEN u0 ELSE subclause END), ''), 'document_content') AS header_path
  FROM carried)"""

PAGES = f"{MARKDOWN},{PAGES_OF}"
SECTIONS = f"{PAGES},{SECTIONS_OF}"
REPEATED_SECTIONS = f"{REPEATED},{PAGES_OF},{SECTIONS_OF}"



def _redaction() -> str:
    text = "text"
    marks = ((" of ", " [Redacted] "), (" la ", " xxXx "), (" und ", f" {BLOCK}{BLOCK} "), (" de ", " [[de]] "))
    for plain, mark in marks:
        text = f"replace({text}, '{plain}', '{mark}')"
    patterns = (r"(?i)\[REDACTED\]", "(?i)x{3,}", f"{BLOCK}+", r"\[\[.+?\]\]")
    cases = []
    for pattern in patterns:
        hit = f"regexp_extract(t, '{pattern}')"
        start = f"instr(t, {hit})"
        low = f"greatest({start} - 20, 1)"
        cases.append(
            f"WHEN regexp_matches(t, '{pattern}') THEN substring(substring(t, {low}, {start} + len({hit}) + 20 - {low}), 1, 200)"
        )
    return f"""WITH src AS (SELECT doc_id, {text} AS t FROM documents),
found AS (SELECT doc_id, CASE {' '.join(cases)} END AS redaction_snippet FROM src)
SELECT doc_id, redaction_snippet IS NOT NULL AS has_redaction, redaction_snippet FROM found"""


STEM = """CASE WHEN len(w) <= 3 THEN w
  WHEN w LIKE '%ies' AND len(w) > 4 THEN substring(w, 1, len(w) - 3) || 'y'
  WHEN w LIKE '%sses' THEN substring(w, 1, len(w) - 2)
  WHEN w LIKE '%ss' THEN w
  WHEN w LIKE '%s' THEN substring(w, 1, len(w) - 1)
  WHEN w LIKE '%ing' AND len(w) > 5 THEN substring(w, 1, len(w) - 3)
  WHEN w LIKE '%ed' AND len(w) > 4 THEN substring(w, 1, len(w) - 2) ELSE w END"""

PARAPHRASE = "(n_chars % 40) / 40.0::DOUBLE"
NLI = f"""WITH t AS (SELECT doc_id, nullif(n_chars % 4, 3) AS f, nullif(doc_id % 4, 3) AS b, {PARAPHRASE} AS p FROM documents)
SELECT doc_id, CASE WHEN f IS NULL OR b IS NULL THEN (p >= 0.9)::INT WHEN f = 0 AND b = 0 THEN 1 WHEN f = 2 OR b = 2 THEN 0
    WHEN f = 1 AND b = 1 AND p >= 0.9 THEN 1 ELSE 0 END::BIGINT AS standard,
  CASE WHEN f IS NULL OR b IS NULL THEN CASE WHEN p >= 0.9 THEN 'NLI unavailable, high paraphrase similarity: '
      || printf('%.3f', p) ELSE 'NLI unavailable, moderate paraphrase similarity' END
    WHEN f = 0 AND b = 0 THEN 'Both-way entailment: meanings aligned'
    WHEN f = 2 OR b = 2 THEN 'Contradiction detected'
    WHEN f = 1 AND b = 1 AND p >= 0.9 THEN 'Neutral NLI but high paraphrase similarity: ' || printf('%.3f', p)
    ELSE 'One-way or neutral entailment (pred1=' || f || ', pred2=' || b || ')' END AS reason FROM t"""

FORMAT_MARKDOWN = rf"""WITH src AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents),
marked AS (
  SELECT doc_id, i, CASE WHEN i % 4 = 1 THEN 'Section IV ' || line WHEN i % 4 = 2 THEN ' 12.' || i || '.3 ' || line
    WHEN i % 8 = 3 THEN '// ' || line ELSE line END AS line FROM src),
stripped AS (
  SELECT doc_id, i, j, {_strip('part')} AS line FROM (
    SELECT doc_id, i, unnest(p) AS part, generate_subscripts(p, 1) AS j FROM (
      SELECT *, regexp_split_to_array(line, '\r\n|[\n\r\x0b\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS p FROM marked))),
rendered AS (
  SELECT doc_id, i, j, CASE WHEN regexp_matches(line, '(?i)^(section|article)\s+[ivxlcdm]+') THEN '# ' || line
    WHEN regexp_matches(line, '^[0-9]+\.[0-9]+') THEN '## ' || regexp_extract(line, '^[0-9]+(\.[0-9]+)*')
      || coalesce(chr(10) || nullif({_strip(r"regexp_replace(line, '^[0-9]+(\.[0-9]+)*', '')")}, ''), '')
    ELSE line END AS line FROM stripped WHERE line <> '')
SELECT d.doc_id, coalesce(r.markdown, '') AS markdown FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i, j) AS markdown FROM rendered GROUP BY doc_id) r USING (doc_id)"""

ORACLES: dict[str, str] = {
    "corpus_counts": f"""WITH {COUNTS}
SELECT term, df AS documents, 0::BIGINT AS tokens FROM df WHERE term IN (SELECT term FROM q)
UNION ALL SELECT '', count(*), sum(len(t))::BIGINT FROM toks""",
    "bm25_scores": f"WITH {BM25} SELECT attribute_number, doc_idx, round(bm25_score, 6) AS bm25_score FROM bm",
    "bm25_topk": f"""WITH {FUSED} SELECT attribute_number, doc_idx, round(bm25_score, 6) AS bm25_score, bm25_rank AS rank FROM fused
WHERE bm25_rank <= 20""",
    "bm25_index_topk": f"""WITH {FUSED} SELECT attribute_number, doc_idx, round(bm25_score, 6) AS bm25_score, bm25_rank AS rank FROM fused
WHERE bm25_rank <= 20""",
    "dense_topk": f"WITH {DENSE} SELECT attribute_number, doc_idx, round(dense_similarity, 6) AS dense_similarity, rank FROM dense_ranked WHERE rank <= 20",
    "dense_topk_scaled": _dense_scaled(_l2),
    "dense_topk_scaled_cosine": _dense_scaled(_cosine),
    "rrf_topk": f"WITH {FUSED} SELECT attribute_number, doc_idx, rank, {FUSED_COLUMNS} FROM top WHERE rank <= 20",
    "rrf_all_in_one": f"WITH {_fused(60)} SELECT attribute_number, doc_idx, rank, {FUSED_COLUMNS} FROM top WHERE rank <= 10",
    "rrf_scores": f"WITH {FUSED} SELECT attribute_number, doc_idx, {FUSED_COLUMNS} FROM fused",
    "rrf_per_source_topk": f"""WITH {FUSED} SELECT attribute_number, doc_idx, source_file, rank_in_source, {FUSED_COLUMNS}
FROM per_source WHERE rank_in_source <= 15""",
    "format_matches": f"""WITH {FUSED} SELECT attribute_number, 'attribute_' || attribute_number AS attribute_name, rank,
  'doc_' || t.doc_idx AS chunk_id, t.source_file, n_chars // 1000 AS page, 'section:' || state AS section,
  CASE WHEN len(content) > 150 THEN substring(content, 1, 150) || '...' ELSE content END AS content_preview,
  sha256(content) AS content_sha FROM top t JOIN chunks c ON c.doc_idx = t.doc_idx WHERE rank <= 20""",
    "similarity_roundtrip": f"""WITH {FUSED} SELECT 'tables' AS collection_key, attribute_number,
  'attribute_' || attribute_number AS attribute_name, rank AS position, rank, 'doc_' || doc_idx AS chunk_id, source_file,
  round(rrf, 10) AS rrf_score, round(dense_similarity, 6) AS dense_similarity, round(bm25_score, 6) AS bm25_score
FROM top WHERE rank <= 20""",
    "similarity_roundtrip_per_source": f"""WITH {FUSED} SELECT 'tables' AS collection_key, attribute_number,
  'attribute_' || attribute_number AS attribute_name, rank_in_source AS position, rank_in_source AS rank,
  'doc_' || doc_idx AS chunk_id, source_file, round(rrf, 10) AS rrf_score,
  round(dense_similarity, 6) AS dense_similarity, round(bm25_score, 6) AS bm25_score
FROM per_source WHERE rank_in_source <= 2""",
    "match_stats": f"WITH {FUSED} {STATS} FROM top WHERE rank <= 20 GROUP BY attribute_number",
    "per_source_match_stats": f"WITH {FUSED} {STATS} FROM per_source WHERE rank_in_source <= 15 GROUP BY attribute_number",
    "attribute_caps": f"""WITH {FUSED} SELECT attribute_number, source_file, doc_idx, rank_in_source FROM per_source
WHERE rank_in_source <= 15 AND rank_in_source <= CASE attribute_number WHEN 1 THEN 7 WHEN 2 THEN 7 WHEN 3 THEN 3
  WHEN 4 THEN 5 WHEN 5 THEN 5 ELSE 15 END""",
    "dense_only_matcher": f"""WITH {DENSE} SELECT attribute_number, doc_idx, round(dense_similarity, 4) AS similarity, rank
FROM dense_ranked WHERE rank <= 10""",
    "dense_only_stats": f"""WITH {DENSE} SELECT attribute_number, round(avg(round(dense_similarity, 4)), 6) AS avg_similarity,
  max(round(dense_similarity, 4)) AS max_similarity,
  count(*) FILTER (round(dense_similarity, 4) > 0.7) AS high_confidence_matches
FROM dense_ranked WHERE rank <= 10 GROUP BY attribute_number""",
    "nearest_three": f"""WITH {CHUNKS} SELECT doc_idx, round(s, 6) AS similarity
FROM (SELECT doc_idx, round({_l2('v', QUERY_VECTOR)}, 12) AS s FROM chunks WHERE v IS NOT NULL) ORDER BY s DESC, doc_idx LIMIT 3""",
    "tokens": f"""SELECT doc_id, len({_tokens('text')})::BIGINT AS tokens,
  sha256(array_to_string({_tokens('text')}, ' ')) AS token_sha FROM documents""",
    "clean_text": rf"""SELECT doc_id, {_strip(f"regexp_replace(replace(text, '{BLOCK}', ''), '{SPACE}+', ' ', 'g')")} AS cleaned
FROM documents""",
    "preprocess_text": f"SELECT doc_id, {_preprocess('text')} AS preprocessed FROM documents",
    "token_counts": f"SELECT doc_id, len({_words('text')})::BIGINT AS token_count FROM documents",
    "lemma_rules": f"""WITH w AS (SELECT w, count(*) AS n FROM (SELECT unnest({_tokens('text')}) AS w FROM documents) GROUP BY w)
SELECT {STEM} AS stem, count(*) AS words, sum(n)::BIGINT AS occurrences FROM w GROUP BY ALL""",
    "redaction_detect": _redaction(),
    "chunk_flags": f"""WITH {CHUNKS}, c AS (SELECT *, lower(content) AS x, len({_words('content')}) AS size,
  CASE WHEN doc_idx % 3 = 0 THEN 'document_content' ELSE 'section:definitions > clause:' || state END AS h FROM chunks)
SELECT doc_idx, h <> 'document_content' AS has_header, contains(h, 'definition') AS is_definition,
  contains(h, 'clause:') AS is_clause, contains(h, 'section:') AS is_section,
  contains(x, 'compensation') OR contains(x, 'payment') OR contains(x, 'reimbursement') OR contains(x, 'rate')
    AS contains_compensation,
  contains(x, 'provider') AS contains_provider, contains(x, 'member') AS contains_member,
  contains(x, 'medicaid') AS contains_medicaid, contains(x, 'medicare') AS contains_medicare,
  contains(x, 'der ') AS contains_claims, contains(x, 'tion') OR contains(x, 'que la') AS contains_network,
  size < 50 AS is_short_chunk, size > 200 AS is_long_chunk, n_chars // 1000 = 1 AS is_first_page FROM c""",
    "attribute_flags": """SELECT item_id + 1 AS attribute_number, contains(lower(text), 'medicaid') AS has_medicaid,
  contains(lower(text), 'medicare') AS has_medicare, contains(lower(text), 'timely filing') AS has_timely_filing,
  contains(lower(text), 'fee schedule') AS has_fee_schedule,
  contains(lower(text), 'la ') OR contains(lower(text), 'der ') AS has_claims, contains(lower(text), 'tion') AS has_provider
FROM benchmark""",
    "page_range": """SELECT doc_id, 'page_' || (n_chars // 100 // 10 * 10 + 1) || '-' || ((n_chars // 100 // 10 + 1) * 10)
  AS page_range FROM documents""",
    "embedding_text": """SELECT doc_id AS doc_idx, CASE WHEN doc_id % 3 = 0 THEN text
  ELSE 'Section: section:' || lang || ' | Content: ' || text END AS text_to_embed FROM documents""",
    "sha256_ids": f"""WITH {CLAUSES}, s AS (SELECT *, sha256({_preprocess('raw_text')}) AS sha FROM clauses)
SELECT clause_id, sha AS preprocessed_sha256, concat_ws('::', 'proc', collection_key,
  CASE WHEN attribute_number = 1 THEN 'attr' ELSE (attribute_number - 1)::VARCHAR END, contract || '.v1',
  CASE WHEN clause_id % 4 > 0 THEN 'c' || clause_id ELSE 'chunk' END, (n_chars // 1000)::VARCHAR, substring(sha, 1, 16))
  || '::para' AS row_id FROM s""",
    "file_slugs": r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '^(.+)\.[^.]+$', '\1') AS stem
FROM pages) SELECT page_id, stem, regexp_replace(stem, '[^A-Za-z0-9_-]', '_', 'g') AS slug FROM s""",
    "collection_states": f"""WITH k AS (SELECT {LANG_KEY} AS key FROM documents)
SELECT key[1:2] AS state, key[1:2] AS state_in_name, CASE WHEN key LIKE '%standard' THEN 'template' ELSE 'contract' END AS kind,
  count(*) AS chunks FROM k GROUP BY ALL""",
    "l2_normalize": """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e,
  list_transform(embedding::DOUBLE[], lambda x: x * label) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM s)
SELECT vec_id, CASE WHEN norm > 0 THEN round(v[1] / norm, 6) END AS first, CASE WHEN norm > 0 THEN round(v[-1] / norm, 6) END
  AS last, CASE WHEN norm > 0 THEN round(1 - (list_dot_product(e, e) + 1 - 2 * list_dot_product(e, v) / norm), 4) END AS similarity FROM n""",
    "clause_number": """SELECT doc_id AS row_index, CASE WHEN doc_id % 3 > 0 THEN (n_chars % 5 + 1) || '.1' ELSE 'N/A' END
  AS clause_number FROM documents""",
    "query_keywords": f"""WITH {MESSAGES} SELECT session_id, seq,
  array_to_string(list_filter({_words('lower(text)')}, lambda w: len(w) > 2), '|') AS keywords FROM msg""",
    "intent_parse": f"""WITH {MESSAGES}, l AS (SELECT session_id, seq, ' ' || lower(text) || ' ' AS t FROM msg)
SELECT session_id, seq, CASE WHEN contains(t, 'tn contract 1') OR contains(t, 'contract1') THEN 'TN_Contract1'
    WHEN contains(t, 'tn contract 2') THEN 'TN_Contract2' WHEN contains(t, 'tn contract 3') THEN 'TN_Contract3'
    WHEN contains(t, 'tn contract 4') THEN 'TN_Contract4' WHEN contains(t, 'tn contract 5') THEN 'TN_Contract5'
    WHEN contains(t, ' wa ') THEN 'WA' WHEN contains(t, ' tn ') THEN 'TN' END AS contract_filter,
  CASE WHEN contains(t, 'non-standard') OR contains(t, 'non standard') THEN 0 WHEN contains(t, 'standard') THEN 1 END::BIGINT
    AS standard_filter FROM l""",
    "single_line": rf"""WITH {MESSAGES} SELECT session_id, seq, {_strip(
        f"regexp_replace(string_split({_strip("replace(' Answer: ' || text, 'Answer:', '')")}, chr(10))[1], '{SPACE}+', ' ', 'g')"
    )} AS line FROM msg""",
    "format_markdown": FORMAT_MARKDOWN,
    "table_to_md": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
r AS (SELECT doc_id, list_transform(l, lambda x: '| ' || array_to_string(string_split(x, ' '), ' | ') || ' |') AS r,
  '| ' || array_to_string(list_transform(string_split(l[1], ' '), lambda x: '---'), ' | ') || ' |' AS rule FROM l)
SELECT doc_id, array_to_string(list_concat([r[1], rule], r[2:]), chr(10)) AS markdown FROM r""",
    "collection_versions": """WITH rows AS (
  SELECT doc_id::VARCHAR AS row_id, source AS collection_key, lang, n_chars::BIGINT AS n FROM documents)
SELECT row_id, collection_key, lang, n AS n_chars, 'first' AS version FROM rows WHERE lang <> 'de'
UNION ALL SELECT row_id, collection_key, lang, CASE WHEN regexp_matches(collection_key, '[02468]$') THEN 2 * n
  WHEN lang <> 'de' THEN n ELSE -n END, 'newest' FROM rows""",
    "parse_pages": f"WITH {PAGES} SELECT source_file, page_number, content FROM page_rows",
    "header_paths": f"WITH {SECTIONS} SELECT source_file, page_number, section_no::BIGINT AS section_no, header_path, content FROM paths",
    "header_paths_repeated": f"""WITH {REPEATED_SECTIONS} SELECT document_id, source_file, segment_no::BIGINT - 1 AS segment_no,
  page_number, section_no::BIGINT AS section_no, header_path, content FROM paths""",
    "header_paths_of_rows": f"""WITH {REPEATED_SECTIONS} SELECT document_id, source_file, segment_no::BIGINT - 1 AS segment_no,
  page_number, section_no::BIGINT AS section_no, header_path, content FROM paths""",
    "chunk_documents_coverage": f"""WITH {SECTIONS}, counted AS (
  SELECT document_id, segment_no::BIGINT - 1 AS segment_no, section_no::BIGINT AS section_no,
    len(regexp_replace(content, '{SPACE}', '', 'g'))::BIGINT AS covered FROM paths)
SELECT *, true AS in_place, true AS in_order, true AS within_size, true AS within_overlap FROM counted WHERE covered > 0""",
    "chunk_large_documents_coverage": f"""WITH {MARKDOWN}, counted AS (
  SELECT document_id, len(regexp_replace(value, '{SPACE}', '', 'g'))::BIGINT AS covered FROM md)
SELECT *, true AS in_place, true AS in_order, true AS within_size, true AS within_overlap FROM counted WHERE covered > 0""",
    "chunk_ids": f"""WITH {SECTIONS}, kept AS (
  SELECT source_file, page_number, section_no, {_strip('content')} AS content FROM paths WHERE {_strip('content')} <> '')
SELECT regexp_replace(source_file, '\\.md$', '') || '_p' || page_number || '_c'
    || row_number() OVER (PARTITION BY source_file ORDER BY page_number, section_no) AS chunk_id,
  page_number, 1::BIGINT AS chunk_index, len({_words('content')})::BIGINT AS token_count, sha256(content) AS sha FROM kept""",
    "wa_chunk_metadata": rf"""WITH {MARKDOWN}, parts AS (
  SELECT doc_id, unnest(p) AS chunk, generate_subscripts(p, 1)::BIGINT - 1 AS part FROM (
    SELECT doc_id, string_split(value, chr(10) || chr(10)) AS p FROM md))
SELECT doc_id, part, coalesce(nullif(regexp_extract(chunk, '--- Page ([0-9]+) ---', 1), '')::BIGINT, 1) AS page,
  coalesce(nullif(regexp_extract(chunk, '(?m)^# (.+)$', 1), ''), 'General') AS section,
  nullif(regexp_extract(chunk, '(?m)^## ([0-9.]+)', 1), '') AS clause FROM parts""",
    "attribute_rows": f"""WITH cells AS (
  SELECT item_id, CASE WHEN item_id % 7 <> 3 THEN string_split(text, ' ')[1] ELSE '' END AS a,
    CASE WHEN item_id % 5 <> 0 THEN text ELSE '' END AS b, text AS c FROM benchmark),
clean AS (
  SELECT item_id, {_strip(f"regexp_replace(a, '{SPACE}+', ' ', 'g')")} AS a, {_strip(f"regexp_replace(b, '{SPACE}+', ' ', 'g')")} AS b,
    {_strip(f"regexp_replace(c, '{SPACE}+', ' ', 'g')")} AS c FROM cells),
joined AS (SELECT *, a || CASE WHEN b <> '' THEN ' ' || b ELSE '' END || ' ' || c AS content FROM clean WHERE a <> '')
SELECT 'attr_' || lpad((item_id + 1)::VARCHAR, greatest(3, len((item_id + 1)::VARCHAR))::INT, '0') AS chunk_id,
  item_id + 1 AS attribute_number, a AS attribute_name, content, len({_words('content')})::BIGINT AS token_count,
  'sheet.csv' AS source_file, 'attribute_definition' AS document_type FROM joined""",
    "page_batches": f"""WITH {PAGES} SELECT source_file, (page_number - 1) // 3 + 1 AS batch_no, count(*) AS pages,
  min(page_number) AS first_page FROM page_rows GROUP BY ALL""",
    "recombine_batches": f"""WITH {MARKDOWN}, lists AS (
  SELECT source_file, regexp_extract_all(value, '--- Page ([0-9]+) ---', 1) AS n,
    regexp_split_to_array(value, '--- Page [0-9]+ ---') AS p FROM md),
blocks AS (
  SELECT source_file, b AS block_no, chr(10) || chr(10) || '--- Batch ' || b || ' ---' || chr(10) || chr(10) || p[1]
    || array_to_string(list_transform(n, lambda x, i: '--- Page ' || (x::BIGINT + (b - 1) * 20) || ' ---' || p[i + 1]), '')
    AS value FROM (SELECT *, unnest([1, 2, 3]) AS b FROM lists)
  UNION ALL SELECT source_file, 0, '# ' || replace(source_file, '.md', '') || chr(10) || chr(10) FROM md)
SELECT source_file, block_no::BIGINT AS block_no, sha256(value) AS sha FROM blocks""",
    "unprocessed_documents": """SELECT doc_id, 'doc_' || doc_id || '.pdf' AS source_file FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "incremental_ingest": f"""WITH p AS (SELECT doc_id, {_preprocess('text')} AS t FROM documents)
SELECT doc_id, len({_words('t')})::BIGINT AS token_count, sha256(t) AS preprocessed_sha256 FROM p""",
    "exact_match_flag": f"WITH {SPLIT} SELECT clause_id, exact::BIGINT AS is_standard FROM flagged",
    "exact_match_only": f"WITH {SPLIT} SELECT clause_id, state, attribute_number FROM flagged WHERE exact = 1",
    "nearest_template": f"""WITH {SPLIT}, {_nearest('n', 'v', _l2)}
SELECT clause_id, round(similarity, 6) AS similarity, template_id FROM n""",
    "nearest_template_blocks": f"WITH {SPLIT}, {_nearest('n', 'v', _cosine)} SELECT clause_id, round(similarity, 6) AS similarity, template_id FROM n",
    "nearest_template_scaled": _nearest_scaled(_l2),
    "nearest_template_scaled_cosine": _nearest_scaled(_cosine),
    "best_template": f"""WITH {SCORED} SELECT clause_id, round(semantic_similarity, 6) AS semantic_similarity,
  round(paraphrase_similarity, 6) AS paraphrase_similarity,
  sha256(template_text) AS template_sha FROM scored""",
    "rule_flags": f"""WITH f AS (SELECT doc_id, {_flags(_preprocess('text'), (*RULE_PATTERNS, *TABLE_RULES))} AS f FROM documents)
SELECT doc_id, len(f)::BIGINT AS hits, array_to_string(f, '; ') AS flags FROM f""",
    "nli_truth_table": NLI,
    "negation_jaccard": f"""WITH p AS (
  SELECT c.conv_id, c.turn, {_negations('c.text', TABLE_NEGATORS)} AS cn, {_negations('t.text', TABLE_NEGATORS)} AS tn
  FROM conversations c JOIN conversations t ON t.conv_id = c.conv_id AND t.turn + 1 = c.turn)
SELECT conv_id, turn, {NEGATION_KEPT} AS maintains, {NEGATION_CASE} AS reason FROM p""",
    "classify_cascade": CASCADE,
    "summary_all": f"WITH {CLASSIFIED} {_summary(SUMMARY_SETS)}",
    "summary_overall": f"""WITH {CLASSIFIED} SELECT count(*) AS total_clauses, count(*) FILTER (is_standard = 1) AS standard_clauses,
  count(*) - count(*) FILTER (is_standard = 1) AS non_standard_clauses,
  round(count(*) FILTER (is_standard = 1) / count(*)::DOUBLE * 100, 6) AS standard_percentage FROM classified""",
    "summary_by_step": f"""WITH {CLASSIFIED} {BREAKDOWN.format(key="coalesce(classification_step, 'unknown')")}
FROM classified GROUP BY ALL""",
    "summary_by_attribute": f"WITH {CLASSIFIED} {BREAKDOWN.format(key='attribute_number::VARCHAR')} FROM classified GROUP BY ALL",
    "summary_by_state": f"WITH {CLASSIFIED} {BREAKDOWN.format(key='state')} FROM classified GROUP BY ALL",
    "summary_by_contract": f"""WITH {CLASSIFIED} SELECT section, contract, key, total, standard
FROM ({_summary(SUMMARY_SETS[4:])})""",
    "rule_flag_top10": f"""WITH {CLASSIFIED}, f AS (SELECT unnest(flags) AS flag FROM classified)
SELECT flag, count(*) AS clauses FROM f GROUP BY flag ORDER BY clauses DESC, flag LIMIT 10""",
    "similarity_means": f"""WITH {CLASSIFIED} SELECT round(avg(semantic_similarity), 6) AS avg_semantic,
  count(semantic_similarity) AS semantic_values, round(avg(paraphrase_similarity), 6) AS avg_paraphrase,
  count(paraphrase_similarity) AS paraphrase_values FROM classified""",
    "similarity_values": f"""WITH {CLASSIFIED} SELECT 'semantic' AS kind, semantic_similarity AS value FROM classified
WHERE semantic_similarity IS NOT NULL UNION ALL SELECT 'paraphrase', paraphrase_similarity FROM classified
WHERE paraphrase_similarity IS NOT NULL""",
    "contract_summary": f"""WITH {CLASSIFIED} SELECT contract, count(*) AS total_clauses,
  count(*) FILTER (is_standard = 1) AS standard_clauses, count(*) - count(*) FILTER (is_standard = 1) AS non_standard_clauses
FROM classified GROUP BY contract""",
    "non_standard_listing": f"""WITH {CLASSIFIED} SELECT contract, clause_id, state FROM classified
WHERE is_standard = 0 AND contains(lower(contract), 'src1')""",
    "non_standard_counts": f"""WITH {CLASSIFIED} SELECT contract, count(*) FILTER (is_standard = 0) AS non_standard
FROM classified GROUP BY contract""",
    "pie_standard": f"""WITH {METRICS}, t AS (SELECT sum(standard_count)::BIGINT AS s, sum(nonstandard_count)::BIGINT AS n FROM k)
SELECT 'Standard' AS label, s AS value, round(s * 100.0::DOUBLE / (s + n), 1) AS percentage, s + n AS total FROM t
UNION ALL SELECT 'Non-Standard', n, round(n * 100.0::DOUBLE / (s + n), 1), s + n FROM t""",
    "token_histogram": f"""WITH {METRICS}, b AS (SELECT min(token_length)::DOUBLE AS lo, max(token_length)::DOUBLE AS hi,
  (max(token_length) - min(token_length)) / 20.0::DOUBLE AS w, count(*) AS n FROM m),
c AS (SELECT least(floor((token_length - lo) / w), 19)::BIGINT AS bin, count(*) AS count FROM m, b GROUP BY ALL)
SELECT g.bin, round(lo + g.bin * w, 1) AS bin_start, round(lo + (g.bin + 1) * w, 1) AS bin_end,
  round(lo + (g.bin + 0.5::DOUBLE) * w, 1) AS bin_center, coalesce(count, 0) AS count,
  round(coalesce(count, 0) * 100.0::DOUBLE / n, 1) AS percentage
FROM (SELECT unnest(range(20)) AS bin) g CROSS JOIN b LEFT JOIN c ON c.bin = g.bin""",
    "token_stats": f"""WITH {METRICS} SELECT round(avg(token_length), 1) AS mean, round(median(token_length), 1) AS median,
  min(token_length)::BIGINT AS min, max(token_length)::BIGINT AS max, round(stddev_pop(token_length), 1) AS std FROM m""",
    "heatmap_attr_state": f"""WITH {METRICS}, g AS (
  SELECT a AS attribute, s AS state FROM (SELECT DISTINCT assigned_attribute AS a FROM m WHERE assigned_attribute IS NOT NULL),
    (SELECT DISTINCT state AS s FROM k)),
x AS (SELECT assigned_attribute AS attribute, state, avg(similarity) AS v, count(*) AS n FROM m JOIN k USING (contract_id)
  GROUP BY ALL)
SELECT attribute, state, round(coalesce(v, 0.0), 3) AS value, coalesce(n, 0) AS count FROM g LEFT JOIN x USING (attribute, state)""",
    "contract_bar": f"""WITH {METRICS} SELECT contract_id, string_split(contract_id, '_')[-1] AS contract_name, state,
  standard_count AS standard, nonstandard_count AS non_standard, standard_count + nonstandard_count AS total,
  coalesce(round(standard_count * 100.0::DOUBLE / nullif(standard_count + nonstandard_count, 0), 1), 0.0) AS standard_percentage
FROM k""",
    "attribute_bar": f"""WITH {METRICS} SELECT assigned_attribute AS attribute,
  count(*) FILTER (classification = 'standard') AS standard, count(*) FILTER (classification = 'nonstandard') AS non_standard,
  count(*) AS total, round(coalesce(avg(similarity), 0.0), 3) AS avg_similarity
FROM m WHERE assigned_attribute IS NOT NULL GROUP BY ALL""",
    "similarity_boxplot": f"""WITH {BOX} SELECT attribute, round(lo, 3) AS min, round(q1, 3) AS q1, round(med, 3) AS median,
  round(q3, 3) AS q3, round(hi, 3) AS max, round(mean, 3) AS mean, n AS count,
  (SELECT count(*) FROM out WHERE out.attribute = box.attribute) AS outliers FROM box""",
    "similarity_outliers": f"WITH {BOX} SELECT attribute, chunk_id, round(s, 3) AS similarity FROM out",
    "scatter_len_sim": f"""WITH {METRICS} SELECT CASE WHEN classification = 'standard' THEN 'standard' ELSE 'non_standard' END
  AS series, token_length::BIGINT AS x, round(coalesce(similarity, 0.0), 3) AS y, chunk_id AS clause_id, contract_id,
  assigned_attribute AS attribute FROM m""",
    "processing_timeline": f"""WITH {METRICS}, t AS (
  SELECT 'contract_' || source AS contract_id, sum(n_chars) / 1000.0::DOUBLE AS s FROM documents GROUP BY ALL
  UNION ALL SELECT 'lang_' || lang, sum(n_chars) / 1000.0::DOUBLE FROM documents GROUP BY ALL)
SELECT t.contract_id, string_split(t.contract_id, '_')[-1] AS contract_name, coalesce(state, 'Unknown') AS state,
  round(s, 2) AS processing_time, coalesce(num_chunks, 0) AS num_chunks FROM t LEFT JOIN k USING (contract_id)""",
    "wordcloud": f"""WITH w AS (SELECT unnest({_words('lower(text)')}) AS text FROM documents)
SELECT text, count(*) AS value, least(count(*) * 2, 100) AS size FROM w
WHERE len(text) > 3 AND text NOT IN {_list(WORDCLOUD_STOP_WORDS)} GROUP BY text ORDER BY value DESC, text LIMIT 50""",
    "keyword_search": f"""WITH {SEARCH} SELECT source_filename, row_index, attribute_name, page, clause_number,
  is_standard::BIGINT AS is_standard, substring(text, 1, 220) AS full_content_raw
FROM hits WHERE contains(lower(source_filename), 'src1') AND is_standard = 1 ORDER BY source_filename, row_index LIMIT 12""",
    "keyword_search_first_rows": f"""WITH {SEARCH} SELECT source_filename, row_index, attribute_name, page, clause_number,
  is_standard::BIGINT AS is_standard, substring(text, 1, 220) AS full_content_raw
FROM hits SEMI JOIN first_rows USING (source_filename, row_index) ORDER BY source_filename, row_index LIMIT 12""",
    "evidence_prompt": f"""WITH {SEARCH}, six AS (SELECT * FROM hits ORDER BY source_filename, row_index LIMIT 6)
SELECT 'Answer the user in ONE SHORT LINE of plain text (<= 20 words).' || chr(10)
  || 'Do NOT output JSON, lists, markdown, or multiple lines.' || chr(10)
  || 'Use only the provided evidence. If counting non-standard, isStandard=0.' || chr(10)
  || 'Question: of Attention to que' || chr(10) || 'Evidence: '
  || coalesce(string_agg({ITEM}, ' | ' ORDER BY source_filename, row_index), '(no items)')
  || chr(10) || 'Return exactly one concise line.' AS prompt FROM six""",
    "fallback_answer": f"""WITH {SEARCH},
zeros AS (SELECT * FROM hits WHERE is_standard = 0),
ordered AS (SELECT * FROM hits ORDER BY source_filename, row_index LIMIT 1)
SELECT 'count' AS kind, first(source_filename ORDER BY source_filename, row_index) || ': ' || count(*)
  || ' non-standard clauses' AS answer FROM zeros
UNION ALL SELECT 'item', 'Clause ' || clause_number || ' page ' || page || ' - ' || attribute_name FROM ordered
UNION ALL SELECT 'nothing', 'No relevant information found'""",
    "last_20_messages": f"""WITH {MESSAGES} SELECT role AS session_id, session_id * 100 + seq AS seq, text FROM msg
QUALIFY row_number() OVER (PARTITION BY role ORDER BY session_id * 100 + seq DESC) <= 20""",
    "history_read": f"""WITH {MESSAGES} SELECT session_id, seq, text FROM msg
WHERE session_id = (SELECT min(session_id) FROM msg)""",
    "history_clear": f"""WITH {MESSAGES} SELECT session_id, seq, text FROM msg
WHERE session_id <> (SELECT min(session_id) FROM msg)""",
    "session_history": f"""WITH {MESSAGES} SELECT session_id, seq, role, text FROM msg
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 3""",
    "first_rows_per_file": f"WITH {SEARCH} SELECT source_filename, row_index, position FROM first_rows",
}
