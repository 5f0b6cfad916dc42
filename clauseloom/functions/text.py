"""Text functions over columns. All but ``nfkc`` stay inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Mapping
from functools import partial

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clauseloom.functions.lexicon import (
    ATTRIBUTE_TERMS,
    CHUNK_CONTENT_TERMS,
    COLLECTION_STATES,
    CONTRACT_HINTS,
    NUMBER_WORDS,
    REDACTION_PATTERNS,
    STOP_WORDS,
)
from clauseloom.functions.steps import each

# Unicode white space, with the separators that Python's str.split also treats as such.
SPACES = r"(?U)[\s\x1c-\x1f]+"
SPACE_CHARACTERS = "".join(character for character in map(chr, range(0x3001)) if character.isspace())
WORD = r"([\p{L}\p{N}_]+)"
# Characters that NFKC never changes: ASCII and precomposed Latin-1 letters; then also
# dashes, quotes and blocks. The first, simpler class decides for nearly all rows.
PLAIN = r"\x00-\x7F\u00C0-\u00FF"
NFKC_STABLE = PLAIN + r"\u2013\u2014\u2018\u2019\u201c\u201d\u2588"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """Apply ``body`` to a value that it uses many times, computing the value once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPACES, " "))


def clean_text(text: Column) -> Column:
    """NULL becomes '', block characters vanish, whitespace collapses."""
    return collapse_spaces(F.replace(F.coalesce(text, F.lit("")), F.lit("█"), F.lit("")))


def words(text: Column) -> Column:
    """Non-empty whitespace-separated words."""
    return F.filter(F.split(text, SPACES), lambda word: word != "")


def token_count(text: Column) -> Column:
    """Whitespace word count, the tokenizer-free form of the token count."""
    return F.size(words(F.coalesce(text, F.lit(""))))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


_nfkc = each(partial(unicodedata.normalize, "NFKC"), StringType(), pa.string())


def nfkc(text: Column) -> Column:
    """NFKC form. Rows that cannot change travel to Python as NULL, at almost no cost."""
    may_change = text.rlike(f"[^{PLAIN}]") & text.rlike(f"[^{NFKC_STABLE}]")
    return F.coalesce(_nfkc(F.when(may_change, text)), text)


def normalize_words(
    text: Column,
    stop_words: Iterable[str] = STOP_WORDS,
    number_words: Iterable[str] = NUMBER_WORDS,
) -> Column:
    """The steps of ``preprocess_text`` after Unicode normalisation.

    Quotes, code fences, table pipes and white space need no steps of their own:
    everything outside [a-z0-9] separates words.
    """
    stop_words, number_words = list(stop_words), list(number_words)
    plain = F.lower(F.coalesce(text, F.lit("")))
    kept = F.filter(F.split(plain, "[^a-z0-9]+"), lambda word: (word != "") & ~word.isin(stop_words))
    masked = F.transform(
        kept,
        lambda word: F.when(word.rlike("[0-9]") | word.isin(number_words), F.lit("num")).otherwise(word),
    )
    return F.array_join(masked, " ")


def preprocess_text(text: Column) -> Column:
    """Comparable form of a clause: ASCII words without stop words, numbers masked."""
    return normalize_words(nfkc(text))


def light_stem(word: Column) -> Column:
    """Suffix rules for plural, -ing and -ed forms with length guards."""
    size = F.char_length(word)

    def drop(count: int) -> Column:
        return F.substring(word, F.lit(1), size - count)

    return (
        F.when(size <= 3, word)
        .when(word.endswith("ies") & (size > 4), F.concat(drop(3), F.lit("y")))
        .when(word.endswith("sses"), drop(2))
        .when(word.endswith("ss"), word)
        .when(word.endswith("s"), drop(1))
        .when(word.endswith("ing") & (size > 5), drop(3))
        .when(word.endswith("ed") & (size > 4), drop(2))
        .otherwise(word)
    )


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def redaction(text: Column, patterns: Iterable[str] = REDACTION_PATTERNS, margin: int = 20) -> Column:
    """STRUCT<has_redaction, redaction_snippet>; the first pattern that hits wins."""

    def window(value: Column, pattern: str) -> Column:
        before = F.regexp_extract(value, f"^((?s:.*?))(?:{pattern})", 1)
        hit = F.regexp_extract(value, pattern, 0)
        start = F.greatest(F.char_length(before) - margin, F.lit(0))
        end = F.char_length(before) + F.char_length(hit) + margin
        return F.substring(F.substring(value, start + 1, end - start), 1, 200)

    def snippet(value: Column) -> Column:
        return F.coalesce(*[F.when(value.rlike(pattern), window(value, pattern)) for pattern in patterns])

    def finding(found: Column) -> Column:
        return F.struct(found.isNotNull().alias("has_redaction"), found.alias("redaction_snippet"))

    return once(once(F.coalesce(text, F.lit("")), snippet), finding)


def preview(text: Column, length: int) -> Column:
    return F.when(F.char_length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def has_header(header_path: Column) -> Column:
    header_path = F.coalesce(header_path, F.lit(""))
    return (strip(header_path) != "") & (header_path != "document_content")


def text_to_embed(header_path: Column, content: Column) -> Column:
    """Content with its header context in front when there is one."""
    header_path = F.coalesce(header_path, F.lit(""))
    return F.when(
        (header_path != "") & (header_path != "document_content"),
        F.concat(F.lit("Section: "), header_path, F.lit(" | Content: "), content),
    ).otherwise(content)


def term_flags(text: Column, flags: Mapping[str, Iterable[str]]) -> list[Column]:
    """One boolean per flag: does the lower-cased text contain any of its terms?"""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    columns = []
    for name, terms in flags.items():
        hit = F.lit(False)
        for term in terms:
            hit = hit | lowered.contains(term)
        columns.append(hit.alias(name))
    return columns


def chunk_flags(
    content: Column,
    header_path: Column,
    token_total: Column,
    page: Column,
    terms: Mapping[str, Iterable[str]] = CHUNK_CONTENT_TERMS,
) -> list[Column]:
    """Metadata flags of a chunk."""
    header = F.lower(F.coalesce(header_path, F.lit("")))
    size = F.coalesce(token_total, F.lit(0))
    return [
        has_header(header_path).alias("has_header"),
        header.contains("definition").alias("is_definition"),
        header.contains("clause:").alias("is_clause"),
        header.contains("section:").alias("is_section"),
        *term_flags(content, terms),
        (size < 50).alias("is_short_chunk"),
        (size > 200).alias("is_long_chunk"),
        (F.coalesce(page, F.lit(0)) == 1).alias("is_first_page"),
    ]


def attribute_flags(content: Column, terms: Mapping[str, Iterable[str]] = ATTRIBUTE_TERMS) -> list[Column]:
    return term_flags(content, terms)


def page_range(page: Column) -> Column:
    """Bucket label of ten pages; page 10 belongs to 11-20."""
    decade = F.floor(F.coalesce(page, F.lit(0)) / 10).cast("long")
    return F.concat(
        F.lit("page_"), (decade * 10 + 1).cast("string"), F.lit("-"), ((decade + 1) * 10).cast("string")
    )


def file_stem(name: Column) -> Column:
    """File name without folders and without its last extension."""
    return F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"^(.+)\.[^.]+$", "$1")


def file_slug(name: Column) -> Column:
    return F.regexp_replace(file_stem(name), "[^A-Za-z0-9_-]", "_")


def row_id(
    collection_key: Column,
    attribute_number: Column,
    source_file: Column,
    chunk_id: Column,
    page: Column,
    sha: Column,
    suffix: str = "",
) -> Column:
    """Stable clause id; empty parts (and number 0) are replaced by placeholders."""

    def text_or(value: Column, placeholder: str) -> Column:
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(placeholder))

    parts = [
        F.lit("proc"),
        text_or(collection_key, "col"),
        F.coalesce(F.nullif(attribute_number.cast("string"), F.lit("0")), F.lit("attr")),
        file_stem(text_or(source_file, "src")),
        text_or(chunk_id, "chunk"),
        F.coalesce(page, F.lit(0)).cast("string"),
        F.substring(F.coalesce(sha, F.lit("")), 1, 16),
    ]
    return F.concat(F.concat_ws("::", *parts), F.lit(suffix))


def state_of_collection(collection_key: Column, states: Mapping[str, str] = COLLECTION_STATES) -> Column:
    """Exact lookup; unknown collections give NULL."""
    result = F.lit(None).cast("string")
    for key, state in states.items():
        result = F.when(collection_key == key, F.lit(state)).otherwise(result)
    return result


def state_in_name(name: Column, states: Iterable[str] = ("TN", "WA")) -> Column:
    """First state code contained in the name, else 'unknown'."""
    name = F.coalesce(name, F.lit(""))
    return F.coalesce(*[F.when(name.contains(state), F.lit(state)) for state in states], F.lit("unknown"))


def clause_number(section: Column) -> Column:
    found = F.regexp_extract(F.coalesce(section, F.lit("")), r"(?i)clause\s*:\s*([^>\s]+)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("N/A"))


def query_keywords(query: Column) -> Column:
    """Lower-cased words longer than two characters."""
    return F.filter(words(F.lower(query)), lambda word: F.char_length(word) > 2)


def contract_hint(message: Column, hints: Iterable[tuple[str, str]] = CONTRACT_HINTS) -> Column:
    """File filter hinted at by a chat message; the first hint that is contained wins."""
    padded = F.concat(F.lit(" "), F.lower(message), F.lit(" "))
    return F.coalesce(*[F.when(padded.contains(needle), F.lit(target)) for needle, target in hints])


def standard_hint(message: Column) -> Column:
    """0 for a question about non-standard clauses, 1 for standard ones, else NULL."""
    message = F.lower(message)
    return F.when(message.contains("non-standard") | message.contains("non standard"), F.lit(0)).when(
        message.contains("standard"), F.lit(1)
    )


def single_line(text: Column) -> Column:
    """First line of an answer without its label, spaces collapsed."""
    body = strip(F.replace(text, F.lit("Answer:"), F.lit("")))
    return collapse_spaces(F.element_at(F.split(body, "\n"), 1))


def try_int(value: Column) -> Column:
    return value.try_cast("int")
