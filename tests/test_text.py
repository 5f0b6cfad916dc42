import hashlib
import re
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clauseloom.functions import text as T
from clauseloom.functions.lexicon import NUMBER_WORDS, RULE_PATTERNS, STOP_WORDS


def apply(spark, function, values, schema="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r.out for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def plain_preprocess(value):
    value = unicodedata.normalize("NFKC", value or "").lower()
    words = [w for w in re.split("[^a-z0-9]+", value) if w and w not in STOP_WORDS]
    return " ".join("num" if re.search("[0-9]", w) or w in NUMBER_WORDS else w for w in words)


SAMPLES = [
    "The ﬁnal oﬃce pays ３５ days",
    "a non breaking “quote” ‘x’",
    "```code``` | cell | three hundred sixty-five (365)",
    "the of and",
    "Café naïve",
    "",
    None,
    "Twenty-One years, 30th day",
]


def test_preprocess(spark):
    assert apply(spark, T.preprocess_text, SAMPLES) == [plain_preprocess(v) for v in SAMPLES]
    assert apply(spark, T.preprocess_text, ["three hundred sixty-five (365)"]) == ["num num num num num"]
    assert apply(spark, T.preprocess_text, ["The ﬁnal oﬃce"]) == ["final office"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=20, max_size=60))
def test_preprocess_property(spark, values):
    once = apply(spark, T.preprocess_text, values)
    assert once == [plain_preprocess(v) for v in values]
    # Its own output stays as it is.
    assert apply(spark, T.preprocess_text, once) == once


def test_clean_text_and_counts(spark):
    values = [None, " a ██ b　c\x1fd ", " x y\t"]
    assert apply(spark, T.clean_text, values) == ["", "a b c d", "x y"]
    texts = [None, "", " one two three\n", "x"]
    assert apply(spark, T.token_count, texts) == [len((t or "").split()) for t in texts]


def test_tokens(spark):
    values = ["", "snake_case Été 42!", "... !!", "A-b"]
    assert apply(spark, T.tokens, values) == [re.findall(r"\w+", v.lower()) for v in values]


def test_redaction_order_and_margins(spark):
    values = [
        None,
        "nothing here",
        "[redacted] starts",
        "ends with xxx",
        "first xxxx then [REDACTED] wins",
        "see ███ here",
        "see [[name]] and [[other]]",
        "[[broken\nover]] lines",
        "a" * 50 + "XXX" + "b" * 50,
        "\U0001F600" * 5 + "xxx" + "\U0001F600" * 30,
    ]
    found = apply(spark, T.redaction, values)
    assert [f.has_redaction for f in found] == [False, False, True, True, True, True, True, False, True, True]
    assert found[2].redaction_snippet == "[redacted] starts"
    assert found[4].redaction_snippet == "first xxxx then [REDACTED] wins"
    assert found[6].redaction_snippet == "see [[name]] and [[other]]"
    assert found[8].redaction_snippet == "a" * 20 + "XXX" + "b" * 20
    assert found[9].redaction_snippet == "\U0001F600" * 5 + "xxx" + "\U0001F600" * 20
    assert found[0].redaction_snippet is None


def test_stem(spark):
    words = ["bus", "cities", "ties", "classes", "class", "rates", "paying", "king", "paid", "ended", "need"]
    stems = ["bus", "city", "tie", "class", "class", "rate", "pay", "king", "paid", "end", "need"]
    assert apply(spark, T.light_stem, words) == stems


def test_page_range(spark):
    assert apply(spark, T.page_range, [1, 9, 10, 19, 20, None, 0], "int") == [
        "page_1-10", "page_1-10", "page_11-20", "page_11-20", "page_21-30", "page_1-10", "page_1-10",
    ]


def test_file_names(spark):
    names = ["a/b/TN Contract.v1.md", ".md", "plain", "x.y"]
    assert apply(spark, T.file_stem, names) == ["TN Contract.v1", ".md", "plain", "x"]
    assert apply(spark, T.file_slug, names[:1]) == ["TN_Contract_v1"]


def test_row_id(spark):
    sha = hashlib.sha256(b"x").hexdigest()
    rows = spark.createDataFrame(
        [("TNstandard", 2, "f.v1.md", "c1", 3, sha), ("", 0, None, "", None, None)],
        "k string, a int, f string, c string, p int, s string",
    )
    ids = [r[0] for r in rows.select(T.row_id(*[F.col(n) for n in "kafcps"], suffix="::qwen")).collect()]
    assert ids == [f"proc::TNstandard::2::f.v1::c1::3::{sha[:16]}::qwen", "proc::col::attr::src::chunk::0::::qwen"]


@pytest.mark.parametrize(
    "message, contract, standard",
    [
        ("show TN Contract 12", "TN_Contract1", None),
        ("Contract1 standard?", "TN_Contract1", 1),
        ("what is Non standard in WA", "WA", 0),
        ("tn non-standard clauses", "TN", 0),
        ("twain", None, None),
        ("wa and tn", "WA", None),
        ("tn contract 5", "TN_Contract5", None),
    ],
)
def test_intents(spark, message, contract, standard):
    assert apply(spark, T.contract_hint, [message]) == [contract]
    assert apply(spark, T.standard_hint, [message]) == [standard]


def test_small_helpers(spark):
    assert apply(spark, T.clause_number, ["section:A > Clause : 3.1 > x", "none", None]) == ["3.1", "N/A", "N/A"]
    assert apply(spark, T.single_line, ["Answer:  a  b\nc", "\n x"]) == ["a b", "x"]
    assert apply(spark, lambda c: T.preview(c, 3), ["abcd", "abc", None]) == ["abc...", "abc", None]
    assert apply(spark, T.state_in_name, ["xWAyTN", "WAstandard", "zz", None]) == ["TN", "WA", "unknown", "unknown"]
    assert apply(spark, T.state_of_collection, ["TNredacted", "WAstandard", "other"]) == ["TN", "WA", None]
    assert apply(spark, T.query_keywords, ["What of the RATE"]) == [["what", "the", "rate"]]
    assert apply(spark, T.try_int, ["5", "x", None]) == [5, None, None]


def test_embedding_text(spark):
    rows = spark.createDataFrame([("section:A", "c"), ("document_content", "c"), (None, "c")], "h string, c string")
    found = [r[0] for r in rows.select(T.text_to_embed(F.col("h"), F.col("c"))).collect()]
    assert found == ["Section: section:A | Content: c", "c", "c"]


def test_chunk_flags(spark):
    rows = spark.createDataFrame(
        [("Payment to Provider", "section:Definitions > clause:1", 30, 1), ("x", None, None, None), ("x", "document_content", 201, 2)],
        "c string, h string, t int, p int",
    )
    found = rows.select(*T.chunk_flags(*[F.col(n) for n in "chtp"])).collect()
    assert found[0].has_header and found[0].is_definition and found[0].is_clause and found[0].contains_compensation
    assert found[0].contains_provider and not found[0].contains_member and found[0].is_short_chunk and found[0].is_first_page
    assert not found[1].has_header and found[1].is_short_chunk and not found[1].is_first_page
    assert not found[2].has_header and found[2].is_long_chunk


def test_fixed_values_are_whole():
    assert len(RULE_PATTERNS) == 23
    assert len(NUMBER_WORDS) == 32
    assert len(set(STOP_WORDS)) == len(STOP_WORDS)


def test_nfkc_makes_objects_of_a_few_rows_at_a_time():
    pieces = list(T._nfkc.func(iter([pa.array(["ﬁ"] * 300 + [None])])))
    assert max(map(len, pieces)) <= 64
    assert [value for piece in pieces for value in piece.to_pylist()] == ["fi"] * 300 + [None]
