import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clauseloom.functions import markdown as M
from clauseloom.functions.steps import STEP_ROWS, each
from clauseloom.operators import chunking as C
from clauseloom.operators import splitting as S


def one(spark, function, value, schema="string"):
    return spark.createDataFrame([(value,)], f"v {schema}").select(function(F.col("v")).alias("out")).first().out


def test_format_markdown(spark):
    source = "SECTION IV Scope\n body one \n\nbody two\n3.1.2 Payment due\n120.5 days\n4.2\n// note\nArticle about\nend"
    assert one(spark, M.format_markdown, source) == (
        "# SECTION IV Scope\nbody one\nbody two\n## 3.1.2\nPayment due\n## 120.5\ndays\n## 4.2\n// note\nArticle about\nend"
    )
    # Rule (a) is a case-insensitive prefix match, so prose can become a header.
    assert one(spark, M.format_markdown, "Section described") == "# Section described"
    strict = one(spark, lambda c: M.format_markdown(c, strict=True), "Section described\n120.5 days\n3.1 Payment")
    assert strict == "Section described\n120.5 days\n## 3.1\nPayment"


def test_table(spark):
    table = [["A", None], ["1", "2"], ["", "x"]]
    expected = "| A |  |\n| --- | --- |\n| 1 | 2 |\n|  | x |"
    assert one(spark, M.table_to_markdown, table, "array<array<string>>") == expected
    assert one(spark, M.table_to_markdown, [["A"]], "array<array<string>>") == "| A |\n| --- |"
    assert one(spark, M.table_to_markdown, [], "array<array<string>>") == ""


def test_pages(spark):
    text = "lost\n--- Page 2 ---\n one \n--- Page 3 (OCR) ---\nstill two\n--- Page 10 ---\n"
    found = one(spark, M.pages, text)
    assert [(p.page_number, p.content) for p in found] == [(2, "one \n--- Page 3 (OCR) ---\nstill two"), (10, "")]
    assert one(spark, M.clean_page, found[0].content) == "one \n\nstill two"
    assert one(spark, M.clean_page, "|  |  |\n| --- | --- |") == ""
    assert one(spark, M.pages, "no marker") == []


def sections(spark, text):
    documents = spark.createDataFrame([("f.md", text)], "source_file string, value string")
    rows = C.carry_headers(C.header_sections(C.split_pages(documents)))
    found = rows.select("segment_no", "page_number", "section_no", C.header_path().alias("path"), "content").collect()
    # A document in one row, parsed where it lies, gives the same.
    whole = C.document_sections(documents).select(F.inline("sections")).withColumn("path", C.header_path())
    assert sorted(whole.select("segment_no", "page_number", "section_no", "path", "content").collect()) == sorted(found)
    return [(r.page_number, r.path, r.content) for r in sorted(found)]


def test_header_sections(spark):
    text = (
        "--- Page 1 ---\nintro\n# A\npara one\nline two\n\npara two\n## B\nunder b\n# C\nunder c\n"
        "--- Page 2 ---\nbare page\n## D\nunder d\n### E\nunder e\n--- Page 3 ---\nlast"
    )
    assert sections(spark, text) == [
        (1, "document_content", "intro"),
        (1, "section:A", "para one\nline two  \npara two"),
        (1, "section:A > clause:B", "under b"),
        (1, "section:C", "under c"),
        # A page without headers inherits all levels seen so far, stale ones included.
        (2, "section:C > clause:B", "bare page"),
        (2, "clause:D", "under d"),
        (2, "clause:D > subclause:E", "under e"),
        (3, "section:C > clause:D > subclause:E", "last"),
    ]


def test_headers_inside_fences_are_text(spark):
    text = "--- Page 1 ---\n# A\n```\n# not a header\n\nx\n```\nafter\n####  deep\n#tag"
    assert sections(spark, text) == [(1, "section:A", "```\n# not a header\n\nx\n```\nafter\n####  deep\n#tag")]


def test_repeated_header_joins_sections(spark):
    assert sections(spark, "--- Page 1 ---\n# A\none\n# A\ntwo") == [(1, "section:A", "one  \ntwo")]


def test_split_keeps_separators_and_overlaps():
    text = "one two three. four five six. seven eight nine"
    found = S.split_recursively(text, 5, 2, C.SEPARATORS, S.word_length)
    assert found == ["one two three", ". four five six", ". seven eight nine"]
    found = S.split_recursively("a b c d e f", 3, 1, C.SEPARATORS, S.word_length)
    assert found == ["a b c", "c d e", "e f"]
    assert S.split_recursively("abcdefghij", 4, 1, C.LARGE_SEPARATORS) == ["abcd", "defg", "ghij"]
    assert S.split_recursively("", 4, 1, C.LARGE_SEPARATORS) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=120), st.integers(2, 20), st.integers(0, 8))
def test_split_properties(text, size, overlap):
    overlap = min(overlap, size - 1)
    found = S.split_recursively(text, size, overlap, C.LARGE_SEPARATORS)
    assert all(0 < len(piece) <= size for piece in found)
    # Nothing is lost and the order is kept.
    position = 0
    for piece in found:
        start = text.find(piece, max(0, position - size))
        assert start >= 0
        position = max(position, start + len(piece))
    assert sum(c in "ab" for c in text) <= sum(c in "ab" for piece in found for c in piece)


def test_chunk_documents(spark):
    body = " ".join(f"w{i}" for i in range(700))
    text = f"--- Page 1 ---\n# A\nshort\n--- Page 2 ---\n{body}"
    documents = spark.createDataFrame([("x.md", text), ("blank.md", "  \n")], "source_file string, value string")
    rows = C.chunk_documents(documents).orderBy(F.length("chunk_id"), "chunk_id").collect()
    assert [r.chunk_id for r in rows] == [f"x_p{1 if i == 1 else 2}_c{i}" for i in range(1, len(rows) + 1)]
    assert all(r.token_count <= 300 for r in rows)
    assert {r.header_path for r in rows} == {"section:A"}
    assert [r.chunk_index for r in rows] == [1, *range(1, len(rows))]
    words = {w for r in rows for w in r.content.split()}
    assert words == {"short", *body.split()}


def test_large_documents(spark):
    text = "--- Page 4 ---\n# Scope of work\n## 2.1. Terms\n" + "word " * 400
    documents = spark.createDataFrame([("big.md", text)], "source_file string, value string")
    rows = C.chunk_large_documents(documents).orderBy("chunk_index").collect()
    assert rows[0].chunk_id == "big_chunk_0001" and rows[0].total_chunks == len(rows) == 4
    assert (rows[0].page, rows[0].section, rows[0].clause) == (4, "Scope of work", "2.1.")
    assert (rows[1].page, rows[1].section, rows[1].clause) == (1, "General", None)


def test_attribute_rows(spark):
    sheet = spark.createDataFrame(
        [(0, " Fee  name ", "def █ x", None), (1, None, "skipped", "s"), (2, "Only", None, " ")],
        "row_index long, a string, b string, c string",
    )
    rows = C.attribute_rows(sheet, "row_index", ["a", "b", "c"], "sheet.xlsx").orderBy("attribute_number").collect()
    assert [(r.chunk_id, r.attribute_number, r.attribute_name, r.content) for r in rows] == [
        ("attr_001", 1, "Fee name", "Fee name def x"),
        ("attr_003", 3, "Only", "Only"),
    ]


def test_recombine_counts_pages_through(spark):
    batches = spark.createDataFrame(
        [("f.md", 1, "--- Page 1 ---\na"), ("f.md", 2, "--- Page 1 ---\nb\n--- Page 2 (OCR) ---\nc")],
        "source_file string, batch_no int, value string",
    )
    rows = C.recombine_batches(batches, 10).orderBy("block_no").collect()
    assert "".join(r.value for r in rows) == (
        "# f\n\n\n\n--- Batch 1 ---\n\n--- Page 1 ---\na\n\n--- Batch 2 ---\n\n--- Page 11 ---\nb\n--- Page 12 (OCR) ---\nc"
    )


def test_repeated_page_numbers_are_segments_of_their_own(spark):
    text = "--- Page 1 ---\n# one\nalpha\nbeta\n--- Page 1 ---\n# two\ngamma\ndelta"
    assert sections(spark, text) == [(1, "section:one", "alpha\nbeta"), (1, "section:two", "gamma\ndelta")]


def test_equal_file_names_stay_apart(spark):
    rows = [("a/x.md", "x.md", "--- Page 1 ---\n# A\nfirst"), ("b/x.md", "x.md", "--- Page 1 ---\nsecond")]
    documents = spark.createDataFrame(rows, "document_id string, source_file string, value string")
    found = sorted((r.document_id, r.chunk_id, r.header_path, r.content) for r in C.chunk_documents(documents).collect())
    assert found == [("a/x.md", "x_p1_c1", "section:A", "first"), ("b/x.md", "x_p1_c1", "document_content", "second")]


headers = st.tuples(*[st.one_of(st.none(), st.text("ab", max_size=2))] * 3)


@given(headers, headers, headers)
def test_later_headers_are_associative(a, b, c):
    assert C.later_headers(C.later_headers(a, b), c) == C.later_headers(a, C.later_headers(b, c))
    assert C.later_headers(C.NO_HEADERS, a) == a == C.later_headers(a, C.NO_HEADERS)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n\u3000", max_size=80))
def test_running_totals_of_words(text):
    costs = S.word_costs(text)
    for step in (1, 2, 3, 7):
        places = S.np.array([*range(0, len(text), step), len(text)])
        assert costs(places) == [len(text[i:j].split()) for i, j in zip(places[:-1], places[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=40), st.integers(1, 20), st.integers(0, 25))
def test_packing_equals_adding_piece_by_piece(costs, size, overlap):
    want, window, total = [], [], 0
    for at, cost in enumerate(costs):
        if window and total + cost > size:
            want.append((window[0], at))
            while window and (total > overlap or (total > 0 and total + cost > size)):
                total -= costs[window.pop(0)]
        window.append(at)
        total += cost
    if window:
        want.append((window[0], len(costs)))
    assert list(S.packed(range(len(costs) + 1), costs, size, overlap)) == want


def test_texts_no_separator_cuts():
    assert S.split_places("x" * 2500, 1000, 200, C.LARGE_SEPARATORS) == [(0, "x" * 1000), (800, "x" * 1000), (1600, "x" * 900)]
    assert S.split_places("x" * 50 + " ", 10, 2, ("\n",)) == [(0, "x" * 50 + " ")]
    assert S.split_places(" a b ", 10, 2, C.SEPARATORS) == [(1, "a b")]


def test_parsing_and_chunking_exchange_nothing(spark):
    documents = spark.createDataFrame([("a.md", "--- Page 1 ---\n# A\nx"), (None, None)], "source_file string, value string")
    for rows in (C.chunk_documents(documents), C.chunk_large_documents(documents), C.document_sections(documents)):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [r.content for r in C.chunk_documents(documents).collect()] == ["x"]


def test_page_numbers_are_not_made_anew_for_every_section(spark):
    table = spark.createDataFrame([("a.md", "--- Page 4 ---\n# A\nx\n--- Page 6 ---\ny")], "source_file string, value string")
    sections = C.document_sections(table)
    assert [(s.page_number, s.section, s.content) for s in sections.first().sections] == [(4, "A", "x"), (6, "A", "y")]
    plan = sections._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"get\(pages#\d+\.page_number", plan)


def test_python_steps_bound_the_rows_held_as_objects(spark):
    made = each(lambda value: [value] * 2, "array<string>", pa.list_(pa.string()))
    pieces = list(made.func(iter([pa.array([None, *map(str, range(199))]), pa.array([], pa.string())])))
    assert max(map(len, pieces)) <= STEP_ROWS and sum(map(len, pieces)) == 200
    assert pieces[0][:2].to_pylist() == [None, ["0", "0"]]
    texts = spark.range(0, 500, 1, 1).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("a b "), F.col("id").cast("string"))).alias("t"))
    found = texts.select("t", C.recursive_splits(F.col("t"), 2, 0).alias("parts")).collect()
    assert all((r.t is None) == (r.parts is None) for r in found)
    assert all("".join(p.content for p in r.parts).replace(" ", "") == r.t.replace(" ", "") for r in found if r.t)
