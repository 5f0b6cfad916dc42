import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseloom.operators import charts, report, search

CLASSIFIED = (
    "contract string, attribute_number int, state string, is_standard int, classification_step string, "
    "rule_flags array<string>, semantic_similarity double, paraphrase_similarity double"
)


@pytest.fixture(scope="module")
def classified(spark):
    rows = [
        ("TN_1", 1, "TN", 1, "step1_exact_match", None, None, None),
        ("TN_1", 1, "TN", 0, "step6_rule_flags", ["b", "a"], 0.5, 0.8),
        ("TN_1", 2, "TN", None, None, [], None, None),
        ("WA_1", 10, "WA", 1, "step2_semantic", ["a"], 0.9, None),
        ("WA_1", None, None, 0, "step3_paraphrase_failed", None, 0.1, 0.2),
    ]
    return spark.createDataFrame(rows, CLASSIFIED)


def test_summary_sections(classified):
    rows = report.summary(classified).collect()
    found = {(r.section, r.contract, r.key): (r.total, r.standard, r.non_standard) for r in rows}
    assert found["overall", None, None] == (5, 2, 3)
    assert found["step", None, "unknown"] == (1, 0, 1)
    assert found["attribute", None, "1"] == (2, 1, 1)
    assert found["attribute", None, "unknown"] == (1, 0, 1)
    assert found["state", None, "unknown"] == (1, 0, 1)
    assert found["contract_step", "WA_1", "step2_semantic"] == (1, 1, 0)
    assert found["contract_attribute", "TN_1", "2"] == (1, 0, 1)
    for section in ("step", "attribute", "state", "contract_step", "contract_attribute"):
        assert sum(v[0] for k, v in found.items() if k[0] == section) == 5


def test_missing_flags_count_differently(classified):
    # A missing flag is non-standard in the summary but absent from the listing.
    by_contract = {r.contract: r for r in report.contract_summary(classified).collect()}
    assert by_contract["TN_1"].non_standard_clauses == 2
    assert report.non_standard_rows(classified, "tn_").count() == 1
    counts = {r.contract: r.non_standard for r in report.non_standard_counts(classified).collect()}
    assert counts == {"TN_1": 1, "WA_1": 1}


def test_flags_and_text_report(classified):
    assert [(r.flag, r.clauses) for r in report.flag_histogram(classified).collect()] == [("a", 2), ("b", 1)]
    text = report.text_report(classified)
    assert "| all | 5 | 2 | 3 | 40.000 |" in text
    # Attribute keys sort as text.
    lines = text[text.index("## Attributes") :]
    assert lines.index("\n| 1 |") < lines.index("\n| 10 |") < lines.index("\n| 2 |")
    assert "| semantic | 0.500 | 3 |" in text


def test_empty_report(spark):
    assert report.text_report(spark.createDataFrame([], CLASSIFIED)).strip() == "# Classified clauses"


def test_histogram_like_numpy(spark):
    values = [1, 2, 2, 3, 7, 21, 21, 20]
    found = charts.histogram(spark.createDataFrame([(v,) for v in values], "v int"), "v").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=20)
    assert [r["count"] for r in found] == counts.tolist()
    assert [r.bin_start for r in found] == pytest.approx(edges[:-1].round(1))
    flat = charts.histogram(spark.createDataFrame([(5,), (5,)], "v int"), "v").orderBy("bin").collect()
    counts, edges = np.histogram([5, 5], bins=20)
    assert [r["count"] for r in flat] == counts.tolist() and flat[0].bin_start == 4.5 and flat[-1].bin_end == 5.5
    assert charts.histogram(spark.createDataFrame([], "v int"), "v").count() == 0


CLAUSES = (
    "chunk_id string, contract_id string, assigned_attribute string, token_length int, similarity double, "
    "classification string, text_snippet string"
)
CONTRACTS = "contract_id string, state string, standard_count int, nonstandard_count int, num_chunks int"


@pytest.fixture(scope="module")
def metrics(spark):
    clauses = [
        ("1", "a_x", "A", 5, 0.5, "standard", "the Alpha alpha, with"),
        ("2", "a_x", "A", 7, None, "odd", "alpha beta"),
        ("3", "b_y", "B", None, 0.25, None, None),
        ("4", "zz", "A", 1, 0.1, "nonstandard", "beta"),
        ("5", "a_x", None, 1, 0.9, "standard", ""),
    ]
    contracts = [("a_x", "TN", 3, 1, 9), ("b_y", "WA", 0, 0, 4)]
    return spark.createDataFrame(clauses, CLAUSES), spark.createDataFrame(contracts, CONTRACTS)


def test_small_charts(metrics):
    clauses, contracts = metrics
    pie = {r.label: (r.value, r.percentage, r.total) for r in charts.standard_pie(contracts).collect()}
    assert pie == {"Standard": (3, 75.0, 4), "Non-Standard": (1, 25.0, 4)}
    bars = {r.contract_name: r.standard_percentage for r in charts.contract_bars(contracts).collect()}
    assert bars == {"x": 75.0, "y": 0.0}
    grid = {(r.attribute, r.state): (r.value, r["count"]) for r in charts.heatmap(clauses, contracts).collect()}
    assert grid == {("A", "TN"): (0.5, 2), ("A", "WA"): (0.0, 0), ("B", "TN"): (0.0, 0), ("B", "WA"): (0.25, 1)}
    series = {r.clause_id: (r.series, r.x, r.y) for r in charts.length_scatter(clauses).collect()}
    assert series["1"] == ("standard", 5, 0.5) and series["2"] == ("non_standard", 7, 0.0) and series["3"][1] == 0
    cloud = [(r.text, r.value, r.size) for r in charts.word_cloud(clauses).collect()]
    assert cloud == [("alpha", 2, 4), ("beta", 2, 4), ("alpha,", 1, 2)]
    stats = charts.length_stats(clauses).first()
    assert (stats.mean, stats.median, stats.min, stats.max) == (2.8, 1.0, 0, 7)


def test_timeline_keeps_unknown_contracts(spark, metrics):
    timings = spark.createDataFrame([("a_x", 1.5), ("q_z", 2.25)], "contract_id string, seconds double")
    rows = charts.processing_timeline(timings, metrics[1]).collect()
    assert [(r.contract_name, r.state, r.num_chunks) for r in rows] == [("z", "Unknown", 0), ("x", "TN", 9)]


@pytest.mark.parametrize("n", [1, 2, 5, 8, 11])
def test_box_positions(spark, n):
    rng = np.random.default_rng(n)
    values = [round(float(v), 4) for v in rng.normal(size=n)] + ([9.0] if n > 5 else [])
    rows = [(str(i), "c", "A", 1, v, None, None) for i, v in enumerate(values)]
    clauses = spark.createDataFrame(rows, CLAUSES)
    box = charts.similarity_box(clauses).first()
    ordered, size = sorted(values), len(values)
    q1, q3 = ordered[size // 4], ordered[3 * size // 4]
    outliers = [v for v in ordered if v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)]
    expected = (ordered[0], q1, ordered[size // 2], q3, ordered[-1])
    assert (box["min"], box.q1, box["median"], box.q3, box["max"]) == tuple(round(v, 3) for v in expected)
    assert box["count"] == size and box.outliers == len(outliers)
    assert sorted(r.similarity for r in charts.similarity_outliers(clauses).collect()) == [round(v, 3) for v in outliers]


ROWS = (
    "source_filename string, row_index long, attribute_name string, attribute_number int, page int, section string, "
    "is_standard int, text string, full_content_raw string"
)


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (f"f{f}.json", i, "Fee", 1, i, f"section:S > Clause: {i}.1", i % 2 if i % 5 else None, f"text rate{i}", "x" * 300)
        for f in (1, 2)
        for i in range(40)
    ]
    return spark.createDataFrame(data, ROWS)


def test_search_looks_at_all_rows(rows):
    assert [r.row_index for r in search.search(rows, "RATE35").collect()] == [35, 35]
    # Row 35 is behind the first 30 rows of its file.
    assert search.search(rows, "RATE35", rows_per_file=search.ROWS_PER_FILE).collect() == []
    found = search.search(rows, "rate is", is_standard=0).collect()
    assert len(found) == 12 and [r.row_index for r in found[:3]] == [2, 4, 6]
    assert found[0].clause_number == "2.1" and len(found[0].full_content_raw) == 220
    # Words of one or two letters are no keywords, and no keywords match everything.
    assert search.search(rows, "is a", contract="F2").count() == 12


def test_chat(rows):
    assert search.chat(rows, "rate non-standard") == "f1.json: 32 non-standard clauses"  # all, not only the 12 that are shown
    assert search.chat(rows, "rate7") == "Clause 7.1 page 7 - Fee"
    assert search.chat(rows, "nothing-like-this") == "No relevant information found"
    asked = []
    assert search.chat(rows, "rate7", lambda p: asked.append(p) or "Answer: yes  it is\nmore") == "yes it is"
    assert "Question: rate7" in asked[0] and asked[0].count("Contract=") == 2
    assert search.chat(rows, "rate7", lambda p: "Error calling LLM: x") == "Clause 7.1 page 7 - Fee"


def test_history(spark):
    messages = spark.createDataFrame(
        [("a", i, "user", f"m{i}") for i in range(30)] + [("b", 1, "user", "x")], "session_id string, seq long, role string, content string"
    )
    kept = search.recent_messages(messages)
    assert [r.seq for r in search.session_history(kept, "a").collect()] == list(range(10, 30))
    assert search.clear_session(messages, "a").count() == 1
