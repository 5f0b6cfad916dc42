import pytest

from clauseloom.operators.classify import Thresholds
from clauseloom.plans.pipeline import Pipeline, fingerprint

TABLES = ["chunks", "attributes", "matches/TNstandard", "matches/TNredacted", "clauses/TNstandard", "clauses/TNredacted", "classified", "summary"]


def test_fingerprints_depend_on_content_alone(spark):
    schema = "a string, b string, v array<double>"
    rows = [("x", None, [1.0, None]), ("y", "z", None), ("y", "z", None)]
    of = lambda rows: fingerprint(spark.createDataFrame(rows, schema))
    assert of(rows) == of(rows[::-1])
    others = [
        rows[:2], [(None, "x", [1.0, None]), *rows[1:]], [("x", None, [None, 1.0]), *rows[1:]], [("x", None, []), *rows[1:]],
        [rows[0], rows[0], *rows[1:]], [],
    ]
    assert len({of(rows), *map(of, others)}) == 7
    frame = spark.createDataFrame(rows, schema)
    assert fingerprint(frame) != fingerprint(frame.withColumnRenamed("b", "c"))


@pytest.fixture(scope="module")
def inputs(spark):
    page = lambda *parts: "\n".join(f"--- Page {i} ---\n# Section {i}\n{part}" for i, part in enumerate(parts, 1))
    documents = [
        ("TNstandard", "tn.md", page("The provider shall be paid the fee schedule rate", "Claims are filed within 120 days")),
        ("TNredacted", "one.md", page("The provider shall be paid the fee schedule rate", "Unilateral changes unless agreed")),
    ]
    attributes = [(1, "Fee", "fee schedule rate"), (2, "Filing", "claims filed days")]
    return (
        spark.createDataFrame(documents, "collection_key string, source_file string, value string"),
        spark.createDataFrame(attributes, "attribute_number int, attribute_name string, content string"),
    )


def test_only_what_changed_is_made_again(spark, inputs, tmp_path):
    documents, attributes = inputs
    folder = str(tmp_path / "run")

    def run(documents=documents, **settings):
        pipeline = Pipeline(spark, folder, **settings)
        rows = pipeline.run(documents, attributes, ["TNstandard"], ["TNredacted"])
        return pipeline.made, sorted(map(str, rows.collect()))

    made, first = run()
    assert sorted(made) == sorted(TABLES)
    assert run() == ([], first)
    # Other rows in another order are the same content.
    assert run(documents.orderBy("source_file")) == ([], first)
    # A limit concerns the cascade; what comes out alike leaves the summary.
    assert run(thresholds=Thresholds(semantic=0.9123))[0][:1] == ["classified"]
    run()
    # A text changes: everything that holds it is made again, and equals a run from nothing.
    other = documents.replace("one.md", "two.md", subset=["source_file"])
    made, second = run(other)
    assert {"chunks", "matches/TNredacted", "clauses/TNredacted", "classified"} <= set(made) and "attributes" not in made
    # The template's matches were computed again but came out alike, so their clauses stand.
    assert "matches/TNstandard" in made and "clauses/TNstandard" not in made
    fresh = Pipeline(spark, str(tmp_path / "fresh")).run(other, attributes, ["TNstandard"], ["TNredacted"])
    assert second == sorted(map(str, fresh.collect()))
    # A step that was interrupted has an empty manifest.
    Pipeline(spark, folder)._keep_manifest("classified", {})
    assert run(other)[0] == ["classified"]
