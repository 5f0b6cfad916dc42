import json

import pytest
from pyspark.sql import functions as F

from clauseloom import models, schemas
from clauseloom.functions import vectors
from clauseloom.operators import ranking
from clauseloom.operators.clauses import collection_kind, metadata, provenance
from clauseloom.plans import queries
from clauseloom.plans.pipeline import Pipeline
from clauseloom.sources import scans, sinks
from clauseloom.sources.versions import read_collections
from clauseloom.streaming.ingest import ingest, stream_chunks


def test_read_markdown_and_chunk_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("--- Page 1 ---\nx")
    (tmp_path / "blank.md").write_text(" \n")
    (tmp_path / "other.txt").write_text("no")
    assert [r.source_file for r in scans.read_markdown(spark, str(tmp_path)).collect()] == ["a.md"]
    chunk = {"chunk_id": "c1", "page_number": 1, "content": "x"}
    (tmp_path / "a_chunks.json").write_text(json.dumps([chunk, {**chunk, "chunk_id": "c2"}]))
    (tmp_path / "b_chunks.json").write_text(json.dumps({**chunk, "chunk_id": "c3"}))
    (tmp_path / "bad_chunks.json").write_text("{not json")
    assert sorted(r.chunk_id for r in scans.read_chunks(spark, str(tmp_path)).collect()) == ["c1", "c2", "c3"]


def match(rank, source, **extra):
    return {
        "rank": rank, "rank_in_global": rank, "rrf_score": 0.1, "page": 2, "section": "s", "chunk_id": f"{source}{rank}",
        "source_file": source, "content_preview": "p", "full_content": "Full text",
        "score_breakdown": {"dense_similarity": 0.5, "bm25_score": 1.5, "dense_rank": 1, "bm25_rank": 2}, **extra,
    }


def test_read_similarities(spark, tmp_path):
    info = {"number": "1", "name": "Fee"}
    template = {
        "collection_info": {"collection_key": "TNstandard"},
        "matches": {"Fee": {"attribute_info": info, "top_matches": [match(1, "t"), match(2, "t")]}},
    }
    contract = {
        "collection_info": {"collection_key": "TNredacted"},
        "matches": {"Fee": {"attribute_info": info, "per_source_top_matches": {"x": [match(1, "x")], "y": [match(1, "y"), match(2, "y")]}}},
    }
    for name, document in (("a.json", template), ("b.json", contract)):
        (tmp_path / name).write_text(json.dumps(document))
    rows = scans.read_similarities(spark, str(tmp_path)).collect()
    assert sorted(r.chunk_id for r in rows) == ["t1", "t2", "x1", "y1", "y2"]
    assert {r.attribute_number for r in rows} == {1} and {r.bm25_score for r in rows} == {1.5}


def test_read_metrics_and_clauses(spark, tmp_path):
    document = {
        "corpus": {"standard_count": 1, "nonstandard_count": 2},
        "clauses": [{"chunk_id": "c", "contract_id": "k", "token_length": 4, "similarity": 0.5}],
        "contracts": [{"contract_id": "k", "state": "TN"}],
        "attributes": {"A": {"standard_count": 1, "per_state_avg_similarity": {"TN": 0.5}}},
        "processing": {"timings": {"k": 2.5}},
    }
    (tmp_path / "metrics.json").write_text(json.dumps(document))
    tables = scans.read_metrics(spark, str(tmp_path / "metrics.json"))
    assert tables["clauses"].first().token_length == 4 and tables["timings"].first().seconds == 2.5
    assert tables["attributes"].first().attribute == "A" and tables["contracts"].first().state == "TN"
    folder = tmp_path / "sets"
    folder.mkdir()
    (folder / "TNredacted_a.json").write_text(json.dumps([{"chunk_id": "1", "isStandard": 0}]))
    (folder / "TNstandard.json").write_text(json.dumps([{"chunk_id": "2"}]))
    assert scans.read_clauses(spark, str(folder)).count() == 2
    assert [r.chunk_id for r in scans.read_clauses(spark, str(folder), contracts_only=True).collect()] == ["1"]


def test_read_sheet_and_documents(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Name,Text\nFee,one\n,two\nRate,three\n")
    rows = scans.read_sheet(spark, str(tmp_path / "s.csv")).orderBy("row_index").collect()
    assert [(r.row_index, r.Name) for r in rows] == [(0, "Fee"), (1, None), (2, "Rate")]
    folder = tmp_path / "pdf"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"p1|p2")

    def parser(name, content):
        for number, text in enumerate(content.decode().split("|"), 1):
            yield number, [text, " ", f"table of {name}"], number == 2

    pages = scans.parse_documents(spark, str(folder), parser).orderBy("page_number").collect()
    assert [p.value for p in pages] == ["--- Page 1 ---\n\np1\n\ntable of a.pdf", "--- Page 2 (OCR) ---\n\np2\n\ntable of a.pdf"]


def test_collections(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "row_id string, collection_key string, embedding array<float>"
    first = spark.createDataFrame([("1", "TN", [1.0]), ("2", "WA", [1.0])], schema)
    sinks.replace_collection(first, path)
    sinks.replace_collection(spark.createDataFrame([("3", "TN", [2.0])], schema), path)
    assert sorted(r.row_id for r in read_collections(spark, path).collect()) == ["2", "3"]
    more = spark.createDataFrame([("3", "TN", [9.0]), ("4", "TN", []), ("5", "TN", None), ("6", "TN", [1.0]), ("6", "TN", [1.0])], schema)
    sinks.add_to_collection(more, path)
    assert sorted(r.row_id for r in read_collections(spark, path).collect()) == ["2", "3", "6"]
    fresh = str(tmp_path / "fresh")
    sinks.add_to_collection(first, fresh)
    assert read_collections(spark, fresh).count() == 2


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("TN", "a b.md", "c1", 1), ("TN", "c.md", "c2", 0)], "collection_key string, source_file string, chunk_id string, is_standard int").withColumn("contract", F.col("chunk_id"))
    sinks.write_datasets(rows, str(tmp_path / "sets"))
    assert {p.name for p in (tmp_path / "sets").iterdir()} == {"TN_a_b_dataset.json", "TN_c_dataset.json"}
    sinks.write_classified(rows, str(tmp_path / "all"), str(tmp_path / "standard"))
    assert spark.read.parquet(str(tmp_path / "all")).count() == 2
    assert spark.read.parquet(str(tmp_path / "standard")).count() == 1
    pages = spark.createDataFrame([("f", 2, "two"), ("f", 1, "one")], "source_file string, page_number int, value string")
    sinks.write_markdown_pages(pages, str(tmp_path / "md"))
    assert [(p.name, p.read_text()) for p in (tmp_path / "md").iterdir()] == [("f.md", "one\ntwo\n")]
    sinks.write_chunks(rows, str(tmp_path / "chunks"))
    assert {p.name for p in (tmp_path / "chunks").iterdir()} == {"a b_chunks.json", "c_chunks.json"}
    assert sorted(r.chunk_id for r in scans.read_chunks(spark, str(tmp_path / "chunks")).collect()) == ["c1", "c2"]


def test_not_processed(spark):
    inputs = spark.createDataFrame([("a.pdf",), ("b.pdf",)], "source_file string")
    outputs = spark.createDataFrame([("a.md",), ("a.md",)], "source_file string")
    assert [r.source_file for r in scans.not_processed(inputs, outputs).collect()] == ["b.pdf"]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],)], "v array<double>")
    found = [r[0] for r in rows.select(vectors.l2_normalize(F.col("v"))).collect()]
    assert found == [[0.6, 0.8], None, None, None]
    row = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8])], "a array<double>, b array<double>")
    pair = F.col("a"), F.col("b")
    assert row.select(vectors.similarity(*pair)).first()[0] == pytest.approx(0.2)
    assert row.select(vectors.similarity(*pair, metric="cosine")).first()[0] == pytest.approx(0.6)


def test_embedder(spark):
    class Flaky:
        def __call__(self, texts):
            if "bad" in texts:
                raise ValueError("no vector")
            return [[float(len(t)), 0.0] if t != "none" else None for t in texts]

    rows = spark.createDataFrame([(0, "good"), (1, "bad"), (2, ""), (3, None), (4, "none")], "i int, content string").coalesce(1)
    found = [r.embedding for r in models.embed(rows, factory=Flaky).orderBy("i").collect()]
    assert found == [[1.0, 0.0], None, None, None, None]
    same = [r.embedding for r in models.embed(rows.where("i < 1").union(rows.where("i < 1"))).collect()]
    assert same[0] == same[1] and sum(x * x for x in same[0]) == pytest.approx(1.0, abs=1e-6)


def test_stream_ingest_reads_each_file_once(spark, tmp_path):
    source, output, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    schema = "doc_id long, content string"
    spark.createDataFrame([(1, "The Fee 10")], schema).write.parquet(source)
    ingest(stream_chunks(spark, source, schema), output, state).awaitTermination()
    spark.createDataFrame([(2, "Others")], schema).write.mode("append").parquet(source)
    ingest(stream_chunks(spark, source, schema), output, state).awaitTermination()
    rows = spark.read.parquet(output).orderBy("doc_id").collect()
    assert [(r.doc_id, r.preprocessed_final_content, r.preprocessed_token_count) for r in rows] == [(1, "fee num", 2), (2, "others", 1)]


def test_reports_and_json(spark):
    chunks = spark.createDataFrame(
        [(i, f"c{i}", 1, "section:A", f"fee rate {i}", "s.md", [1.0, float(i)]) for i in range(6)],
        "doc_idx long, chunk_id string, page_number int, header_path string, content string, source_file string, embedding array<float>",
    )
    attributes = spark.createDataFrame([(1, "Fee", "fee", [1.0, 0.0])], "attribute_number long, attribute_name string, content string, embedding array<float>")
    matches = ranking.format_matches(ranking.rrf_top_k(attributes, chunks, 4), chunks, attributes)
    stats = ranking.match_stats(matches)
    documents = sinks.similarity_documents(matches, stats, "rank").collect()
    tree = json.loads(documents[0].document)
    assert [m["rank"] for m in tree["top_matches"]] == [1, 2, 3, 4] and tree["attribute_info"]["number"] == 1
    assert tree["top_matches"][0]["score_breakdown"]["bm25_rank"] >= 1
    report = sinks.match_report(matches, stats)
    assert report.count("| 1 | Fee |") == 3 and "## Best chunks" in report
    dense = ranking.dense_matches(attributes, chunks, 4)
    report = sinks.dense_report(dense, ranking.dense_match_stats(dense))
    assert report.count("\n| 1 |") == 4 and "| 1 | -2.500 | 1.000 | 1 |" in report


def test_small_column_helpers(spark):
    rows = spark.createDataFrame([("TNstandard",), ("TNredacted",)], "k string")
    assert [r[0] for r in rows.select(collection_kind(F.col("k"))).collect()] == ["template", "contract"]
    assert rows.select(provenance().alias("p")).first().p.used_ftfy is False


def test_pipeline_end_to_end(spark, tmp_path):
    def document(name, key, fees):
        pages = "\n".join(f"--- Page {i} ---\n# Section {i}\n{fee}" for i, fee in enumerate(fees, 1))
        return (key, name, pages)

    shared = ["The provider shall be paid the fee schedule rate", "Claims are filed within 120 days of service"]
    documents = spark.createDataFrame(
        [
            document("tn.md", "TNstandard", [*shared, "Network access terms"]),
            document("one.md", "TNredacted", [*shared, "Unilateral changes unless agreed"]),
            document("two.md", "TNredacted", ["Something else entirely about cats", shared[0].upper()]),
        ],
        "collection_key string, source_file string, value string",
    )
    attributes = spark.createDataFrame(
        [(1, "Fee", "fee schedule rate"), (2, "Filing", "claims filed days")], "attribute_number int, attribute_name string, content string"
    )
    pipeline = Pipeline(spark, str(tmp_path / "run"))
    summary = pipeline.run(documents, attributes, ["TNstandard"], ["TNredacted"])
    overall = summary.where("section = 'overall'").first()
    classified = pipeline.table("classified")
    assert overall.total == classified.count() == 10
    exact = classified.where("classification_step = 'step1_exact_match'")
    assert exact.where("contract = 'two.md'").count() >= 1 and exact.where("contract = 'one.md'").count() >= 4
    assert overall.standard >= exact.count()
    # A later step runs again from the stored tables.
    again = pipeline.run(documents, attributes, ["TNstandard"], ["TNredacted"], steps=["summarise"])
    assert again.where("section = 'overall'").first().total == 10
    with pytest.raises(ValueError):
        pipeline.run(documents, attributes, [], [], steps=["nope"])
    columns = pipeline.table("clauses/TNredacted").columns
    assert set(schemas.CLAUSES.replace(",", "").split()) >= {"preprocessed_sha256"} and "row_id" in columns
    assert metadata(pipeline.table("clauses/TNredacted"), "qwen").columns[-1] == "embedding_source"


@pytest.mark.parametrize("files", ["one", "many"])
def test_ingest_query_reads_a_table_of_one_or_many_files(spark, tmp_path, files):
    rows = [(i, "The Fee 10" if i else None, "en", "src", 10) for i in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if files == "one":
        table.toPandas().to_parquet(tmp_path / "documents.parquet")
    else:
        table.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.incremental_ingest(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.token_count) for r in found] == [(0, 0), *[(i, 2) for i in range(1, 6)]]
