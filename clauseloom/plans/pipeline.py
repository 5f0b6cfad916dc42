"""The batch pipeline: rank, prepare, classify, summarise, with a table after each step.

A table is made again only if what it depends on has changed.  Each has a manifest under
``folder/_steps`` with a fingerprint of what it was made from - the content of its inputs, the
parameters, the release of this package - and one of its own content, counted while it is
written.  A step that comes to the same content as before lets the steps after it stand.
A manifest is cleared before its table is written, so that an interrupted step runs again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from clauseloom import __version__
from clauseloom.functions.text import state_of_collection, text_to_embed
from clauseloom.models import embed
from clauseloom.operators import classify as cascade
from clauseloom.operators import ranking
from clauseloom.operators.chunking import chunk_documents
from clauseloom.operators.clauses import clauses_from_matches, with_row_id
from clauseloom.operators.ordered import group_rank
from clauseloom.operators.report import summary
from clauseloom.sources.versions import hadoop_path

STEPS = ("chunk", "rank", "prepare", "classify", "summarise")


def _content_columns(schema: StructType) -> list[Column]:
    """Number of rows and two sums of row hashes: equal for equal rows in any order, however often each comes."""
    parts: list[Column] = []
    for field_ in sorted(schema.fields, key=lambda field_: field_.name):
        column = F.col(f"`{field_.name}`")
        # Hashes skip nulls, so their places are hashed as well.
        parts += [column, column.isNull()]
        if isinstance(field_.dataType, ArrayType):
            parts.append(F.transform(column, lambda value: value.isNull()))
    total = lambda *seed: F.sum(F.xxhash64(*parts, *seed).cast("decimal(38,0)")).cast("string")
    return [F.count(F.lit(1)).alias("rows"), total().alias("first"), total(F.lit(1)).alias("second")]


def _content_text(schema: StructType, found: dict) -> str:
    return json.dumps([sorted((f.name, f.dataType.simpleString()) for f in schema.fields), [found[k] for k in ("rows", "first", "second")]])


def fingerprint(df: DataFrame) -> str:
    """The content of a DataFrame in a few bytes, whatever the order of its rows: one aggregate over its rows."""
    return _content_text(df.schema, df.agg(*_content_columns(df.schema)).first().asDict())


@dataclass
class Pipeline:
    """Runs the steps in order and stores each result as Parquet under ``folder``.

    A step reads its inputs back from the stored tables, so a run can resume at
    any step and lost executors never reach beyond one step.  ``documents`` has
    collection_key, source_file and value.  ``made`` lists the tables that this object has written.
    Embedders count by their names; ``embedder_version`` tells releases of one embedder apart.
    """

    spark: SparkSession
    folder: str
    metric: str = "l2sq"
    thresholds: cascade.Thresholds = field(default_factory=cascade.Thresholds)
    embedder: Callable[[DataFrame], DataFrame] = embed
    # A second model for the paraphrase gate; without one both gates share vectors.
    paraphrase_embedder: Callable[[DataFrame], DataFrame] | None = None

    embedder_version: str = "1"
    resume: bool = True
    made: list[str] = field(default_factory=list)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def store(self, name: str, df: DataFrame, made_from: str = "") -> DataFrame:
        """Write a table and its manifest; ``made_from`` is the fingerprint of what it was made from."""
        self._keep_manifest(name, {})
        counted = Observation()
        df.observe(counted, *_content_columns(df.schema)).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        written, found = self.table(name), counted.get
        # A plan without rows may lose its counters.
        content = _content_text(df.schema, found) if "rows" in found else fingerprint(written)
        self._keep_manifest(name, {"made_from": made_from, "content": content})
        self.made.append(name)
        return written

    def _manifest(self, name: str) -> dict:
        for path in (f"{self.folder}/{name}", f"{self.folder}/_steps/{name}"):
            files, target = hadoop_path(self.spark, path)
            if not files.exists(target):
                return {}
        # A manifest that was not written to its end has no line.
        lines = self.spark.read.schema("value string").text(f"{self.folder}/_steps/{name}").head(1)
        return json.loads(lines[0][0]) if lines else {}

    def _keep_manifest(self, name: str, manifest: dict) -> None:
        text = self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1)
        text.write.mode("overwrite").text(f"{self.folder}/_steps/{name}")

    def _content(self, name: str) -> str:
        return self._manifest(name).get("content") or fingerprint(self.table(name))

    def _embedders(self) -> list[str]:
        named = (self.embedder, self.paraphrase_embedder)
        return [f"{getattr(f, '__module__', '')}.{getattr(f, '__qualname__', type(f).__name__)}" for f in named] + [self.embedder_version]

    def keep(self, name: str, contents: Iterable[str], parameters: Iterable, build: Callable[[], DataFrame]) -> None:
        """Make table ``name`` unless it was made from the same contents and parameters."""
        known = json.dumps([__version__, name, list(contents), [repr(value) for value in parameters]])
        made_from = hashlib.sha256(known.encode()).hexdigest()
        if not (self.resume and self._manifest(name).get("made_from") == made_from):
            self.store(name, build(), made_from)

    def chunk(self, documents: DataFrame, attributes: DataFrame) -> None:
        self.keep("chunks", [fingerprint(documents)], self._embedders(), lambda: self._chunks(documents))
        self.keep("attributes", [fingerprint(attributes)], self._embedders(), lambda: self.embedder(attributes))

    def _chunks(self, documents: DataFrame) -> DataFrame:
        # A file name may come in several collections, so documents are named by both.
        own = documents["document_id"] if "document_id" in documents.columns else documents["source_file"]
        named = documents.withColumn("document_id", F.concat_ws("/", "collection_key", own))
        keys = named.select("document_id", "collection_key").distinct()
        chunks = chunk_documents(named.select("document_id", "source_file", "value")).join(keys, "document_id")
        # The order of a collection: file name, then position in the file.
        number = F.regexp_extract("chunk_id", "_c([0-9]+)$", 1).cast("int")
        ordered = group_rank(chunks, ["collection_key"], [F.col("source_file").asc(), F.col("document_id").asc(), number.asc()], "doc_idx")
        # Vectors are made from the content with its header context in front.
        shown = ordered.withColumnRenamed("content", "_content").withColumn(
            "content", text_to_embed(F.col("header_path"), F.col("_content"))
        )
        return self.embedder(shown).drop("content").withColumnRenamed("_content", "content")

    def rank(self, collections: dict[str, bool]) -> None:
        """``collections`` maps a collection key to whether matches are kept per source."""
        contents = [self._content("chunks"), self._content("attributes")]
        for key, per_source in collections.items():
            self.keep(f"matches/{key}", contents, (per_source, self.metric), lambda: self._matches(key, per_source))

    def _matches(self, key: str, per_source: bool) -> DataFrame:
        attributes = self.table("attributes")
        part = self.table("chunks").where(F.col("collection_key") == key)
        if per_source:
            found, rank = ranking.rrf_per_source(attributes, part, metric=self.metric), "rank_in_source"
        else:
            found, rank = ranking.rrf_top_k(attributes, part, metric=self.metric), "rank"
        per_attribute = None if per_source else ranking.GLOBAL_TOP_K
        matches = ranking.format_matches(found, part, attributes, per_attribute=per_attribute)
        return matches.withColumnRenamed(rank, "rank")

    def prepare(self, collections: Iterable[str]) -> None:
        for key in collections:
            self.keep(f"clauses/{key}", [self._content(f"matches/{key}")], self._embedders(), lambda: self._clauses(key))

    def _clauses(self, key: str) -> DataFrame:
        kept = ranking.cap_matches(self.table(f"matches/{key}"))
        clauses = with_row_id(clauses_from_matches(kept, key, "rank"))
        return self.embedder_of_text(clauses.withColumn("state", state_of_collection(F.col("collection_key"))))

    def embedder_of_text(self, clauses: DataFrame) -> DataFrame:
        texts = clauses.withColumn("content", F.col("preprocessed_final_content"))
        embedded = self.embedder(texts)
        if self.paraphrase_embedder is None:
            return embedded.withColumn("paraphrase_embedding", F.col("embedding")).drop("content")
        first = embedded.withColumnRenamed("embedding", "_first")
        second = self.paraphrase_embedder(first).withColumnRenamed("embedding", "paraphrase_embedding")
        return second.withColumnRenamed("_first", "embedding").drop("content")

    def classify(self, templates: Iterable[str], contracts: Iterable[str]) -> None:
        contents = [self._content(f"clauses/{key}") for key in (*templates, *contracts)]
        parameters = (list(templates), list(contracts), self.metric, self.thresholds)
        self.keep("classified", contents, parameters, lambda: self._classified(templates, contracts))

    def _classified(self, templates: Iterable[str], contracts: Iterable[str]) -> DataFrame:
        text = F.col("preprocessed_final_content").alias("text")

        def load(keys: Iterable[str], row_id: str) -> DataFrame:
            frames = [self.table(f"clauses/{key}") for key in keys]
            rows = frames[0]
            for frame in frames[1:]:
                rows = rows.unionByName(frame)
            return group_rank(rows.select("*", text), [], [F.col("row_id").asc()], row_id)

        template_rows = load(templates, "template_id")
        clause_rows = load(contracts, "clause_id").withColumn("contract", F.col("source_file"))
        exact = cascade.exact_match(clause_rows, template_rows)
        scored = cascade.score_against_templates(exact, template_rows, self.metric, with_text=False)
        result = cascade.classify(scored, self.thresholds, templates=template_rows)
        return result.drop("embedding", "paraphrase_embedding")

    def summarise(self) -> None:
        self.keep("summary", [self._content("classified")], (), lambda: summary(self.table("classified")))

    def run(
        self,
        documents: DataFrame,
        attributes: DataFrame,
        templates: Iterable[str],
        contracts: Iterable[str],
        steps: Iterable[str] = STEPS,
    ) -> DataFrame:
        """Run ``steps``, those of them that ``resume`` does not let stand, and return the summary."""
        templates, contracts = list(templates), list(contracts)
        wanted = set(steps)
        unknown = wanted - set(STEPS)
        if unknown:
            raise ValueError(f"unknown steps: {sorted(unknown)}")
        if "chunk" in wanted:
            self.chunk(documents, attributes)
        if "rank" in wanted:
            self.rank({**{key: False for key in templates}, **{key: True for key in contracts}})
        if "prepare" in wanted:
            self.prepare([*templates, *contracts])
        if "classify" in wanted:
            self.classify(templates, contracts)
        if "summarise" in wanted:
            self.summarise()
        return self.table("summary")
