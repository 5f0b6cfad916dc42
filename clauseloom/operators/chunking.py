"""Markdown documents to chunks: pages, headers, carried context, token-aware pieces."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions.markdown import clean_page, large_file_fields, pages
from clauseloom.functions.steps import each
from clauseloom.functions.text import SPACE_CHARACTERS, clean_text, file_stem, once, strip, token_count
from clauseloom.operators.sizing import broadcast_if_small
from clauseloom.operators.splitting import Measure, split_places, word_length

# Header levels, sizes, overlaps and separators of the chunk formats.
LEVELS = ("section", "clause", "subclause")
NO_HEADER = "document_content"
CHUNK_SIZE = 300
CHUNK_OVERLAP = 100
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
LARGE_CHUNK_SIZE = 1000
LARGE_CHUNK_OVERLAP = 200
LARGE_SEPARATORS = ("\n\n", "\n", " ", "")


def document_key(documents: DataFrame) -> Column:
    """What names a document: ``document_id`` where the table has it, else the file name."""
    return F.col("document_id" if "document_id" in documents.columns else "source_file").cast("string")


def document_pages(documents: DataFrame) -> DataFrame:
    """(document_id, source_file, pages) of documents that are not blank; pages is an array of (page_number, content)."""
    cleaned = F.transform(
        pages(F.col("value")),
        lambda page: F.struct(page["page_number"].alias("page_number"), clean_page(page["content"]).alias("content")),
    )
    return documents.where(strip(F.col("value")) != "").select(
        document_key(documents).alias("document_id"), "source_file", cleaned.alias("pages")
    )


def split_pages(documents: DataFrame) -> DataFrame:
    """(document_id, source_file, segment_no, page_number, content) per page marker; blank documents are skipped.

    Every marker begins a segment of its own, also where a page number comes again.
    """
    return document_pages(documents).select(
        "document_id", "source_file", F.posexplode("pages").alias("segment_no", "page")
    ).select("document_id", "source_file", "segment_no", "page.page_number", "page.content")


# --- header state ---------------------------------------------------------------

Headers = tuple[str | None, str | None, str | None]
NO_HEADERS: Headers = (None, None, None)
_HEADER_MARK = re.compile(r"(#{1,3})(?: .*)?\Z", re.DOTALL)
_SECTION = pa.struct(
    [("segment_no", pa.int32()), ("section_no", pa.int32()), *[(level, pa.string()) for level in LEVELS], ("content", pa.string())]
)
_SECTIONS = f"array<struct<segment_no:int,section_no:int,{','.join(f'{level}:string' for level in LEVELS)},content:string>>"


def later_headers(left: Headers, right: Headers) -> Headers:
    """Last known header of every level after two stretches of text.  Associative; ``NO_HEADERS`` changes nothing."""
    section, clause, subclause = (after if after is not None else before for before, after in zip(left, right))
    return section, clause, subclause


def segment_sections(content: str) -> list[tuple[Headers, str]]:
    """Headers and text of the sections of one segment, read line by line.

    A new header closes deeper levels.  Lines under the same headers form one section;
    blank lines separate its paragraphs.  Lines between code fences are text.
    """
    found: list[tuple[Headers, list[str]]] = []
    open_headers, last_body, fenced = NO_HEADERS, -1, False
    for number, raw in enumerate(content.split("\n")):
        line = raw.strip(SPACE_CHARACTERS)
        if line.startswith("```") and line.count("```") == 1:
            fenced = not fenced
        mark = None if fenced else _HEADER_MARK.match(line)
        if mark:
            level = len(mark[1])
            title = line[level:].strip(SPACE_CHARACTERS)
            section, clause, subclause = (*open_headers[: level - 1], title, *NO_HEADERS[level:])
            open_headers = (section, clause, subclause)
        elif line or fenced:
            if found and found[-1][0] == open_headers:
                found[-1][1].append(("  \n" if number - last_body > 1 else "\n") + line)
            else:
                found.append((open_headers, [line]))
            last_body = number
    return [(headers, "".join(parts)) for headers, parts in found]


def sections_of(contents: Column, carry: bool) -> Column:
    """ARRAY<STRUCT<segment_no, section_no, section, clause, subclause, content>> of the segments in an array.

    Control and format characters are dropped first.  With ``carry``, sections without any
    header take the last known header of every level from the segments before.
    """
    visible = F.transform(contents, lambda text: F.regexp_replace(text, r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}&&[^\n]]", ""))

    names = [field.name for field in _SECTION]

    def sections(segments: Sequence[str]) -> list[dict]:
        rows, known = [], NO_HEADERS
        for segment_no, segment in enumerate(segments):
            for section_no, (own, content) in enumerate(segment_sections(segment), start=1):
                known = later_headers(known, own)
                shown = known if carry and own == NO_HEADERS else own
                rows.append((segment_no, section_no, *shown, content))
        return [dict(zip(names, row)) for row in rows]

    return each(sections, _SECTIONS, pa.list_(_SECTION))(visible)


def document_sections(documents: DataFrame) -> DataFrame:
    """(document_id, source_file, sections): parsed where the document lies, headers carried from page to page.

    A section is (segment_no, page_number, section_no, section, clause, subclause, content).  Nothing is
    exchanged; ``header_sections`` and ``carry_headers`` do the same for documents of several rows.
    """
    parsed = document_pages(documents).withColumn("found", sections_of(F.col("pages.content"), carry=True))

    def numbered(numbers: Column) -> Column:
        return F.transform(
            "found",
            lambda row: F.struct(
                row["segment_no"].alias("segment_no"),
                F.get(numbers, row["segment_no"]).alias("page_number"),
                row["section_no"].alias("section_no"),
                *[row[level].alias(level) for level in LEVELS],
                row["content"].alias("content"),
            ),
        )

    # Read for every section, the array of numbers would be made anew each time.
    section = once(F.col("pages.page_number"), numbered)
    return parsed.select("document_id", "source_file", section.alias("sections"))


def header_sections(page_rows: DataFrame) -> DataFrame:
    """(document_id, source_file, segment_no, page_number, section_no, section, clause, subclause, content).

    Each segment is parsed in its row; headers of earlier segments come by ``carry_headers``.
    """
    page = ["document_id", "source_file", "segment_no", "page_number"]
    found = page_rows.select(*page, F.explode(sections_of(F.array("content"), carry=False)).alias("found"))
    return found.select(*page, *[f"found.{name}" for name in ("section_no", *LEVELS, "content")])


def carry_headers(sections: DataFrame) -> DataFrame:
    """Give sections without any header the last known header of every level.

    Only the first section of a segment can have none, so a prefix scan over one summary
    per segment (its last header of every level) holds all it may take; texts are not
    exchanged while the summaries are few enough to be sent to them.
    """
    segment = ["document_id", "segment_no"]
    last = [
        F.max_by(level, F.when(F.col(level).isNotNull(), F.col("section_no"))).alias(f"_{level}") for level in LEVELS
    ]
    before = Window.partitionBy("document_id").orderBy("segment_no").rowsBetween(Window.unboundedPreceding, -1)
    known = sections.groupBy(*segment).agg(*last).select(
        *[F.col(name).alias(f"_{name}") for name in segment],
        *[F.last(f"_{level}", ignorenulls=True).over(before).alias(f"_{level}") for level in LEVELS],
    )
    here = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in segment]
    bare = F.coalesce(*LEVELS).isNull()
    return sections.join(broadcast_if_small(known), here[0] & here[1], "left").select(
        "document_id",
        "source_file",
        "segment_no",
        "page_number",
        "section_no",
        *[F.when(bare, F.col(f"_{level}")).otherwise(F.col(level)).alias(level) for level in LEVELS],
        "content",
    )


def header_path(section: Column | None = None) -> Column:
    """Headers as one line, of the row or of a section struct."""
    level = F.col if section is None else section.getField
    parts = [F.concat(F.lit(f"{name}:"), level(name)) for name in LEVELS]
    joined = F.concat_ws(" > ", *parts)
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(NO_HEADER))


# --- recursive splitting -------------------------------------------------------

_PIECE = "struct<start:int,content:string>"
_PIECES = pa.list_(pa.struct([("start", pa.int32()), ("content", pa.string())]))


def recursive_splits(
    text: Column,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: Sequence[str] = SEPARATORS,
    length: Measure = word_length,
) -> Column:
    """ARRAY<STRUCT<start, content>>: pieces of each text and their places; ``length`` measures tokens or characters."""

    def split(value: str) -> list[dict]:
        return _pieces(value, size, overlap, separators, length)

    return each(split, f"array<{_PIECE}>", _PIECES)(text)


def split_each(
    texts: Column,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: Sequence[str] = SEPARATORS,
    length: Measure = word_length,
) -> Column:
    """``recursive_splits`` of every text in an array of texts."""

    def split(values: list[str]) -> list[list[dict]]:
        return [_pieces(value, size, overlap, separators, length) for value in values]

    return each(split, f"array<array<{_PIECE}>>", pa.list_(_PIECES))(texts)


def _pieces(text: str, size: int, overlap: int, separators: Sequence[str], length: Measure) -> list[dict]:
    found = split_places(text, size, overlap, separators, length)
    return [{"start": start, "content": piece} for start, piece in found]


def number_chunks(sections: DataFrame, pieces: Column) -> DataFrame:
    """Chunk rows of ``document_sections``; ``pieces`` holds an array of (start, content) for every section.

    Blank pieces are dropped.  The running number counts through the document, whose
    sections are one row, so it is a place in an array and nothing is exchanged.
    ``segment_no``, ``section_no`` and ``start`` say where a chunk lies.
    """
    entries = F.flatten(
        F.zip_with(
            "sections",
            pieces,
            lambda section, parts: F.transform(
                parts,
                lambda part, place: F.struct(
                    section["page_number"].alias("page_number"),
                    header_path(section).alias("header_path"),
                    (place + 1).cast("int").alias("chunk_index"),
                    strip(part["content"]).alias("content"),
                    section["segment_no"].alias("segment_no"),
                    section["section_no"].alias("section_no"),
                    part["start"].alias("start"),
                ),
            ),
        )
    )
    kept = F.filter(entries, lambda entry: entry["content"] != "")
    rows = sections.select("document_id", "source_file", F.posexplode(kept).alias("place", "entry"))
    number = (F.col("place") + 1).cast("string")
    page = F.col("entry.page_number").cast("string")
    return rows.select(
        F.concat(file_stem(F.col("source_file")), F.lit("_p"), page, F.lit("_c"), number).alias("chunk_id"),
        "entry.page_number",
        "entry.header_path",
        "entry.chunk_index",
        "entry.content",
        token_count(F.col("entry.content")).alias("token_count"),
        "source_file",
        "document_id",
        "entry.segment_no",
        "entry.section_no",
        "entry.start",
    )


def placed_chunks(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``chunk_documents`` with segment_no, section_no and start: where in its section's text a chunk begins."""
    return number_chunks(document_sections(documents), split_each(F.col("sections.content"), size, overlap))


def chunk_documents(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(source_file, value) markdown documents to chunk rows, each document where it lies.

    A column ``document_id`` keeps apart documents with the same file name.
    """
    chunks = placed_chunks(documents, size, overlap).drop("segment_no", "section_no", "start")
    return chunks.withColumn("document_type", F.lit("legal_contract"))


def placed_large_chunks(
    documents: DataFrame, size: int = LARGE_CHUNK_SIZE, overlap: int = LARGE_CHUNK_OVERLAP
) -> DataFrame:
    """``chunk_large_documents`` with ``start``: where in the document's text a chunk begins."""
    splits = recursive_splits(F.col("value"), size, overlap, LARGE_SEPARATORS, len)
    pieces = documents.select("source_file", document_key(documents).alias("document_id"), splits.alias("pieces")).select(
        "source_file", "document_id", F.size("pieces").alias("total_chunks"), F.posexplode("pieces").alias("chunk_index", "found")
    )
    pieces = pieces.withColumn("piece", F.col("found.content"))
    return pieces.select(
        F.concat(
            file_stem(F.col("source_file")),
            F.lit("_chunk_"),
            F.lpad((F.col("chunk_index") + 1).cast("string"), 4, "0"),
        ).alias("chunk_id"),
        strip(F.col("piece")).alias("content"),
        *large_file_fields(F.col("piece")),
        "source_file",
        "chunk_index",
        "total_chunks",
        "document_id",
        "found.start",
    )


def chunk_large_documents(
    documents: DataFrame, size: int = LARGE_CHUNK_SIZE, overlap: int = LARGE_CHUNK_OVERLAP
) -> DataFrame:
    """Character-sized chunks of whole documents; page, section and clause come from each chunk's text."""
    return placed_large_chunks(documents, size, overlap).drop("start")


# --- attribute sheets and batches ------------------------------------------------


def attribute_rows(sheet: DataFrame, row_index: str, columns: Sequence[str], source_file: str) -> DataFrame:
    """One attribute per sheet row; the first column is its name, all non-blank cells its content.

    Numbers follow the 0-based row index, so skipped rows leave gaps.
    """
    cells = F.array(*[clean_text(F.col(name).cast("string")) for name in columns])
    number = (F.col(row_index) + 1).cast("int")
    return (
        sheet.select(
            F.concat(F.lit("attr_"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))).alias("chunk_id"),
            number.alias("attribute_number"),
            F.element_at(cells, 1).alias("attribute_name"),
            F.array_join(F.filter(cells, lambda cell: cell != ""), " ").alias("content"),
        )
        .where(F.col("attribute_name") != "")
        .select(
            "*",
            token_count(F.col("content")).alias("token_count"),
            F.lit(source_file).alias("source_file"),
            F.lit("attribute_definition").alias("document_type"),
        )
    )


def page_batches(page_rows: DataFrame, size: int = 10) -> DataFrame:
    """Assign each page of a large file to a batch of ``size`` pages."""
    return page_rows.withColumn("batch_no", (F.floor((F.col("page_number") - 1) / size) + 1).cast("int"))


def recombine_batches(batches: DataFrame, pages_per_batch: int) -> DataFrame:
    """Text blocks of a recombined document in order, page numbers counted through.

    ``batches`` has source_file, batch_no and value (a batch's markdown).  The
    document is kept as ordered rows (block 0 is its title), because a document
    of many batches need not fit into one value.
    """
    marker = r"--- Page ([0-9]+)( \(OCR\))? ---"
    numbers = F.regexp_extract_all("value", F.lit(marker), F.lit(1))
    ocr = F.regexp_extract_all("value", F.lit(marker), F.lit(2))
    parts = F.split("value", marker)
    offset = (F.col("batch_no") - 1) * pages_per_batch
    renumbered = F.zip_with(
        F.zip_with(numbers, ocr, lambda number, flag: F.struct(number.alias("number"), flag.alias("flag"))),
        F.slice(parts, 2, F.size(numbers)),
        lambda page, body: F.concat(
            F.lit("--- Page "), (page["number"].cast("int") + offset).cast("string"), page["flag"], F.lit(" ---"), body
        ),
    )
    separator = F.concat(F.lit("\n\n--- Batch "), F.col("batch_no").cast("string"), F.lit(" ---\n\n"))
    text = F.concat(separator, F.element_at(parts, 1), F.array_join(renumbered, ""))
    titles = batches.select("source_file").distinct().select(
        "source_file",
        F.lit(0).alias("block_no"),
        F.concat(F.lit("# "), file_stem(F.col("source_file")), F.lit("\n\n")).alias("value"),
    )
    blocks = batches.select("source_file", F.col("batch_no").cast("int").alias("block_no"), text.alias("value"))
    return titles.unionByName(blocks)
