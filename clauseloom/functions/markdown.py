"""Markdown formatting inside one row: line rules, tables, page markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseloom.functions.text import strip

LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"
ROMAN_HEADER = r"(?i)^(SECTION|ARTICLE)\s+[IVXLCDM]+"
DECIMAL_START = r"^[0-9]+\.[0-9]+"
DOTTED_NUMBER = r"^([0-9]+(?:\.[0-9]+)*)"
# In strict mode a decimal only opens a clause when a capitalised title or the line end follows.
STRICT_DECIMAL = r"^[0-9]+(?:\.[0-9]+)+\.?(?:\s+[A-Z]|$)"
STRICT_ROMAN = r"^(SECTION|ARTICLE|Section|Article)\s+[IVXLCDM]+\b"


def format_markdown(text: Column, strict: bool = False) -> Column:
    """Mark section and clause headers line by line, dropping blank lines."""
    lines = F.transform(F.split(text, LINE_BREAK), strip)
    roman, decimal = (STRICT_ROMAN, STRICT_DECIMAL) if strict else (ROMAN_HEADER, DECIMAL_START)

    def render(line: Column) -> Column:
        number = F.regexp_extract(line, DOTTED_NUMBER, 1)
        rest = strip(F.regexp_replace(line, DOTTED_NUMBER, ""))
        return (
            F.when(line.rlike(roman), F.concat(F.lit("# "), line))
            .when(
                line.rlike(decimal),
                F.concat(F.lit("## "), number, F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit("\n"), rest))),
            )
            .otherwise(line)
        )

    return F.array_join(F.transform(F.filter(lines, lambda line: line != ""), render), "\n")


def table_to_markdown(table: Column) -> Column:
    """ARRAY<ARRAY<STRING>> to a pipe table; the first row is the header."""

    def render(cells: Column) -> Column:
        shown = F.transform(cells, lambda cell: F.coalesce(cell, F.lit("")))
        return F.concat(F.lit("| "), F.array_join(shown, " | "), F.lit(" |"))

    header = F.element_at(table, 1)
    rule = F.concat(
        F.lit("| "), F.array_join(F.transform(header, lambda _: F.lit("---")), " | "), F.lit(" |")
    )
    body = F.transform(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0))), render)
    lines = F.concat(F.array(render(header), rule), body)
    return F.when(F.size(table) > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


def pages(text: Column) -> Column:
    """ARRAY<STRUCT<page_number, content>>; text before the first marker is dropped."""
    marker = r"--- Page ([0-9]+) ---"
    numbers = F.transform(F.regexp_extract_all(text, F.lit(marker), F.lit(1)), lambda n: n.cast("int"))
    parts = F.split(text, marker)
    bodies = F.transform(F.slice(parts, 2, F.size(numbers)), strip)
    return F.zip_with(
        numbers, bodies, lambda number, body: F.struct(number.alias("page_number"), body.alias("content"))
    )


def clean_page(content: Column) -> Column:
    """Remove OCR markers and empty two-column table heads."""
    no_marker = F.regexp_replace(content, r"--- Page [0-9]+ \(OCR\) ---", "")
    return strip(F.regexp_replace(no_marker, r"\|\s*\|\s*\|\s*\n\|\s*---\s*\|\s*---\s*\|", ""))


def page_markdown(page_number: Column, blocks: Column, ocr: Column) -> Column:
    """Page marker followed by the non-empty blocks, as written to a parsed file."""
    label = F.when(ocr, F.lit(" (OCR) ---")).otherwise(F.lit(" ---"))
    marker = F.concat(F.lit("--- Page "), page_number.cast("string"), label)
    kept = F.filter(blocks, lambda block: block.isNotNull() & (strip(block) != ""))
    return F.array_join(F.concat(F.array(marker), kept), "\n\n")


def large_file_fields(chunk: Column) -> list[Column]:
    """page, section and clause read from the text of one chunk."""
    page = F.nullif(F.regexp_extract(chunk, r"--- Page ([0-9]+) ---", 1), F.lit(""))
    section = F.nullif(F.regexp_extract(chunk, r"(?m)^# (.+)$", 1), F.lit(""))
    clause = F.nullif(F.regexp_extract(chunk, r"(?m)^## ([0-9.]+)", 1), F.lit(""))
    return [
        F.coalesce(page.cast("int"), F.lit(1)).alias("page"),
        F.coalesce(section, F.lit("General")).alias("section"),
        clause.alias("clause"),
    ]
