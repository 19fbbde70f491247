"""Workbooks: rows of a sheet, and the temperature readings among their cells."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go on at once.
BATCH_ROWS = 4096
#: Where a row's name starts, and the first place for its temperature.
NAME_AT, READING_AT = 3, 4
#: How far the two scales of one reading may be apart, °C: both are rounded.
ROUNDING_C = 1.5


def workbook_rows(spark: SparkSession, path: str, sheet: str = "xl/worksheets/sheet1.xml") -> DataFrame:
    """(path, row, cells): the cells with a value, of every row that has any.

    One task reads a file; the sheet is streamed, so only its shared strings
    are held.  An empty folder gives no rows; a file that is no workbook fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import zipfile

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    held: list[tuple[int, list[str]]] = []
                    for row in _sheet_rows(book, sheet):
                        held.append(row)
                        if len(held) == BATCH_ROWS:
                            yield _batch(name, held)
                            held = []
                    yield _batch(name, held)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, row int, cells array<string>")


def _batch(name: str, rows: list[tuple[int, list[str]]]) -> pa.RecordBatch:
    columns = [pa.array([name] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.list_(pa.string()))]
    return pa.record_batch(columns, names=["path", "row", "cells"])


def _sheet_rows(book, sheet: str) -> Iterator[tuple[int, list[str]]]:
    from xml.etree.ElementTree import iterparse

    def ends(part: str, tag: str):
        with book.open(part) as file:
            for _, node in iterparse(file):
                if node.tag.rpartition("}")[2] == tag:
                    yield node
                    node.clear()

    texts = lambda node: "".join(t.text or "" for t in node.iter() if t.tag.rpartition("}")[2] == "t").strip()
    shared = [texts(si) for si in ends("xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []
    for row in ends(sheet, "row"):
        cells = []
        for cell in row:
            value = next((v.text for v in cell if v.tag.rpartition("}")[2] == "v"), None)
            if value is not None:
                cells.append(shared[int(value)] if cell.get("t") == "s" else value)
        if cells:
            yield int(row.get("r")), cells


def one_reading(a: Column, b: Column) -> Column:
    """Whether two cells are one temperature, in °F and °C, or twice the same letter.

    Shape is not enough: sheet and page numbers look alike but don't convert.
    """
    number, letter = r"^[0-9]{1,3}(\.[0-9]+)?$", "^[BHWbhw]$"
    numbers = a.rlike(number) & b.rlike(number)
    apart = F.abs((a.try_cast("double") - 32) * 5 / 9 - b.try_cast("double"))
    return F.coalesce((numbers & (apart <= ROUNDING_C)) | (a.rlike(letter) & (F.upper(a) == F.upper(b))), F.lit(False))


def reading_of_row(cells: Column) -> Column:
    """struct<state, lat, lng, name, tf, tc>, or null for a row that is no spring.

    The name may span cells and hold digits, so the first pair that is one
    reading ends it; a pair of the word null does where there is none.
    """
    n = F.size(cells)
    places = F.sequence(F.lit(READING_AT), F.greatest(n - 2, F.lit(READING_AT)))
    at = lambda i: F.get(cells, i)
    read = F.get(F.filter(places, lambda i: one_reading(at(i), at(i + 1))), F.lit(0))
    unread = F.get(F.filter(places, lambda i: F.coalesce((at(i) == "null") & (at(i + 1) == "null"), F.lit(False))), F.lit(0))
    place = F.coalesce(read, unread)
    words = F.slice(cells, NAME_AT + 1, F.greatest(F.coalesce(place, F.lit(NAME_AT)) - NAME_AT, F.lit(0)))
    name = F.trim(F.regexp_replace(F.array_join(words, " "), r"\s+", " "))
    row = F.struct(at(F.lit(0)).alias("state"), at(F.lit(1)).alias("lat"), at(F.lit(2)).alias("lng"), name.alias("name"), at(place).alias("tf"), at(place + 1).alias("tc"))
    return F.when((n >= 6) & at(F.lit(0)).rlike("^[A-Z]{2}$") & place.isNotNull(), row)
