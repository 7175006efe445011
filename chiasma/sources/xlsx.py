"""One sheet of a workbook as a table, parsed with the standard library alone.

A workbook is a zip archive whose parts are compressed as one stream each, so it is opened by one task. That task only
unpacks: it cuts the sheet and the table of shared strings at the beginnings of their rows and strings, without parsing
them, and stores the pieces with the number that each one begins at. Any number of tasks then parse the pieces, and
shared strings are looked up by a join.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Bytes of XML to a piece; a row or string that is longer is one piece of its own.
PIECE = 4 << 20

_OPEN = {"row": re.compile(rb"<(?:\w+:)?row(?=[\s>/])[^>]*>"), "si": re.compile(rb"<(?:\w+:)?si(?=[\s>/])[^>]*>")}
_CLOSE = {"row": re.compile(rb"</(?:\w+:)?sheetData\s*>"), "si": re.compile(rb"</(?:\w+:)?sst\s*>")}
_ROOT = {"row": re.compile(rb"<(?:\w+:)?worksheet(?=[\s>/])[^>]*>"), "si": re.compile(rb"<(?:\w+:)?sst(?=[\s>/])[^>]*>")}
_NUMBER = re.compile(rb"""\sr\s*=\s*["']([0-9]+)["']""")


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_part(z: zipfile.ZipFile, sheet: str) -> str:
    """The archive's member that holds a sheet."""
    ids = {s.get("name"): s.get(_REL) for s in ElementTree.parse(z.open("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
    if sheet not in ids:
        raise ValueError(f"no sheet {sheet}; there are {sorted(ids)}")
    rels = ElementTree.parse(z.open("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels.getroot() if r.get("Id") == ids[sheet])
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def pieces(xml: BinaryIO, tag: str, size: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """(number before the piece's first element, XML) of about ``size`` bytes each, every one a document of its own.

    ``tag``: ``row``, numbered by ``r`` where it has one and by the row before otherwise, or ``si``, numbered from 0.
    At most two pieces are in memory.
    """
    root, held, number, first, done = None, b"", 0, 0, False
    while not done:
        more = xml.read(size)
        held, done = held + more, not more
        if root is None:
            m = _ROOT[tag].search(held)
            if m is None or m[0].endswith(b"/>"):
                continue
            root, held = m[0], held[m.end() :]
            close = b"</" + re.match(rb"<([\w:]+)", root)[1] + b">"
        starts = list(_OPEN[tag].finditer(held))
        if done:
            end = _CLOSE[tag].search(held, starts[-1].end() if starts else 0)
            stop = end.start() if end else len(held)
        else:
            # an element may go on in what is not read yet
            stop = starts[-1].start() if starts else 0
        for m in starts:
            if m.start() >= stop:
                break
            r = _NUMBER.search(m[0]) if tag == "row" else None
            number = int(r[1]) if r else number + 1
        if starts and starts[0].start() < stop:
            yield first, root + held[starts[0].start() : stop] + close
            first, held = number, held[stop:]


def _elements(xml: bytes, tag: str) -> Iterator[ElementTree.Element]:
    for _, e in ElementTree.iterparse(io.BytesIO(xml)):
        if e.tag == f"{_MAIN}{tag}":
            yield e
            e.clear()


def _text(e: ElementTree.Element) -> str:
    """The text of a string, without phonetic readings."""
    skip = {t for p in e.iter(f"{_MAIN}rPh") for t in p.iter(f"{_MAIN}t")}
    return "".join(t.text or "" for t in e.iter(f"{_MAIN}t") if t not in skip)


def parsed_rows(first: int, xml: bytes) -> Iterator[tuple[int, dict[int, tuple[str | None, int | None]]]]:
    """(row number, by column the value, or the number of the shared string that it is) of a piece of a sheet."""
    row = first
    for e in _elements(xml, "row"):
        row = int(e.get("r", row + 1))
        cells, k = {}, -1
        for c in e.iter(f"{_MAIN}c"):
            k = _column(c.get("r")) if c.get("r") else k + 1
            v = c.find(f"{_MAIN}v")
            if c.get("t") == "inlineStr":
                cells[k] = (_text(c), None)
            elif v is not None and v.text is not None:
                cells[k] = (None, int(v.text)) if c.get("t") == "s" else (v.text, None)
        yield row, cells


def _heading(z: zipfile.ZipFile, part: str, header: int, size: int) -> dict[str, int]:
    """Column by name of the header row: reads the sheet and the strings no farther than it has to."""
    found: dict[int, tuple[str | None, int | None]] = {}
    for first, xml in pieces(z.open(part), "row", size):
        found = next((cells for row, cells in parsed_rows(first, xml) if row == header), {})
        if found or first >= header:
            break
    names = {text: k for k, (text, _) in found.items() if text is not None}
    wanted = {n: k for k, (_, n) in found.items() if n is not None}
    if wanted:
        for first, xml in pieces(z.open("xl/sharedStrings.xml"), "si", size):
            names |= {_text(e): wanted[n] for n, e in enumerate(_elements(xml, "si"), first) if n in wanted}
            if first > max(wanted):
                break
    return names


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def read_sheet(spark: SparkSession, path: str, sheet: str = "Table_S3", header: int = 3, columns: tuple[str, ...] = ("map", "SNP_name", "chr_phy", "coordinate", "raw_data"), size: int = PIECE) -> DataFrame:
    """input_ord (the row number) and ``columns``, found by name in row ``header``, as text.

    Spark reads the files, so the path may be of any store that it knows. Rows of several workbooks keep the numbers of
    their own.
    """
    return sheet_of(spark.read.format("binaryFile").load(path).select("path", "content"), sheet, header, columns, size)


def sheet_of(books: DataFrame, sheet: str, header: int, columns: tuple[str, ...], size: int = PIECE) -> DataFrame:
    """``read_sheet`` of workbooks given as path and content."""
    cut = pa.schema([("path", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("xml", pa.binary()), ("place", pa.list_(pa.int32()))])
    cells = pa.schema([("path", pa.string()), ("input_ord", pa.int64()), *[(f"v{i}", pa.string()) for i in range(len(columns))], *[(f"s{i}", pa.int64()) for i in range(len(columns))]])
    strings = pa.schema([("path", pa.string()), ("shared", pa.int64()), ("text", pa.string())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    part = sheet_part(z, sheet)
                    names = _heading(z, part, header, size)
                    place = [names.get(n) for n in columns] if names else None
                    yield from _batches(((path, "row", n, xml, place) for n, xml in pieces(z.open(part), "row", size)), cut, 1)
                    if "xl/sharedStrings.xml" in z.namelist():
                        yield from _batches(((path, "si", n, xml, None) for n, xml in pieces(z.open("xl/sharedStrings.xml"), "si", size)), cut, 1)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for piece in batch.to_pylist():
                    for row, found in parsed_rows(piece["first"], piece["xml"]):
                        if row > header:
                            own = [found.get(k, (None, None)) for k in piece["place"]]
                            yield (piece["path"], row, *[v for v, _ in own], *[s for _, s in own])

        yield from _batches(rows(), cells, 1000)

    def parse_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for piece in batch.to_pylist():
                    for n, e in enumerate(_elements(piece["xml"], "si"), piece["first"]):
                        yield piece["path"], n, _text(e)

        yield from _batches(rows(), strings, 1000)

    cut_up = stored(books.select("path", "content").mapInArrow(unpack, "path string, kind string, first long, xml binary, place array<int>"), "sheet-pieces")
    spread = max(cut_up.sparkSession.sparkContext.defaultParallelism, 1)
    v, s = ([f"{c}{i}" for i in range(len(columns))] for c in "vs")
    rows = cut_up.filter("kind = 'row' and place is not null").repartition(spread, "path", "first")
    rows = rows.mapInArrow(parse, ", ".join(["path string, input_ord long", *[f"{n} string" for n in v], *[f"{n} long" for n in s]]))
    texts = cut_up.filter("kind = 'si'").repartition(spread, "path", "first").mapInArrow(parse_strings, "path string, shared long, text string")
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(v[i]).alias("value"), F.col(s[i]).alias("shared")) for i in range(len(columns))])
    rows = rows.select("path", "input_ord", F.inline(each))
    # strings are numbered within their workbook; a number no string has gives null
    rows = rows.join(texts, ["path", "shared"], "left").withColumn("value", F.coalesce("value", "text"))
    named = [F.max(F.when(F.col("i") == i, F.col("value"))).alias(n) for i, n in enumerate(columns)]
    return rows.groupBy("path", "input_ord").agg(*named).drop("path")
