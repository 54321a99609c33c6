"""Readers of office files: binary files in, rows out. Standard library zip and XML only, one file at a time in a task.

A file that can't be read gives one row with its error, so that one bad upload doesn't end a job. Formats whose
libraries aren't installed (images with text) go through adapters, which say so.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_type
from .pdf import read_pdf

UPLOAD_LIMIT = 50 * 1024 * 1024
SCHEMA = "path string, kind string, part int, name string, level int, text string, row string, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _row(part: int, name: str, text: str | None = None, level: int | None = None, row: str | None = None) -> dict:
    return {"part": part, "name": name, "level": level, "text": text, "row": row}


def read_word(data: bytes) -> Iterator[dict]:
    """Paragraphs in order, headings with the digits of their style as level; then tables, a row each."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    n = 0
    for p in body.findall(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "") if style is not None else ""
        if text:
            level = int(re.sub("[^0-9]", "", name) or 1) if "heading" in name.lower() else None
            yield _row(n, "heading" if level is not None else "paragraph", text, level)
            n += 1
    for table in body.findall(f"{_W}tbl"):
        for tr in table.findall(f"{_W}tr"):
            cells = ["".join(t.text or "" for t in tc.iter(f"{_W}t")) for tc in tr.findall(f"{_W}tc")]
            yield _row(n, "table", " | ".join(cells))
            n += 1


def read_slides(data: bytes) -> Iterator[dict]:
    """Per slide its first paragraph of level 0 as title, the rest as bullets."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((x for x in z.namelist() if re.fullmatch(r"ppt/slides/slide[0-9]+\.xml", x)), key=lambda x: int(re.sub("[^0-9]", "", x)))
        for i, name in enumerate(names):
            titled = False
            for p in ET.fromstring(z.read(name)).iter(f"{_A}p"):
                text = "".join(t.text or "" for t in p.iter(f"{_A}t")).strip()
                props = p.find(f"{_A}pPr")
                level = int(props.get("lvl", 0)) if props is not None else 0
                if text:
                    title = not titled and level == 0
                    titled = titled or title
                    yield _row(i, "title" if title else "bullet", text, level)


def read_workbook(data: bytes) -> Iterator[dict]:
    """Rows of each sheet as JSON by the first row's headers; empty sheets give none; a formula is kept beside its value."""
    import json

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        titles = [s.get("name", "") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        for i, title in enumerate(titles):
            path = f"xl/worksheets/sheet{i + 1}.xml"
            if path not in z.namelist():
                continue
            headers: dict[str, str] | None = None
            for r in ET.fromstring(z.read(path)).iter(f"{_S}row"):
                cells: dict[str, object] = {}
                for cell in r.findall(f"{_S}c"):
                    at = re.sub("[0-9]", "", cell.get("r", ""))
                    v, f, inline = cell.find(f"{_S}v"), cell.find(f"{_S}f"), cell.find(f"{_S}is")
                    kind = cell.get("t", "n")
                    value: object = None
                    if inline is not None:
                        value = "".join(t.text or "" for t in inline.iter(f"{_S}t"))
                    elif v is not None and v.text is not None:
                        value = shared[int(v.text)] if kind == "s" else float(v.text) if kind == "n" else v.text
                    cells[at] = value
                    if f is not None and f.text:
                        cells[f"{at}="] = f.text
                if headers is None:
                    headers = {k: str(x) for k, x in cells.items() if x is not None}
                elif any(x is not None for x in cells.values()):
                    named = {headers.get(k.rstrip("="), k.rstrip("=")) + ("=" if k.endswith("=") else ""): x for k, x in cells.items()}
                    yield _row(i, title, None, None, json.dumps(named))


def unavailable(what: str) -> Callable[[bytes], Iterator[dict]]:
    """An adapter for a format whose library isn't there."""

    def read(_: bytes) -> Iterator[dict]:
        raise NotImplementedError(f"no {what} library is installed; register a reader with READERS")
        yield  # pragma: no cover

    return read


#: Readers by kind; register another to support a format.
READERS: dict[str, Callable[[bytes], Iterator[dict]]] = {
    "word": read_word, "powerpoint": read_slides, "excel": read_workbook, "pdf": read_pdf, "image": unavailable("OCR"),
}


_ARROW = pa.schema([(n, pa.int32() if kind == "int" else pa.string()) for n, kind in (x.split() for x in SCHEMA.split(", "))])


#: Rows and characters of a batch that goes out.
ROWS, CHARS = 4096, 4 << 20


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files one at a time; rows of many small files go out as one batch, those of a large one as several."""
    held, chars = [], 0
    for batch in batches:
        for at in range(batch.num_rows):
            path, kind, content = (batch.column(i)[at].as_py() for i in range(3))
            try:
                rows = [{"path": path, "kind": kind, "error": None, **r} for r in READERS[kind](content)]
            except Exception as e:  # noqa: BLE001  the row carries it
                rows = [{"path": path, "kind": kind, "error": f"{type(e).__name__}: {e}"}]
            for row in rows:
                held.append(row)
                chars += len(row.get("text") or "") + len(row.get("row") or "")
                if len(held) >= ROWS or chars >= CHARS:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                    held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def files(spark: SparkSession, folder: str, limit: int = UPLOAD_LIMIT) -> DataFrame:
    """Uploaded files below a folder: path, kind, length, content; those above the limit are left out before they are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.filter(F.col("length") <= limit).withColumn("kind", content_type(F.col("path")))


def decoded(uploads: DataFrame, limit: int = UPLOAD_LIMIT) -> DataFrame:
    """JSON uploads (file_name, file_buffer in base 64) as files."""
    rows = uploads.select(F.col("file_name").alias("path"), F.unbase64("file_buffer").alias("content"), content_type(F.col("file_name")).alias("kind"))
    return rows.withColumn("length", F.octet_length("content").cast("long")).filter(F.col("length") <= limit)


def extract(files_: DataFrame) -> DataFrame:
    """Rows of the files whose kind has a reader."""
    known = files_.filter(F.col("kind").isin(*READERS)).select("path", "kind", "content")
    return known.mapInArrow(_extract, SCHEMA)
