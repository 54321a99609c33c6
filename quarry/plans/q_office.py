"""Queries of the readers: files made from rows of tables (one a region, or one a document), then read back."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import documents
from ..sources import office
from .q_entities import q

c = F.col
# The name spaces of the formats.
W, A, S = (f'xmlns:{p}="http://schemas.openxmlformats.org/{x}/2006/main"' for p, x in (("w", "wordprocessingml"), ("a", "drawingml"), ("s", "spreadsheetml")))


def _word(region: str, nations: list[dict]) -> dict[str, str]:
    text = lambda x, style="": f'<w:p>{style and f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>"}<w:r><w:t>{x}</w:t></w:r></w:p>'
    table = "".join(f"<w:tr><w:tc>{text(n['name'])}</w:tc><w:tc>{text(n['key'])}</w:tc></w:tr>" for n in nations)
    return {"word/document.xml": f"<w:document {W}><w:body>{text(region, 'Heading2')}{''.join(text(n['name']) for n in nations)}<w:tbl>{table}</w:tbl></w:body></w:document>"}


def _slides(region: str, nations: list[dict]) -> dict[str, str]:
    slide = lambda n: f'<p {A}><a:p><a:r><a:t>{n["name"]}</a:t></a:r></a:p><a:p><a:pPr lvl="1"/><a:r><a:t>{region} {n["key"]}</a:t></a:r></a:p></p>'
    return {f"ppt/slides/slide{i + 1}.xml": slide(n) for i, n in enumerate(nations)}


def _book(region: str, nations: list[dict]) -> dict[str, str]:
    row = lambda i, cells: f'<s:row>{"".join(f"<s:c r={chr(34)}{x}{i}{chr(34)} {body}</s:c>" for x, body in cells)}</s:row>'
    said = lambda x: f't="inlineStr"><s:is><s:t>{x}</s:t></s:is>'
    rows = row(1, [("A", said("name")), ("B", said("key"))]) + "".join(row(i + 2, [("A", said(n["name"])), ("B", f"><s:f>B{i + 1}+1</s:f><s:v>{n['key']}</s:v>")]) for i, n in enumerate(nations))
    sheets = f'<s:workbook {S}><s:sheets><s:sheet name="{region}"/><s:sheet name="Empty"/></s:sheets></s:workbook>'
    return {"xl/workbook.xml": sheets, "xl/worksheets/sheet1.xml": f"<s:worksheet {S}><s:sheetData>{rows}</s:sheetData></s:worksheet>", "xl/worksheets/sheet2.xml": f"<s:worksheet {S}><s:sheetData/></s:worksheet>"}


def _files(nation: DataFrame, region: DataFrame, suffix: str, parts: Callable[[str, list[dict]], dict[str, str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, nations in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w") as z:
                    for path, body in parts(name, nations).items():
                        z.writestr(path, body)
                out.append(raw.getvalue())
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["region", "content"])

    # A file's rows: the nations of a region are a few.
    rows = nation.join(F.broadcast(region), c("n_regionkey") == c("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct(c("n_name").alias("name"), c("n_nationkey").cast("string").alias("key")))).alias("nations"))
    made = rows.mapInArrow(run, "region string, content binary")
    return made.select(F.concat("region", F.lit(suffix)).alias("path"), F.lit({".docx": "word", ".pptx": "powerpoint", ".xlsx": "excel"}[suffix]).alias("kind"), "content")


RANKED = "SELECT r_name, n_name, CAST(n_nationkey AS VARCHAR(8)) AS k, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS i, count(*) OVER (PARTITION BY r_name) AS n FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"

q("src6_workbooks", "nation region", lambda n, g: office.extract(_files(n, g, ".xlsx", _book)).select("path", "part", "name", F.get_json_object("row", "$.name").alias("nation"), F.get_json_object("row", "$.key").cast("double").alias("key"), F.get_json_object("row", "$.key=").alias("formula"), "error"),
  f"SELECT concat(r_name, '.xlsx') AS path, 0 AS part, r_name AS name, n_name AS nation, CAST(k AS DOUBLE) AS key, concat('B', CAST(i AS VARCHAR(8)), '+1') AS formula, CAST(NULL AS VARCHAR) AS error FROM ({RANKED}) y")
q("src6_workbook_profiles", "nation region", lambda n, g: documents.column_profiles(office.extract(_files(n, g, ".xlsx", _book)).select(c("name").alias("sheet"), F.get_json_object("row", "$.key").cast("double").alias("n"), "row"), ["name", "key", "other"]).select("sheet", "column", "type", "low", "high", "mean"),
  """SELECT r_name AS sheet, 'key' AS column, 'numeric' AS type, CAST(min(n_nationkey) AS DOUBLE) AS low, CAST(max(n_nationkey) AS DOUBLE) AS high, CAST(sum(n_nationkey) AS DOUBLE) / count(*) AS mean FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY 1
  UNION ALL SELECT r_name, x, CASE x WHEN 'name' THEN 'text' ELSE 'empty' END, NULL, NULL, NULL FROM {region}, (VALUES ('name'), ('other')) v(x) WHERE r_regionkey IN (SELECT n_regionkey FROM {nation})""".replace("AS column", 'AS "column"'))
q("src7_slides", "nation region", lambda n, g: office.extract(_files(n, g, ".pptx", _slides)).select("path", "part", "name", "level", "text", "error"),
  f"SELECT concat(r_name, '.pptx') AS path, CAST(i - 1 AS INT) AS part, CASE x WHEN 0 THEN 'title' ELSE 'bullet' END AS name, x AS level, CASE x WHEN 0 THEN n_name ELSE concat(r_name, ' ', k) END AS text, CAST(NULL AS VARCHAR) AS error FROM ({RANKED}) y, (VALUES (0), (1)) v(x)")
q("src8_word", "nation region", lambda n, g: office.extract(_files(n, g, ".docx", _word)).select("path", "part", "name", "level", "text", "error"),
  f"""SELECT concat(r_name, '.docx') AS path, 0 AS part, 'heading' AS name, 2 AS level, r_name AS text, CAST(NULL AS VARCHAR) AS error FROM {{region}} WHERE r_regionkey IN (SELECT n_regionkey FROM {{nation}})
  UNION ALL SELECT concat(r_name, '.docx'), CAST(i AS INT), 'paragraph', NULL, n_name, NULL FROM ({RANKED}) y UNION ALL SELECT concat(r_name, '.docx'), CAST(n + i AS INT), 'table', NULL, concat(n_name, ' | ', k), NULL FROM ({RANKED}) z""")


WORDS, LINE = 300, 10


def _ascii(x: str) -> bytes:
    return b"(" + x.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def _pdf(number: int, title: str | None, text: str) -> bytes:
    """A file of pages of WORDS words, LINE a line. By number: tables or streams of references, objects in streams or not, contents
    deflated or not, codes of one or two bytes, a wrong place of the table; every tenth file draws no text."""
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    lines = [[" ".join(words[i : i + LINE]) for i in range(s, min(s + WORDS, len(words)), LINE)] for s in range(0, max(1, len(words)), WORDS)]
    try:
        text.encode("cp1252")
        wide = number % 4 == 2
    except UnicodeEncodeError:
        wide = True
    # Words are drawn with spaces between them, whatever white space parts them in the text.
    letters = {x: i + 1 for i, x in enumerate(dict.fromkeys(f"{text} "))} if wide else {}
    codes = {ord(x): "%04X" % i for x, i in letters.items()}
    said = (lambda x: b"<" + x.translate(codes).encode() + b">") if wide else _ascii
    objects: dict[int, bytes] = {1: b"<</Type/Catalog/Pages 2 0 R>>", 5: b"<<>>" if title is None else b"<</Title<FEFF%s>>>" % title.encode("utf-16-be").hex().encode()}
    streams: dict[int, bytes] = {}

    def stream(n: int, body: bytes, head: bytes = b"") -> None:
        if number % 3:
            body, head = zlib.compress(body, 1), head + b"/Filter/FlateDecode"
        streams[n] = b"<<%s/Length %d>>stream\n%s\nendstream" % (head, len(body), body)

    if wide:
        pairs = [b"<%04X><%s>" % (i, x.encode("utf-16-be").hex().encode()) for x, i in letters.items()]
        stream(4, b"\n".join(b"%d beginbfchar\n%s\nendbfchar" % (len(p), b"\n".join(p)) for p in (pairs[i : i + 100] for i in range(0, len(pairs), 100))))
        objects[3] = b"<</Type/Font/Subtype/Type0/ToUnicode 4 0 R>>"
    else:
        objects[3] = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"
    kids = []
    for k, page in enumerate(lines):
        kids.append(6 + 2 * k)
        objects[kids[-1]] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (kids[-1] + 1)
        drawn = b"" if number % 10 == 9 else b"BT /F1 12 Tf 14 TL 72 720 Td\n%s ET" % b"\n".join((b"[%s] TJ T*" if number % 2 else b"%s Tj T*") % said(x) for x in page)
        stream(kids[-1] + 1, b"q 1 0 0 1 0 0 cm\n%s\nQ" % drawn)
    objects[2] = b"<</Type/Pages/Count %d/Kids[%s]/Resources<</Font<</F1 3 0 R>>>>/MediaBox[0 0 612 792]>>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    last = max([*objects, *streams]) + 1
    out, at = bytearray(b"%PDF-1.7\n"), {}
    packed = number % 4 == 1
    if packed:
        listed, body = bytearray(), bytearray()
        for n, x in objects.items():
            listed += b"%d %d " % (n, len(body))
            body += x + b" "
        stream(last, bytes(listed + body), b"/Type/ObjStm/N %d/First %d" % (len(objects), len(listed)))
    for n, x in (streams if packed else objects | streams).items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, x)
    place = len(out)
    if packed:
        inner = {n: i for i, n in enumerate(objects)}
        rows = [(2, last, inner[n]) if n in inner else (1, at.get(n, place), 0) if n in at or n == last + 1 else (0, 0, 0) for n in range(last + 2)]
        raw = [bytes([a]) + b.to_bytes(4, "big") + c.to_bytes(2, "big") for a, b, c in rows]
        above = [bytes(7), *raw]
        body = zlib.compress(b"".join(b"\2" + bytes((x - y) & 255 for x, y in zip(r, p, strict=True)) for r, p in zip(raw, above, strict=False)))
        out += b"%d 0 obj\n<</Type/XRef/Size %d/W[1 4 2]/Root 1 0 R/Info 5 0 R/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 7>>/Length %d>>stream\n%s\nendstream\nendobj\n" % (last + 1, last + 2, len(body), body)
    else:
        rows = b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(last))
        out += b"xref\n0 %d\n%strailer\n<</Size %d/Root 1 0 R/Info 5 0 R>>\n" % (last, rows, last)
    return bytes(out) + b"startxref\n%d\n%%%%EOF" % (place + (number % 4 == 3) * 7)


def _pdfs(documents_: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out, size = [], [], 0
            for at in range(batch.num_rows):
                row = [batch.column(i)[at].as_py() for i in range(3)]
                keys.append(row[0])
                out.append(_pdf(*row))
                size += len(out[-1])
                if size >= 4 << 20 or at == batch.num_rows - 1:  # a few files at once
                    yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "content"])
                    keys, out, size = [], [], 0

    # Making and reading files is long work for few bytes, so that texts are dealt out whatever the table's files and row groups.
    rows = documents_.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    made = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").mapInArrow(run, "doc_id long, content binary")
    return made.select(c("doc_id").cast("string").alias("path"), F.lit("pdf").alias("kind"), "content")


q("src5_pdf_pages", "documents", lambda d: office.extract(_pdfs(d)).select(c("path").cast("long").alias("doc_id"), "part", "name", "level", "text", "error"),
  f"""WITH w AS (SELECT doc_id, source, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]'), lambda x: x <> '') AS w FROM {{documents}}),
  p AS (SELECT *, greatest(1, (len(w) + {WORDS - 1}) // {WORDS}) AS n FROM w), k AS (SELECT *, unnest(range(-1, n)) AS k FROM p)
  SELECT doc_id, CAST(k AS INT) AS part, CASE WHEN k < 0 THEN 'file' WHEN doc_id % 10 = 9 OR len(w) = 0 THEN 'scan' ELSE 'page' END AS name, CASE WHEN k < 0 THEN CAST(n AS INT) END AS level,
  CASE WHEN k < 0 THEN source WHEN doc_id % 10 = 9 THEN '' ELSE array_to_string(w[k * {WORDS} + 1:(k + 1) * {WORDS}], ' ') END AS text, CAST(NULL AS VARCHAR) AS error FROM k""")


def _rows(made: DataFrame) -> DataFrame:
    """The readers' rows with their place; a file's rows are read in one go, and those of Word are numbered by it."""
    at = F.when(c("kind") == "word", c("part")).otherwise(F.coalesce(F.get_json_object("row", "$.key").cast("double").cast("long"), F.length("text").cast("long"), F.lit(0)))
    return office.extract(made).withColumn("document_id", F.element_at(F.split("path", r"\."), 1)).withColumn("pos", at.cast("long")).withColumn("part", F.when(c("kind") == "word", 0).otherwise(c("part")))


_TEXTS = lambda n, g: documents.full_text(documents.text_parts(_rows(_files(n, g, ".pptx", _slides)).unionByName(_rows(_files(n, g, ".docx", _word))).unionByName(_rows(_files(n, g, ".xlsx", _book))).withColumn("document_id", F.concat("document_id", F.lit("."), "kind"))))
q("x27_full_text_by_format", "nation region", lambda n, g: _TEXTS(n, g).select("document_id", "full_text"), f"""WITH y AS ({RANKED})
  SELECT concat(r_name, '.powerpoint') AS document_id, string_agg(concat(n_name, ' ', r_name, ' ', k), ' ' ORDER BY i) AS full_text FROM y GROUP BY r_name
  UNION ALL SELECT concat(r_name, '.excel'), concat('Sheet: ', r_name, ' name key ', string_agg(concat(n_name, ' ', k, '.0 B', CAST(i AS VARCHAR), '+1'), ' ' ORDER BY CAST(k AS INT))) FROM y GROUP BY r_name
  UNION ALL SELECT concat(r_name, '.word'), concat(t, ' ', t) FROM (SELECT r_name, concat(r_name, ' ', string_agg(n_name, ' ' ORDER BY i), ' ', string_agg(concat(n_name, ' | ', k), ' ' ORDER BY i)) AS t FROM y GROUP BY r_name) z""")
q("x25_workbook_data", "nation region", lambda n, g: documents.workbook_data(
    documents.column_profiles(office.extract(_files(n, g, ".xlsx", _book)).select(c("name").alias("sheet"), F.get_json_object("row", "$.key").cast("double").alias("n"), "row"), ["name", "key"]).select(c("sheet").alias("document_id"), F.lit(0).alias("part"), "sheet", "column", "low", "high", "mean"),
    office.extract(_files(n, g, ".xlsx", _book)).groupBy(c("name").alias("document_id"), "part", c("name").alias("sheet")).agg(F.count("*").alias("rows"))).select("document_id", "main_headings", "text_summary", F.array_size("key_metrics").alias("metrics"), c("key_metrics")[0]["key"].alias("key"), c("key_metrics")[0]["mean"].alias("mean")),
  """SELECT r_name AS document_id, [r_name] AS main_headings, concat('Workbook of 1 sheet(s) and ', count(*), ' rows') AS text_summary, 1 AS metrics, concat(r_name, '.key') AS key, CAST(sum(n_nationkey) AS DOUBLE) / count(*) AS mean FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name""")
