"""Office files made here, read back; adapters; images; streams equal batches."""

import io
import json
import random
import time
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.plans import catalog, q_office, q_sources
from quarry.sources import images, office, pdf
from quarry.streaming import feed

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def packed(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/") + ".xml", body)
    return out.getvalue()


WORD = packed(word__document=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Market</w:t></w:r></w:p><w:p><w:r><w:t>Large and growing</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
SLIDES = packed(ppt__slides__slide1=f"<x {A}><a:p><a:r><a:t>Vision</a:t></a:r></a:p><a:p><a:pPr lvl=\"1\"/><a:r><a:t>one</a:t></a:r></a:p></x>")
BOOK = packed(
    xl__workbook=f'<workbook {S}><sheets><sheet name="P"/><sheet name="Empty"/></sheets></workbook>', xl__sharedStrings=f"<sst {S}><si><t>year</t></si><si><t>revenue</t></si></sst>",
    xl__worksheets__sheet1=f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>2024</v></c><c r="B2"><f>A2*2</f><v>4048</v></c></row></sheetData></worksheet>',
    xl__worksheets__sheet2=f"<worksheet {S}><sheetData/></worksheet>",
)


def test_office_files(spark, tmp_path):
    for name, data in {"a.docx": WORD, "b.pptx": SLIDES, "c.xlsx": BOOK, "d.pdf": b"%PDF", "e.docx": b"broken", "f.txt": b"text"}.items():
        (tmp_path / name).write_bytes(data)
    rows = office.extract(office.files(spark, str(tmp_path))).collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"].rsplit("/", 1)[-1], []).append(r)
    assert [(r["name"], r["level"], r["text"]) for r in by["a.docx"]] == [("heading", 2, "Market"), ("paragraph", None, "Large and growing"), ("table", None, "a | b")]
    assert [(r["name"], r["text"]) for r in by["b.pptx"]] == [("title", "Vision"), ("bullet", "one")]
    assert [(r["name"], r["row"]) for r in by["c.xlsx"]] == [("P", '{"year": 2024.0, "revenue": 4048.0, "revenue=": "A2*2"}')]
    assert "no catalog" in by["d.pdf"][0]["error"]
    assert by["e.docx"][0]["error"]
    assert "f.txt" not in by


def test_size_limit(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(b"x" * 100)
    assert office.files(spark, str(tmp_path), limit=99).count() == 0


def flood(mask):
    """Parts by walking from cell to cell."""
    left, out = {(int(x), int(y)) for y, x in zip(*np.nonzero(mask), strict=True)}, []
    for x, y in sorted(left, key=lambda p: (p[1], p[0])):
        if (x, y) in left:
            todo, own = [(x, y)], []
            left.discard((x, y))
            while todo:
                i, j = todo.pop()
                own.append((i, j))
                for n in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                    if n in left:
                        left.discard(n)
                        todo.append(n)
            xs, ys = [p[0] for p in own], [p[1] for p in own]
            out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(own)))
    return out


def test_parts_equal_a_flood_fill():
    rng = np.random.default_rng(4)
    for share in (0.1, 0.4, 0.5, 0.6, 0.9, 0.0, 1.0):
        mask = rng.random((40, 57)) < share
        assert images.parts(mask) == flood(mask)
    spiral = np.zeros((9, 9), bool)
    spiral[0, :] = spiral[:, 8] = spiral[8, :] = spiral[2:, 0] = spiral[2, :7] = spiral[2:7, 6] = spiral[6, 2:7] = True
    assert images.parts(spiral) == flood(spiral)


def plain_regions(rgb):
    height, width = rgb.shape[:2]
    gray = (lambda x, y: float(images.luma(rgb[y, x][None])[0]))
    scale = max(1, max(width, height) / 256)
    mask = np.zeros((max(16, int(height / scale)), max(16, int(width / scale))), bool)
    for y in range(mask.shape[0]):
        for x in range(mask.shape[1]):
            a, b = min(width - 1, int(x * scale)), min(height - 1, int(y * scale))
            mask[y, x] = abs(gray(a, b) - gray(min(width - 1, a + 1), b)) + abs(gray(a, b) - gray(a, min(height - 1, b + 1))) > 40
    boxes = []
    for x, y, w, h, n in flood(mask):
        for k, (a, b, c, d) in enumerate(boxes if n >= 20 else []):
            if x <= a + c + 4 and a <= x + w + 4 and y <= b + d + 4 and b <= y + h + 4:
                left, top = min(a, x), min(b, y)
                boxes[k] = (left, top, max(a + c, x + w) - left, max(b + d, y + h) - top)
                break
        else:
            boxes += [(x, y, w, h)] if n >= 20 else []
    out = [(int(x * scale), int(y * scale), min(width, int(np.ceil(w * scale))), min(height, int(np.ceil(h * scale)))) for x, y, w, h in boxes]
    return sorted((r for r in out if r[2] >= width * 0.03 and r[3] >= height * 0.02 and r[2] <= width * 0.95 and r[3] <= height * 0.5 and r[1] + r[3] < height * 0.88), key=lambda r: -r[2] * r[3])[:12]


def test_regions_equal_a_plain_version():
    rng = np.random.default_rng(8)
    for height, width in ((300, 420), (64, 40), (12, 9), (530, 260)):
        rgb = np.full((height, width, 3), 250, np.uint8)
        for _ in range(14):
            y, x = rng.integers(0, height), rng.integers(0, width)
            rgb[y : y + rng.integers(2, 30), x : x + rng.integers(5, 90) : rng.integers(1, 4)] = rng.integers(0, 256, 3)
        assert images.text_regions(images.luma(rgb)) == plain_regions(rgb)
    assert set(np.unique(images.binarized(rng.integers(0, 255, (8, 8, 3))))) <= {0, 255}


def test_readable_regions_and_odd_images(spark):
    assert [images.readable(0, 0, w, h, 400) for w, h in ((60, 25), (59, 25), (60, 24))] == [True, False, False]
    assert [images.readable(0, y, 626, 25, 400) for y in (99, 100)] == [True, False] and images.readable(0, 200, 625, 25, 400)
    rows = spark.createDataFrame([(None, 2, 2), (bytearray(b""), 0, 0), (bytearray(11), 2, 2), (bytearray(12), 2, 2), (bytearray(12), None, 2)], "p binary, w int, h int")
    assert [r[0] for r in rows.coalesce(1).select(images.regions(F.col("p"), F.col("w"), F.col("h"))).collect()] == [None, None, None, [], None]


def test_images_are_made_a_few_at_once(spark):
    keys = pa.record_batch([pa.array(range(2000), pa.int64())], names=["s_suppkey"])
    seen = []
    for batch in q_sources._images(iter([keys])):
        assert batch.nbytes < 8 << 20
        seen += batch.column(0).to_pylist()
    assert seen == list(range(2000))
    parts = q_sources._drawn(spark.range(40).coalesce(1)).select(F.spark_partition_id()).distinct()
    assert parts.count() > 1


@pytest.mark.parametrize("number", range(12))
def test_pdf_forms(number):
    text = " ".join(f"wörd{i} (x)\\\\" for i in range(650)) + (" 日本" if number == 4 else "")
    raw = q_office._pdf(number, "Tïtle", text)
    found = list(pdf.read_pdf(raw))
    assert (found[0]["text"], found[0]["level"], len(found)) == ("Tïtle", 5, 6)
    whole = " ".join(r["text"] for r in found[1:])
    assert whole == ("" if number % 10 == 9 else text) or not whole.strip() and number % 10 == 9
    if number % 10 != 9:
        # The tables of references damaged: objects are looked for.
        assert [r["text"] for r in pdf.read_pdf(raw.replace(b"startxref", b"startxxxx"))] == [r["text"] for r in found]


def test_pdf_damage_gives_rows_or_errors(spark):
    rng, raw = random.Random(1), [q_office._pdf(n, "t", "some words of text " * 40) for n in range(8)]
    rows = [(str(i), "pdf", bytearray(b)) for i, b in enumerate([b"", b"%PDF", b"%PDF-1.7 trailer <</Root 1 0 R/Encrypt 2 0 R>> 1 0 obj <</Type/Catalog>> endobj"])]
    for n in range(60):
        x = bytearray(rng.choice(raw))
        for _ in range(rng.randrange(1, 20)):
            x[rng.randrange(len(x))] = rng.randrange(256)
        rows.append((str(10 + n), "pdf", x[: rng.choice([len(x), rng.randrange(len(x))])]))
    got = office.extract(spark.createDataFrame(rows, "path string, kind string, content binary")).collect()
    errors = {r["path"]: r["error"] for r in got if r["error"]}
    assert {"0", "1", "2"} <= set(errors) and "encrypted" in errors["2"]
    assert {r["path"] for r in got} == {r[0] for r in rows}


def test_pdf_operators_and_forms():
    """Placement, leading, kerning, quotes, nested forms, page inheritance and several contents."""
    body = b"BT /F 10 Tf 1 0 0 1 50 700 Tm [(A) -300 (B) 20 (C)] TJ 0 -20 TD (next) Tj (quoted) ' ET q 2 0 0 2 10 10 cm /X Do Q"
    form = b"BT /F 5 Tf 1 2 Td <6869> Tj ET"
    raw = b"%%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Kids[3 0 R]/Resources<</Font<</F 6 0 R>>/XObject<</X 5 0 R>>>>>>endobj 3 0 obj<</Contents[4 0 R 4 0 R]>>endobj 4 0 obj<</Length %d>>stream\n%s\nendstream endobj 5 0 obj<</Subtype/Form/Length %d>>stream\n%s\nendstream endobj 6 0 obj<</Subtype/Type1/Encoding<</Differences[65/adieresis/uni00DF]>>>>endobj" % (len(body), body, len(form), form)
    page = list(pdf.read_pdf(raw))[1]
    once = [("ä ßC", 50, 700, 10), ("next", 50, 680, 10), ("quoted", 50, 660, 10), ("hi", 12, 14, 10)]
    assert [(r["text"], r["x"], r["y"], r["h"]) for r in json.loads(page["row"])] == once * 2


def test_pdfs_are_read_whole(spark, tmp_path):
    """src5 (F4): every page of a file of more than 30, as in the SQL; forms however deep they are, but none within itself."""
    import duckdb

    spark.createDataFrame([(n, f"s{n}", " ".join(f"w{i}" for i in range(300 * 45 + n))) for n in range(4)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.QUERIES["src5_pdf_pages"](spark, str(tmp_path))
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=lambda r: r[:2]) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES['src5_pdf_pages']})").fetchall(), key=lambda r: r[:2])
    assert max(r[1] for r in rows) == 45 and len(rows) == 4 * 46 + 3

    form = "%d 0 obj<</Subtype/Form/Resources<</XObject<</X %d 0 R>>>>/Length %d>>stream\n%s\nendstream endobj "
    deep = "".join(form % (n, n + 1 if n < 15 else 4, 21, f"BT (f{n:02}) Tj ET /X Do") for n in range(4, 16))
    raw = f"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Kids[3 0 R]>>endobj 3 0 obj<</Resources<</XObject<</X 4 0 R>>>>/Contents 20 0 R>>endobj {deep}20 0 obj<</Length 5>>stream\n/X Do\nendstream endobj"
    assert list(pdf.read_pdf(raw.encode()))[1]["text"].split() == [f"f{n:02}" for n in range(4, 16)]


def test_long_pdfs_are_read_in_proportion(spark):
    """src5 (F3): files whose objects are in streams, and files whose tables say more than they have, take no longer than others."""
    text = "words of a line " * 60_000
    raw = [q_office._pdf(n, "t", text) for n in (0, 1)]
    took = []
    for x in raw:
        start = time.process_time()
        rows = list(pdf.read_pdf(x))
        took.append(time.process_time() - start)
        assert len(rows) == 801 and " ".join(r["text"] for r in rows[1:]) == text.strip()
    assert took[1] < 4 * took[0] + 1
    short = q_office._pdf(0, "t", "a b")
    assert [r["text"] for r in pdf.read_pdf(short.replace(b"xref\n0 8", b"xref\n0 88888888888"))] == ["t", "a b"]

    # Rows of many files are one batch, those of a long file several, in order.
    files = pa.record_batch([pa.array(["a"] * 300), pa.array(["pdf"] * 300), pa.array([short] * 300)], names=["path", "kind", "content"])
    assert [b.num_rows for b in office._extract(iter([files]))] == [600]
    files = pa.record_batch([pa.array(["a", "b"]), pa.array(["pdf", "pdf"]), pa.array([raw[1], short])], names=["path", "kind", "content"])
    parts = list(office._extract(iter([files, files])))
    assert len(parts) < 5 and [(r["path"], r["part"]) for b in parts for r in b.to_pylist()] == 2 * ([("a", k) for k in range(-1, 800)] + [("b", -1), ("b", 0)])


def test_texts_of_pdfs_are_dealt_out(spark):
    """src5 (F3): one file or row group of a table is one partition, the PDFs of its texts aren't."""
    rows = spark.range(40).selectExpr("id AS doc_id", "'s' AS source", "concat('text ', id) AS text").coalesce(1)
    made = q_office._pdfs(rows).select("path", F.spark_partition_id().alias("part")).collect()
    assert len({r["part"] for r in made}) > 1 and sorted(int(r["path"]) for r in made) == list(range(40))


def test_pdf_codes():
    """src5 (F3): codes are the same in one step as one by one."""
    file = pdf.File(q_office._pdf(0, "t", "x"))
    for differences, said in (([], "AB (\ufffd€"), ([65, "adieresis", "uni00DF"], "äß (\ufffd€"), ([65, "ffi"], "ffiB (\ufffd€")):
        assert pdf.Font(file, {"Encoding": {"Differences": differences}}).text(b"AB (\x81\x80") == said
    for more, third in ((b"", "\ufffd"), (b" 1 beginbfchar <0003> <00660069> endbfchar", "fi")):
        font = pdf.Font(file, {"Subtype": "Type0", "ToUnicode": ({}, b"1 beginbfrange <0001> <0002> <0041> endbfrange 1 beginbfchar <0103> <D83DDE00> endbfchar" + more)})
        assert [font.text(bytes.fromhex(x)) for x in ("00020001", "000200010003", "01030001", "000102", "")] == ["BA", f"BA{third}", "😀A", "AB", ""]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "id % 7 AS job_id", "id % 3 AS deal_id", "'t' AS type", "CASE WHEN id % 2 = 0 THEN 'running' ELSE 'failed' END AS status", "CAST(id AS int) AS progress_pct", "CAST(NULL AS string) AS message", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id) AS updated_at")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    got = []
    q = feed.deliver(feed.for_client(feed.job_updates(spark, str(tmp_path / "in"), 2), 1), str(tmp_path / "cp"), lambda batch, n: got.extend(batch.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["id"] for r in got) == sorted(r["id"] for r in rows.filter("deal_id = 1").collect())
    assert {r["terminal"] for r in got} == {True, False}


def test_keys_of_images_are_dealt_out(spark):
    """x17: one file of keys is one partition, their images aren't."""
    made = q_sources._drawn(spark.range(60).coalesce(1)).select("key", images.gray_counts(F.col("pixels")).alias("black"), F.spark_partition_id().alias("part")).collect()
    assert len({r["part"] for r in made}) > 1
    assert {r["key"]: r["black"] for r in made} == {k: (20 + k % 30) * (15 + k % 17) + 600 + (900 if k % 3 % 2 == 0 else 0) for k in range(60)}


@pytest.mark.parametrize("name", ["x15_text_regions", "x17_preprocessed"])
def test_pixels_stay_where_they_are_made(spark, name, tmp_path):
    """x15, x17 (F2): an image of 200 KB a key is in no plan's column, and results equal those of images as a column."""
    spark.range(50).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "pixels#" not in plan and "ArrowEvalPython" not in plan
    made = q_sources._drawn(spark.range(50))
    if name == "x17_preprocessed":
        whole = made.select("key", images.gray_counts(F.col("pixels")).alias("black"))
    else:
        whole = made.select("key", F.posexplode(images.regions(F.col("pixels"), F.lit(256), F.lit(256)))).select("key", "pos", "col.*")
    assert got.schema.simpleString() == whole.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and got.count() >= 50


def test_pdfs_of_odd_rows(spark):
    """src5: wide texts whose words no space parts, a null title, a null text."""
    rows = [(2, "s", "one\ntwo"), (6, None, "日本\tx"), (3, None, None), (4, "t", "日\n本")]
    made = q_office._pdfs(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    got = {(r["path"], r["part"]): (r["text"], r["error"]) for r in office.extract(made).collect()}
    assert got == {("2", -1): ("s", None), ("2", 0): ("one two", None), ("6", -1): (None, None), ("6", 0): ("日本 x", None), ("3", -1): (None, None), ("3", 0): ("", None), ("4", -1): ("t", None), ("4", 0): ("日 本", None)}
