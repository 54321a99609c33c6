"""Document extraction and grouping as DataFrames: per-page and per-file rows instead of loops over one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.numbers import half_up

c = F.col


def page_keys(pages: DataFrame, reach: int = 300) -> DataFrame:
    """(document_id, key): the keys of each page's title and of the beginning of its text; empty ones are left out. The
    beginning is what the rule compares: running heads stand there."""
    samples = F.explode(F.array(t.text(c("title")), F.left(t.text(c("text")), F.lit(reach))))
    return pages.select("document_id", samples.alias("x")).select("document_id", t.boilerplate_key(c("x")).alias("key")).filter(c("key") != "")


def page_boilerplate(pages: DataFrame, share: float = 0.4) -> DataFrame:
    """Keys of pages (document_id, title, text) that occur at least as often as a share of the document's pages."""
    seen = page_keys(pages).groupBy("document_id", "key").agg(F.count("*").alias("seen"))
    total = pages.groupBy("document_id").agg(F.count("*").alias("pages"))
    return seen.join(total, "document_id").filter(c("seen") >= F.greatest(F.lit(1), F.ceil(c("pages") * share))).drop("pages")


def slide_summary(slides: DataFrame) -> DataFrame:
    """Per document: the first ten distinct topics, and messages of the first five slides."""
    rows = slides.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("n", "title", "text"))).alias("s"))
    topics = F.slice(F.array_distinct(F.transform("s", lambda x: x["title"])), 1, 10)
    messages = F.transform(F.slice("s", 1, 5), lambda x: F.coalesce(F.nullif(x["title"], F.lit("")), F.left(x["text"], F.lit(100))))
    return rows.select("document_id", topics.alias("topics"), messages.alias("messages"))


def full_text(parts: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Per document its parts (n, text) in order, joined by spaces; the cut is the rule's. Parts that start beyond it are left out before
    a document's parts meet, so that no more than the cut is held."""
    order = Window.partitionBy("document_id").orderBy("n", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.filter(c("text").isNotNull()).withColumn("__start", F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    return rows.filter(c("__start") < most).groupBy("document_id").agg(F.left(F.array_join(ordered, " "), F.lit(most)).alias("full_text"))


def text_parts(rows: DataFrame) -> DataFrame:
    """What the readers gave (document_id, kind, part, pos, name, text, row) as parts of the full text (n, text), by format.

    A PDF's page gives its text, then its title; a sheet its name, its headers and its rows' values; a slide its title, then the rest; Word its
    paragraphs and table rows, and these once more as a whole; an image its text. Empty parts aren't parts."""
    at = lambda *more: F.struct("part", *[F.lit(x).alias(f"k{i}") for i, x in enumerate(more)], "pos").alias("n")
    some = rows.filter(c("kind") != "excel").filter(F.coalesce("text", F.lit("")) != "")
    pages = some.filter("kind IN ('pdf', 'image') AND name IN ('page', 'image')").select("document_id", at(0, 0), "text")
    titles = some.filter("kind = 'pdf' AND name = 'title'").select("document_id", at(1, 0), "text")
    slides = some.filter("kind = 'powerpoint'").select("document_id", F.struct("part", F.when(c("name") == "title", 0).otherwise(1).alias("k0"), F.lit(0).alias("k1"), "pos").alias("n"), "text")
    word = some.filter("kind = 'word'")
    once = word.select("document_id", F.struct(F.lit(0).alias("part"), F.lit(0).alias("k0"), F.lit(0).alias("k1"), "pos").alias("n"), "text")
    again = word.select("document_id", F.struct(F.lit(0).alias("part"), F.lit(1).alias("k0"), F.lit(0).alias("k1"), "pos").alias("n"), "text")
    sheet = rows.filter("kind = 'excel'").withColumn("__row", F.from_json("row", "map<string,string>"))
    values = sheet.select("document_id", at(1, 1), F.array_join(F.map_values("__row"), " ").alias("text"))
    heads = sheet.groupBy("document_id", "part").agg(F.min_by(F.struct("name", F.map_keys("__row").alias("headers")), "pos").alias("h"))
    head = lambda k, text: heads.select("document_id", F.struct("part", F.lit(0).alias("k0"), F.lit(k).alias("k1"), F.lit(0).alias("pos")).alias("n"), text.alias("text"))
    named = head(0, F.concat(F.lit("Sheet: "), "h.name")).unionByName(head(1, F.array_join(F.filter("h.headers", lambda x: ~x.endswith("=")), " ")))
    kind = "struct<part:int,k0:int,k1:int,pos:bigint>"
    out = None
    for x in (pages, titles, slides, once, again, values, named):
        x = x.withColumn("n", c("n").cast(kind))
        out = x if out is None else out.unionByName(x)
    return out.filter(F.length("text") > 0)


def page_count(kind: Column, parts: Column) -> Column:
    return F.when(kind.isin("pdf", "excel", "powerpoint"), parts).when(kind.isin("word", "image"), 1).otherwise(0)


def ingest_state(empty: Column, error: Column, hundredths: Column, kind: Column, attempt: Column) -> Column:
    needs = F.when(kind == "word", 25).otherwise(50)
    image_only = F.lower(error).contains("no text extracted") | F.lower(error).contains("image-only")
    return (
        F.when(empty, "failed")
        .when(error.isNotNull(), F.when(image_only, "needs_ocr").otherwise("failed"))
        .when(hundredths < needs, F.when(attempt == 0, "pending").otherwise("failed"))
        .otherwise("completed")
    )


def evidence_rows(analysed: DataFrame) -> DataFrame:
    """One row per metric (0.8), heading (kind section, 0.9) and summary (0.85), from one explode."""
    item = lambda kind, conf: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text"), F.lit(conf).alias("confidence"))
    summary = F.filter(F.array(item("summary", 0.85)(c("summary"))), lambda x: F.length(x["text"]) > 0)
    rows = F.concat(F.transform("metrics", item("metric", 0.8)), F.transform("headings", item("section", 0.9)), summary)
    return analysed.select("document_id", F.explode(rows).alias("e")).select("document_id", F.lit("extraction").alias("source"), "e.*")


def ocr_stats(words: DataFrame) -> DataFrame:
    return words.groupBy("document_id").agg(
        (F.sum("conf").cast("double") / F.count("*")).alias("mean"), F.min("conf").cast("double").alias("low"), F.max("conf").cast("double").alias("high"), F.count("*").alias("words")
    )


def ingestion_report(documents: DataFrame) -> DataFrame:
    """Per deal: per-document summaries with defaults, totals, averages, readiness."""
    v = c("verification_status")
    quality, ocr = F.coalesce("quality_pct", F.lit(50)), F.coalesce("ocr_confidence", F.lit(100))
    return documents.groupBy("deal_id").agg(
        F.count("*").alias("n"), F.sum("page_count").cast("long").alias("pages"), half_up(F.sum(quality).cast("double") / F.count("*"), 2).alias("quality"),
        half_up(F.sum(ocr).cast("double") / F.count("*"), 2).alias("ocr"), F.array_sort(F.collect_list(F.struct("document_id", quality.alias("quality"), ocr.alias("ocr")))).alias("documents"),
        F.when(F.count_if(v == "failed") > 0, "failed").when(F.count_if(v == "warnings") > 0, "needs_review").otherwise("ready").alias("readiness"),
    )


def evidence_drafts(documents: DataFrame, done: DataFrame, term: str) -> DataFrame:
    """Drafts of the documents that have none yet and whose title and type hold the term."""
    term = term.strip().lower()
    rows = documents.join(done.select("document_id").distinct(), "document_id", "left_anti")
    rows = rows.filter(F.lower(F.concat_ws(" ", "title", "type")).contains(term)) if term else rows
    text = F.concat(c("title"), F.lit(" ("), c("type"), F.lit(")"))
    kind = F.when(F.length(F.coalesce("type", F.lit(""))) > 0, F.concat(F.lit("type: "), c("type")))
    excerpt = F.concat_ws(" • ", c("title"), kind, F.concat(F.lit("status: "), c("status")))
    return rows.select("document_id", "deal_id", F.lit("fetch_evidence").alias("source"), F.lit("document").alias("kind"), text.alias("text"), excerpt.alias("excerpt"), F.lit(0.7).alias("confidence"))


def groups(files: DataFrame, fold: bool = True) -> DataFrame:
    """Per company: its files and how many types occur more than once. Counted by (company, type) first."""
    name = t.company(c("filename"))
    rows = files.select((F.lower(name) if fold else name).alias("company"), t.file_document_type(c("filename")).alias("type"))
    kinds = rows.groupBy("company", "type").agg(F.count("*").alias("n"))
    return kinds.groupBy("company").agg(F.sum("n").alias("files"), F.count_if(c("n") > 1).alias("duplicate_sets"), F.array_sort(F.collect_set("type")).alias("types"))


def matched(groups_: DataFrame, deals: DataFrame) -> DataFrame:
    """Groups with the deal of their name, whatever its case; of several deals the first by id."""
    first = deals.groupBy(F.lower("name").alias("__name")).agg(F.min("id").alias("deal_id"))
    return groups_.join(first, F.lower(groups_["company"]) == first["__name"], "left").drop("__name")


def batch_analysis(groups_: DataFrame, deals: DataFrame) -> DataFrame:
    rows = matched(groups_, deals)
    return rows.withColumn("status", F.when(c("deal_id").isNull(), "unmatched").otherwise("matched")).orderBy("status", F.desc("files"), "company")


def column_profiles(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per sheet and column of JSON rows (sheet, n, row): the type of the first value by n that isn't null (a number, a
    text that starts with a date, other text), and the range and mean of the numbers if that type is numeric."""
    cell = lambda x: F.struct(F.lit(x).alias("column"), F.try_variant_get(F.parse_json("row"), f"$.{x}", "variant").alias("v"))
    cells = rows.select("sheet", "n", F.posexplode(F.array(*map(cell, columns))).alias("i", "cell")).select("sheet", "n", "i", "cell.column", F.col("cell.v").alias("v"))
    kind = F.schema_of_variant("v")
    is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    cells = cells.select("sheet", "n", "i", "column", F.when(kind != "VOID", kind).alias("kind"), F.when(is_number, F.try_variant_get("v", "$", "double")).alias("number"), F.when(kind == "STRING", F.try_variant_get("v", "$", "string")).alias("text"))
    name = F.when(c("number").isNotNull(), "numeric").when(c("text").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date").otherwise("text")
    first = F.min_by(F.when(c("kind").isNotNull(), name), F.when(c("kind").isNotNull(), c("n")))
    out = cells.groupBy("sheet", "i", "column").agg(F.coalesce(first, F.lit("empty")).alias("type"), F.min("number").alias("low"), F.max("number").alias("high"), (F.sum("number") / F.count("number")).alias("mean"))
    return out.select("sheet", "column", "type", *(F.when(c("type") == "numeric", c(x)).alias(x) for x in ("low", "high", "mean")))


def best_contexts(found: DataFrame, boilerplate: DataFrame | None = None, first: bool = False) -> DataFrame:
    """Per document and numeric value of found (document_id, value, context, n) the context with the least noise; the
    first wins ties. Garbled contexts, and those with a key of boilerplate (document_id, key), are left out."""
    rows = found.select("document_id", F.lower(t.trimmed(c("value"))).alias("value"), t.collapse(c("context")).alias("context"), "n")
    rows = rows.filter(t.is_numeric_value(c("value")) & ~t.is_garbled(c("context")))
    if boilerplate is not None:
        keys = boilerplate.select("document_id", c("key").alias("__key")).distinct()
        rows = rows.withColumn("__key", t.boilerplate_key(c("context"))).join(keys, ["document_id", "__key"], "left_anti").drop("__key")
    noise = F.length("context") + 40 * F.when(t.count(c("context"), t.CAPS_RUN) > 6, 1).otherwise(0) + 15 * t.count(c("context"), t.WEIRD)
    best = rows.groupBy("document_id", "value").agg(F.min(F.struct(noise.alias("noise"), "n", "context")).alias("b"), F.min("n").alias("first"))
    return best.select("document_id", "value", "b.context", "b.n", *(["first"] if first else []))


def structured_data(analysed: DataFrame) -> DataFrame:
    """The structured payload of a document by its kind (kind, parts, headings): its summary are the first pages of a PDF, the key messages of
    slides, the first 500 characters of Word files and images. Workbooks have workbook_data()."""
    first = F.left(F.array_join(F.slice("parts", 1, 3), " "), F.lit(500))
    joined = F.array_join(F.slice("parts", 1, 5), " | ")
    summary = F.when(c("kind") == "powerpoint", joined).otherwise(first)
    return analysed.select("document_id", F.struct(F.slice("headings", 1, 10).alias("main_headings"), summary.alias("text_summary"), F.array().cast("array<struct<type:string,value:string>>").alias("entities")).alias("s"))


def cleaned_pages(pages: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """pages (document_id, page, title, text) with their text stripped of links, addresses and those of the document's titles that repeat:
    good titles of 40 characters or fewer, without a logo's prefix, whose key is boilerplate (document_id, key). Titles with such a
    key become empty. A document's titles are as many as its pages, at most; null titles and texts are empty."""
    keys = boilerplate.select("document_id", c("key").alias("__key")).distinct()
    title = t.strip_logo(c("title"))
    good = pages.filter(t.is_good_title(c("title"))).select("document_id", title.alias("title"), "page", t.boilerplate_key(title).alias("__key")).filter(F.length("title") <= 40)
    first = good.join(keys, ["document_id", "__key"], "left_semi").groupBy("document_id", "title").agg(F.min("page").alias("page"))
    repeated = first.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "title"))), lambda x: x["title"]).alias("__titles"))
    marked = pages.withColumn("__key", t.boilerplate_key(c("title"))).join(keys.withColumn("__bad", F.lit(True)), ["document_id", "__key"], "left")
    rows = marked.join(repeated, "document_id", "left")
    text = t.strip_boilerplate(c("text"), F.coalesce("__titles", F.array().cast("array<string>")))
    return rows.select("document_id", "page", F.when(F.coalesce("__bad", F.lit(False)), "").otherwise(F.coalesce("title", F.lit(""))).alias("title"), text.alias("text"))


def key_numbers(metrics: DataFrame, numbers: DataFrame, boilerplate: DataFrame | None = None, most: int = 20) -> DataFrame:
    """The first most numeric values of each document with their least noisy context: of metrics (document_id, page, pos, value, label),
    which come first, and of numbers in the text (document_id, page, pos, value, context). Values are in the order in which they first
    have a sound context; the limit is the feature."""
    place = lambda kind: F.struct(F.lit(kind).alias("kind"), "page", "pos").alias("n")
    found = metrics.select("document_id", "value", c("label").alias("context"), place(0)).unionByName(numbers.select("document_id", "value", "context", place(1)))
    best = best_contexts(found, boilerplate, first=True)
    order = Window.partitionBy("document_id").orderBy("first")
    return best.withColumn("rank", F.row_number().over(order)).filter(c("rank") <= most).select("document_id", "rank", "value", "context")


def workbook_data(profiles: DataFrame, sheets: DataFrame) -> DataFrame:
    """The structured payload of workbooks: sheet names as headings, a sentence of their numbers as summary, and the range and mean of each
    numeric column as metrics. sheets: document_id, part, sheet, rows; profiles: document_id, part, sheet, column, low, high, mean."""
    one = sheets.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "sheet"))), lambda x: x["sheet"]).alias("main_headings"), F.count("*").alias("n"), F.sum("rows").alias("rows"))
    numeric = profiles.filter("mean IS NOT NULL").select("document_id", F.struct("part", F.concat("sheet", F.lit("."), "column").alias("key"), "low", "high", "mean", c("sheet").alias("source")).alias("m"))
    metrics = numeric.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list("m")), lambda x: x.dropFields("part")).alias("key_metrics"))  # a workbook's columns
    summary = F.concat(F.lit("Workbook of "), c("n").cast("string"), F.lit(" sheet(s) and "), c("rows").cast("string"), F.lit(" rows"))
    return one.join(metrics, "document_id", "left").select("document_id", "main_headings", summary.alias("text_summary"), "key_metrics")
