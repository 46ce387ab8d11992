"""Page layout as plans over tables of spans (digital pages) and words (recognised pages): fonts, lines, headings, lists, tables and running lines become typed blocks.

Span table: (doc, page, block, line, span, text, size, bold, x0, y0, x1, y1), the box being the block's. Word table: (doc, page, block, par, line, word, text, height, conf).
Table boxes: (doc, page, y, rows, x0, y0, x1, y1). Blocks have the shape that the office readers give, with doc, page and their order on the page (`top`, `seq`).
Every step is an aggregate or a window by document or page, so pages spread over the cluster; the only join on inequalities is kept within a page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumaria.functions import text as X

# Sizes without any text, deepest level by size, level of bold headings, longest headings, what a heading does not end with, shares of heights.
NO_TEXT, DEEPEST, BOLD_LEVEL, LONGEST, LONGEST_BOLD, LONGEST_OCR = 12, 4, 3, 120, 60, 80
NOT_LAST, NOT_LAST_OCR = ".,;:", ".,"
MOSTLY, TALL, TALLEST = 0.6, 1.25, 1.6
#: Coordinates beyond this share the outermost cells; whether a centre lies in a box is always told by the coordinates themselves.
FAR = 2.0**40
BLOCK = "struct<type:string,text:string,level:int,items:array<string>,ordered:boolean,rows:array<array<string>>>"


def _mode(rows: DataFrame, keys: list[str], value: str, weight: Column, first: Column, name: str) -> DataFrame:
    """The value of most weight for each key; of equals the one that comes first."""
    sums = rows.groupBy(*keys, value).agg(F.sum(weight).alias("weight"), F.min(first).alias("first"))
    return sums.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("weight")).alias("w"), "first")).alias(name))


def _place(*names: str) -> Column:
    return F.struct(*names)


def sized(spans: DataFrame) -> DataFrame:
    """spans with n, the characters without white space at the ends, and size as a whole number, halves to even."""
    return spans.withColumn("n", F.coalesce(F.length(X.stripped(F.col("text"))), F.lit(0))).withColumn("size", F.bround("size").cast("int"))


def font_model(spans: DataFrame) -> DataFrame:
    """(doc, size, chars, body, level) for every size with text: body is the document's most frequent size by characters; larger ones have levels, largest first, four at most."""
    rows = sized(spans).where("n > 0")
    sums = rows.groupBy("doc", "size").agg(F.sum("n").alias("chars"), F.min(_place("page", "block", "line", "span")).alias("first"))
    body = sums.groupBy("doc").agg(F.min_by("size", F.struct((-F.col("chars")).alias("w"), "first")).alias("body"))
    ranked = sums.join(body, "doc").withColumn("rank", F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc("size"))))
    return ranked.select("doc", "size", "chars", "body", F.when(F.col("size") > F.col("body"), F.least("rank", F.lit(DEEPEST))).alias("level"))


def line_info(spans: DataFrame) -> DataFrame:
    """(doc, page, block, line, text, size, bold): a line's text, its size of most characters (0 without any) and whether most of it is bold."""
    keys = ["doc", "page", "block", "line"]
    rows = sized(spans)
    texts = rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: F.coalesce(s["text"], F.lit(""))), "").alias("text"),
        F.coalesce(F.sum(F.when(F.col("bold"), F.col("n"))) / F.nullif(F.sum("n"), F.lit(0)) > MOSTLY, F.lit(False)).alias("bold"),
    )
    size = _mode(rows.where("n > 0"), keys, "size", F.col("n"), F.col("span"), "size")
    return texts.join(size, keys, "left").select(*keys, "text", F.coalesce("size", F.lit(0)).alias("size"), "bold")


def looks_like_heading(text: Column, size: Column, body: Column, bold: Column, level: Column) -> Column:
    fits = (text != "") & (F.length(text) <= LONGEST) & ~F.right(text, F.lit(1)).isin(*NOT_LAST)
    return fits & (level.isNotNull() | (bold & (size >= body) & (F.length(text) <= LONGEST_BOLD)))


def _blank(kind: str) -> dict[str, Column]:
    kinds = {"text": "string", "level": "int", "items": "array<string>", "ordered": "boolean", "rows": "array<array<string>>"}
    return {"type": F.lit(kind)} | {k: F.lit(None).cast(v) for k, v in kinds.items()}


def _block(kind: str, **parts: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in (_blank(kind) | parts).items()]).cast(BLOCK)


def _typed(texts: Column, joined: Column, heading: Column, level: Column) -> Column:
    """Heading before list, list before paragraph: a numbered title is no list of one."""
    listed = F.forall(texts, X.is_list_line)
    items = _block("list", items=F.transform(texts, X.strip_list_marker), ordered=F.element_at(texts, 1).rlike(X.ORDERED))
    return F.when(heading, _block("heading", text=joined, level=level)).when(listed, items).otherwise(_block("paragraph", text=joined))


def inside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """blocks (doc, page, block, x0, y0, x1, y1) without those whose centre lies in a table's box of their page.

    Different centres meet different boxes by cells. A cell is at least as wide and as high as the boxes that are put into it, by powers of two, so a box has three by three of them at most, and a centre meets
    boxes of its surroundings only, once for each size that the page has: work grows with blocks and boxes, not with their product.
    """
    at = {"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2}
    within = lambda c: F.greatest(F.least(F.col(c).cast("double"), F.lit(FAR)), F.lit(-FAR))
    fit = lambda a, b: F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(within(b) - within(a), F.lit(1.0)))))
    cell = lambda c, size: F.floor(within(c) / F.col(size))
    boxes = tables.select("doc", "page", *(F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1"))).where("tx0 <= tx1 and ty0 <= ty1").distinct()
    boxes = boxes.withColumns({"wide": fit("tx0", "tx1"), "high": fit("ty0", "ty1")})
    for name, size, a, b in (("i", "wide", "tx0", "tx1"), ("j", "high", "ty0", "ty1")):
        boxes = boxes.withColumn(name, F.explode(F.sequence(cell(a, size), cell(b, size))))
    centres = blocks.select("doc", "page", *(c.alias(k) for k, c in at.items())).distinct()
    centres = centres.join(boxes.select("doc", "page", "wide", "high").distinct(), ["doc", "page"]).withColumns({"i": cell("cx", "wide"), "j": cell("cy", "high")})
    covered = centres.join(boxes, ["doc", "page", "wide", "high", "i", "j"]).where("cx between tx0 and tx1 and cy between ty0 and ty1").select("doc", "page", *at).distinct()
    return blocks.distinct().withColumns(at).join(covered, ["doc", "page", *at], "left_anti").select(*blocks.columns)


def clean_table(rows: Column) -> Column:
    """Cells without line breaks and white space at the ends; rows without any text go."""
    cells = F.transform(rows, lambda r: F.transform(r, lambda c: X.stripped(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))))
    return F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))


def page_blocks(spans: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(doc, page, top, seq, b): the typed blocks of digital pages by top edge, tables before text of the same height."""
    fonts = font_model(spans)
    boxes = spans.groupBy("doc", "page", "block").agg(*(F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1")))
    found = []
    if tables is not None:
        rows = tables.withColumn("rows", clean_table(F.col("rows"))).where(F.size("rows") > 0)
        boxes = inside_tables(boxes, rows)
        found.append(rows.select("doc", "page", F.col("y0").cast("double").alias("top"), F.lit(0).alias("kind"), F.monotonically_increasing_id().alias("block"), _block("table", rows=F.col("rows")).alias("b")))
    lines = line_info(spans).join(boxes.select("doc", "page", "block", "y0"), ["doc", "page", "block"])
    whole = F.array_sort(F.collect_list(F.struct("line", "text")))
    blocks = lines.groupBy("doc", "page", "block").agg(F.first("y0").alias("y0"), F.max("size").alias("size"), F.max("bold").alias("bold"), whole.alias("lines"))
    blocks = blocks.withColumn("texts", F.filter(F.transform("lines", lambda x: x["text"]), lambda t: X.stripped(t) != "")).where(F.size("texts") > 0)
    levels, bodies = fonts.where("level is not null").select("doc", "size", "level"), fonts.select("doc", "body").distinct()
    blocks = blocks.join(levels, ["doc", "size"], "left").join(bodies, "doc", "left").withColumn("joined", X.join_lines(F.col("texts")))
    heading = (F.size("texts") <= 2) & looks_like_heading(F.col("joined"), F.col("size"), F.coalesce("body", F.lit(NO_TEXT)), F.col("bold"), F.col("level"))
    typed = _typed(F.col("texts"), F.col("joined"), heading, F.coalesce("level", F.lit(BOLD_LEVEL)))
    found.append(blocks.select("doc", "page", F.col("y0").cast("double").alias("top"), F.lit(1).alias("kind"), F.col("block").cast("long").alias("block"), typed.alias("b")))
    order = Window.partitionBy("doc", "page").orderBy("top", "kind", "block")
    return reduce(DataFrame.unionByName, found).withColumn("seq", F.row_number().over(order)).select("doc", "page", "top", "seq", "b")


def real_words(words: DataFrame) -> DataFrame:
    """Words with text and a confidence that is not negative, stripped."""
    return words.withColumns({"text": X.stripped(F.col("text")), "conf": F.expr("try_cast(conf AS double)")}).where("text <> '' and conf >= 0")


def ocr_paragraphs(words: DataFrame) -> DataFrame:
    """(doc, page, block, par, lines, height, body): a paragraph's lines, its median word height, and the page's most frequent height."""
    rows, keys = real_words(words), ["doc", "page", "block", "par"]
    lines = rows.groupBy(*keys, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ").alias("text"))
    lines = lines.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("lines"))
    heights = rows.groupBy(*keys).agg(F.percentile("height", F.lit(0.5)).alias("height"))
    whole = rows.withColumn("tall", F.bround("height").cast("int"))
    body = _mode(whole, ["doc", "page"], "tall", F.lit(1), _place("block", "par", "line", "word"), "body")
    return lines.join(heights, keys).join(body, ["doc", "page"]).select(*keys, "lines", "height", "body")


def ocr_blocks(words: DataFrame) -> DataFrame:
    """(doc, page, top, seq, b): the typed blocks of recognised pages, by block and paragraph."""
    rows = ocr_paragraphs(words).withColumn("joined", X.join_lines(F.col("lines"))).where(F.col("joined") != "")
    tall = F.col("height") > F.col("body") * TALL
    heading = (F.size("lines") == 1) & (F.col("body") > 0) & tall & (F.length("joined") <= LONGEST_OCR) & ~F.right("joined", F.lit(1)).isin(*NOT_LAST_OCR)
    typed = _typed(F.col("lines"), F.col("joined"), heading, F.when(F.col("height") > F.col("body") * TALLEST, 1).otherwise(2))
    order = Window.partitionBy("doc", "page").orderBy("block", "par")
    return rows.select("doc", "page", F.lit(0.0).alias("top"), F.row_number().over(order).alias("seq"), typed.alias("b"))


def ocr_confidence(words: DataFrame, least: float = 60.0, examples: int = 15) -> DataFrame:
    """(doc, page, confidence, n_low, warning): a page's mean confidence to one digit, its words under `least`, and what to tell of them (null without any)."""
    rows = real_words(words)
    low = F.col("conf") < least
    seen = F.transform(F.slice(F.array_sort(F.collect_list(F.when(low, F.struct("block", "par", "line", "word", "text")))), 1, examples), lambda x: x["text"])
    found = rows.groupBy("doc", "page").agg(F.round(F.avg("conf"), 1).alias("confidence"), F.count_if(low).alias("n_low"), seen.alias("seen"))
    said = F.concat(F.col("n_low").cast("string"), F.lit(f" palabra(s) con baja confianza OCR (<{least:.0f}%). Ejemplos: "), F.array_join("seen", ", "))
    return found.select("doc", "page", "confidence", "n_low", F.when(F.col("n_low") > 0, said).alias("warning"))


def document_confidence(pages: DataFrame) -> DataFrame:
    """(doc, ocr_pages, ocr_confidence): the mean of the pages' rounded means, to one digit."""
    return pages.groupBy("doc").agg(F.count("*").alias("ocr_pages"), F.round(F.avg("confidence"), 1).alias("ocr_confidence"))


def running_texts(blocks: DataFrame, share: float = 0.6, least_pages: int = 3, longest: int = 80) -> DataFrame:
    """(doc, text): first or last headings and paragraphs of pages that recur as such on enough of the document's pages."""
    pages = blocks.groupBy("doc").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least_pages)
    rows = blocks.where(F.col("b.type").isin("heading", "paragraph")).select("doc", "page", "seq", X.stripped(F.col("b.text")).alias("text"))
    ends = rows.groupBy("doc", "page").agg(F.min_by("text", "seq").alias("first"), F.max_by("text", "seq").alias("last"))
    told = ends.select("doc", F.explode(F.array(F.struct(F.lit("top").alias("end"), F.col("first").alias("text")), F.struct(F.lit("bottom").alias("end"), F.col("last").alias("text")))).alias("e"))
    n = told.groupBy("doc", "e.end", "e.text").agg(F.count("*").alias("n")).join(pages, "doc")
    return n.where(F.length("text").between(1, longest) & (F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share)))).select("doc", "text").distinct()


def clean_block(b: Column) -> Column:
    text = F.when(b["type"].isin("heading", "paragraph"), X.clean_text(b["text"])).otherwise(b["text"])
    items = F.transform(F.filter(b["items"], lambda x: X.stripped(x) != ""), X.clean_text)
    rows = F.transform(b["rows"], lambda r: F.transform(r, X.clean_text))
    return F.struct(b["type"].alias("type"), text.alias("text"), b["level"].alias("level"), items.alias("items"), b["ordered"].alias("ordered"), rows.alias("rows")).cast(BLOCK)


def non_empty(b: Column) -> Column:
    full = F.when(b["type"] == "list", F.size(b["items"]) > 0).when(b["type"] == "table", F.size(b["rows"]) > 0).otherwise(X.stripped(b["text"]) != "")
    return F.coalesce(full, F.lit(False))


def clean_blocks(blocks: DataFrame, running: bool = True) -> DataFrame:
    """blocks without running headers and footers (on any page), with clean texts, and without those that are empty then."""
    if running:
        gone = running_texts(blocks).select("doc", F.col("text").alias("gone"))
        key = F.when(F.col("b.type").isin("heading", "paragraph"), X.stripped(F.col("b.text")))
        blocks = blocks.withColumn("key", key).join(gone, (blocks["doc"] == gone["doc"]) & (F.col("key") == F.col("gone")), "left_anti").drop("key")
    return blocks.withColumn("b", clean_block(F.col("b"))).where(non_empty(F.col("b")))


def documents_of(blocks: DataFrame) -> DataFrame:
    """(doc, pages array<struct<page, blocks>>): what sinks.markdown.paged_document renders."""
    pages = blocks.groupBy("doc", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "b"))), lambda x: x["b"]).alias("blocks"))
    return pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "blocks"))).alias("pages"))


def pdf_metadata(files: DataFrame, blocks: DataFrame, pages: DataFrame, ocr: DataFrame, language: str = "es") -> DataFrame:
    """Front matter columns of documents: files (doc, source, title, author), cleaned blocks, all pages (doc, page), and ocr as ocr_confidence() has it. Title: the file's, else the first heading, else the stem."""
    heads = blocks.where("b.type = 'heading'").groupBy("doc").agg(F.min_by("b.text", F.struct("page", "seq")).alias("heading"))
    rows = files.join(heads, "doc", "left").join(pages.groupBy("doc").agg(F.count("*").alias("pages")), "doc", "left").join(document_confidence(ocr), "doc", "left")
    said = lambda c: F.nullif(X.stripped(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    name = F.element_at(F.split("source", "/"), -1)
    return rows.select(
        "doc", F.coalesce(said("title"), "heading", F.regexp_replace(name, r"\.[^.]*$", "")).alias("title"), name.alias("source"), F.lit("pdf").alias("file_type"), F.coalesce("pages", F.lit(0)).alias("pages"),
        (F.coalesce("ocr_pages", F.lit(0)) > 0).alias("ocr"), F.lit(language).alias("language"), F.current_date().cast("string").alias("date_processed"), said("author").alias("author"), "ocr_pages", "ocr_confidence",
        F.array().cast("array<string>").alias("tags"),
    )


def office_metadata(documents: DataFrame, language: str = "es") -> DataFrame:
    """office_documents() with front matter columns: title (the file's, else the first heading, else the stem), words of Word texts and lists, sheets of workbooks."""
    name = F.element_at(F.split("source", "/"), -1)
    said = lambda c: F.nullif(X.stripped(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    heading = F.get(F.filter("blocks", lambda b: b["type"] == "heading"), F.lit(0))["text"]
    count = lambda t: F.size(F.filter(F.split(F.coalesce(t, F.lit("")), rf"[{X.BLANK}]+"), lambda w: w != ""))
    words = F.aggregate("blocks", F.lit(0), lambda n, b: n + count(b["text"]) + F.aggregate(F.coalesce(b["items"], F.array().cast("array<string>")), F.lit(0), lambda m, i: m + count(i)))
    kind = F.lower(F.regexp_extract(name, r"\.(\w+)$", 1))
    return documents.select(
        "status", "error", "warnings", "blocks", F.regexp_replace(name, r"\.[^.]*$", "").alias("name"), F.coalesce(said("title"), heading, F.regexp_replace(name, r"\.[^.]*$", "")).alias("title"), name.alias("source"), kind.alias("file_type"),
        F.lit(False).alias("ocr"), F.lit(language).alias("language"), F.current_date().cast("string").alias("date_processed"), said("author").alias("author"),
        F.when((kind == "docx") & (words > 0), words).alias("words"), F.when(kind == "xlsx", F.col("sheets")).alias("sheets"), F.array().cast("array<string>").alias("tags"),
    )
