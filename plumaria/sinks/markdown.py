"""Markdown of documents and vaults as Column expressions and DataFrames, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumaria.functions import text as X


def yaml_scalar(c: Column, kind: str) -> Column:
    if kind in ("boolean", "int", "bigint", "double", "float", "smallint"):
        return F.coalesce(c.cast("string"), F.lit('""'))
    return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def front_matter(df: DataFrame, names: list[str]) -> Column:
    """The columns `names` of df as a front matter block, lists item by item."""
    kinds, lines = dict(df.dtypes), [F.lit("---")]
    for n in names:
        if kinds[n].startswith("array"):
            items = F.array_join(F.transform(n, lambda x: F.concat(F.lit("\n  - "), yaml_scalar(x, "string"))), "")
            lines.append(F.concat(F.lit(f"{n}:"), F.when(F.coalesce(F.size(n), F.lit(0)) > 0, items).otherwise(" []")))
        else:
            lines.append(F.concat(F.lit(f"{n}: "), yaml_scalar(F.col(n), kinds[n])))
    return F.concat_ws("\n", *lines, F.lit("---"))


def table(rows: Column) -> Column:
    """Rows of cells, padded to the widest, under a rule; the first is the header."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    plain = lambda r: F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))))
    lines = F.transform(rows, lambda r: line(plain(r)))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(line(F.array_repeat(F.lit("---"), width))), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def block_text(b: Column) -> Column:
    items = F.array_join(F.transform(b["items"], lambda x, i: F.concat(F.when(b["ordered"], F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), x)), "\n")
    level = F.least(F.greatest(b["level"], F.lit(1)), F.lit(6))
    return F.when(b["type"] == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), b["text"])).when(b["type"] == "list", items).when(b["type"] == "table", table(b["rows"])).otherwise(b["text"])


def compact(head: Column, names: list[str], optional: tuple[str, ...] = ("author", "words", "sheets", "pages", "ocr_pages", "ocr_confidence")) -> Column:
    """A front matter block without the keys that are only there where they have a value."""
    return F.regexp_replace(head, rf'(?m)^(?:{"|".join(n for n in optional if n in names) or "(?!)"}): ""\n', "")


def paged_document(head: Column, pages: Column, markers: bool = True) -> Column:
    """Front matter, then each of pages array<struct<page, blocks>> under its marker."""
    body = lambda p: F.concat(F.concat(F.lit("<!-- página "), p["page"].cast("string"), F.lit(" -->\n")) if markers else F.lit(""), F.array_join(F.transform(p["blocks"], lambda b: F.concat(block_text(b), F.lit("\n"))), "\n"))
    text = F.concat_ws("\n", head, F.lit(""), F.array_join(F.transform(pages, body), "\n"))
    return F.concat(X.stripped(F.regexp_replace(text, "\n{3,}", "\n\n")), F.lit("\n"))


def document(head: Column, blocks: Column, page: int | None = 1) -> Column:
    """Front matter, page marker, blocks with an empty line between; no two empty lines in a row."""
    mark = [F.lit(f"<!-- página {page} -->")] if page is not None else []
    text = F.concat_ws("\n", head, F.lit(""), *mark, F.array_join(F.transform(blocks, lambda b: F.concat(block_text(b), F.lit("\n"))), "\n"))
    return F.concat(X.stripped(F.regexp_replace(text, "\n{3,}", "\n\n")), F.lit("\n"))


def related_section(body: Column, relations: Column) -> Column:
    """body with the section of relations array<struct<name, title, confidence, reasons>> between its markers; without any, none."""
    # Markers, heading and wording of the section.
    line = lambda r: F.concat(F.lit("- "), X.wikilink(r["name"], r["title"]), F.lit(" — **"), F.bround(r["confidence"] * 100).cast("int").cast("string"), F.lit("%** · "), F.when(F.size(r["reasons"]) > 0, F.array_join(r["reasons"], ", ")).otherwise("afinidad"))
    core = F.regexp_replace(X.without_relations(body), r"\s+$", "")
    head = f"{X.RELATIONS[0]}\n## 🔗 Notas relacionadas\n\n> Detectadas automáticamente. El porcentaje es el nivel de confianza.\n\n"
    return F.when(F.coalesce(F.size(relations), F.lit(0)) <= 0, F.concat(core, F.lit("\n"))).otherwise(F.concat(core, F.lit("\n\n\n" + head), F.array_join(F.transform(relations, line), "\n"), F.lit(f"\n\n{X.RELATIONS[1]}\n")))


def own_tags(tags: Column, new: Column, prefixes=("tema/", "evento/", "entidad/")) -> Column:
    """Tags of other namespaces stay; those of ours are replaced by `new`."""
    return F.array_union(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: ~_any(t, prefixes)), new)


def _any(t: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | t.startswith(p)
    return out


def theme_tags(hits: DataFrame, closure: DataFrame, least: float = 2.0) -> DataFrame:
    """(doc_id, tags): tema/<root> and tema/<root>/<concept> of concepts (doc_id, cid, hits) with `least` direct hits; by falling hits, then cid."""
    root = closure.groupBy("cid").agg(F.max_by("ancestor", "k").alias("root"))
    rows = hits.where(F.col("hits") >= least).join(root, "cid")
    own, top = X.tag_slug(F.col("cid")), X.tag_slug(F.col("root"))
    tags = F.when(F.col("root") == F.col("cid"), F.array(F.concat(F.lit("tema/"), own))).otherwise(F.array(F.concat(F.lit("tema/"), top), F.concat(F.lit("tema/"), top, F.lit("/"), own)))
    sets = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("o"), "cid", tags.alias("tags")))).alias("all"))
    return sets.select("doc_id", F.array_distinct(F.flatten(F.transform("all", lambda x: x["tags"]))).alias("tags"))


def index_lines(notes: DataFrame) -> DataFrame:
    """(line, at): the index's entries of (name, title, pages, ocr, ocr_confidence, date_processed), by title, then name."""
    c = F.col
    bits = F.concat_ws(" · ", F.when(c("pages") > 0, F.concat(c("pages").cast("string"), F.lit(" pág."))), F.when(c("ocr"), F.when(c("ocr_confidence") > 0, F.concat(F.lit("OCR "), c("ocr_confidence").cast("string"), F.lit("%"))).otherwise("OCR")), F.concat(F.lit("procesado "), c("date_processed")))
    line = F.concat(F.lit("- "), X.wikilink(c("name"), c("title")), F.when(bits != "", F.concat(F.lit(" — "), bits)).otherwise(""))
    return notes.select(line.alias("line"), F.lower("title").alias("key"), "name").orderBy("key", "name").select("line")


def hubs(members: DataFrame, least: int = 1) -> DataFrame:
    """(hub, n, text) of (hub, name, title): a page of links for each hub with `least` notes; largest first, then by name."""
    links = F.array_sort(F.collect_list(F.struct(F.lower("title").alias("key"), "name", "title")))
    rows = members.groupBy("hub").agg(F.count("*").alias("n"), links.alias("links")).where(F.col("n") >= least)
    text = F.concat(F.lit("# "), F.col("hub"), F.lit("\n\n"), F.array_join(F.transform("links", lambda x: F.concat(F.lit("- "), X.wikilink(x["name"], x["title"]))), "\n"), F.lit("\n"))
    return rows.select("hub", "n", text.alias("text")).orderBy(F.desc("n"), F.lower("hub"), "hub")


def write_vault(notes: DataFrame, folder: str, overwrite: bool = False, ending: str = ".md") -> DataFrame:
    """Writes (name, text) as name.md (or another ending) into a folder all machines share; (name, status): ok, same, skip, failed. Of names that collide, the first by text is written.

    A file is written beside its place and then moved, so that a task that is lost and runs again does no harm.
    """
    first = notes.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("text")))

    def put(batches):
        import os
        import uuid

        import pyarrow as pa

        for batch in batches:
            said = []
            for name, text, nth in zip(*(batch.column(c).to_pylist() for c in ("name", "text", "nth")), strict=True):
                path = os.path.join(folder, f"{name}{ending}")
                try:
                    old = None
                    if os.path.exists(path):
                        with open(path, encoding="utf-8", newline="") as f:
                            old = f.read()
                    if nth > 1 or old is not None and old != text and not overwrite:
                        said.append("skip")
                    elif old == text:
                        said.append("same")
                    else:
                        os.makedirs(folder, exist_ok=True)
                        with open(part := f"{path}.{uuid.uuid4().hex}", "w", encoding="utf-8", newline="") as f:
                            f.write(text or "")
                        os.replace(part, path)
                        said.append("ok")
                except (OSError, ValueError):
                    said.append("failed")
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(said)], names=["name", "status"])

    return first.select("name", "text", "nth").mapInArrow(put, "name string, status string")
