"""Publishing, organising and describing notes of a vault, as DataFrames; `markdown.write_vault` puts them into files.

Front matter travels as `entries`, an array of (key, list, shown, plain) in the order of the file: `shown` are the values as YAML, `plain` as text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumaria.functions import text as X
from plumaria.sinks import markdown as M
from plumaria.sources.notes import FENCE, front_matter

# Names of pages, the order of front matter, and what the pages say.
INDEX, MAP, HUB, THEMES, THEME = "Índice", "Mapa — ", "Mapa - ", "Mapa de Temas", "Tema - "
ORDER = ("title", "source", "file_type", "pages", "words", "ocr", "ocr_pages", "ocr_confidence", "language", "author", "date_processed", "aliases", "tags", "keywords", "conceptos", "entidades", "related")
ENTRIES = "array<struct<key:string,list:boolean,shown:array<string>,plain:array<string>>>"
NO_RELATION = "- (sin relaciones sobre el umbral)"


def quoted(text: Column) -> Column:
    return M.yaml_scalar(text, "string")


def _as_entries(block: str) -> list[dict]:
    """Entries of a YAML block, by the YAML reader; none if it is no mapping."""
    import yaml

    try:
        data = yaml.safe_load(block)
    except yaml.YAMLError:
        return []

    def shown(v) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return str(v)
        return '"' + ("" if v is None else str(v)).replace("\\", "\\\\").replace('"', '\\"') + '"'

    values = lambda v: v if isinstance(v, list) else [v]
    plain = lambda v: "" if v is None else str(v)
    return [{"key": str(k), "list": isinstance(v, list), "shown": [shown(x) for x in values(v)], "plain": [plain(x) for x in values(v)]} for k, v in data.items()] if isinstance(data, dict) else []


def with_entries(notes: DataFrame) -> DataFrame:
    """notes (…, text) with entries. By the YAML reader, in Arrow batches, where it is installed; else flat keys by patterns in the JVM."""
    try:
        import yaml  # noqa: F401
    except ImportError:
        meta = front_matter(F.col("text"))
        each = F.transform(F.map_entries(meta), lambda e: F.struct(e["key"].alias("key"), (F.size(e["value"]) != 1).alias("list"), F.transform(e["value"], quoted).alias("shown"), e["value"].alias("plain")))
        return notes.withColumn("entries", each.cast(ENTRIES))
    import re

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    names, kind, fence = notes.columns, to_arrow_type(_parse_datatype_string(ENTRIES)), re.compile(FENCE.replace(r"\z", r"\Z"))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            found = [_as_entries(m[1] or "") if (m := fence.match(t or "")) else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*names, "entries"])

    return notes.mapInArrow(read, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in notes.schema.fields) + f", entries {ENTRIES}")


def _of(entries: Column, key: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))


def value(entries: Column, key: str) -> Column:
    """The first value of a key as text, or null; an empty one counts as none."""
    return F.nullif(F.get(_of(entries, key)["plain"], F.lit(0)), F.lit(""))


def values(entries: Column, key: str) -> Column:
    """All values of a key that are not empty, as texts."""
    return F.filter(F.coalesce(_of(entries, key)["plain"], F.array().cast("array<string>")), lambda v: v != "")


def put(entries: Column, new: dict[str, Column]) -> Column:
    """entries (a column, as it is named several times) with lists of texts under keys: each at its key's place, or at the end."""
    made = {k: F.struct(F.lit(k).alias("key"), F.lit(True).alias("list"), F.transform(v, quoted).alias("shown"), v.alias("plain")) for k, v in new.items()}

    def replaced(e):
        out = e
        for k, v in made.items():
            out = F.when(e["key"] == k, v).otherwise(out)
        return out

    return F.concat(F.transform(entries, replaced), F.filter(F.array(*made.values()), lambda n: ~F.exists(entries, lambda e: e["key"] == n["key"])))


def filled(entries: Column) -> Column:
    """entries without lists that have no value, but for tags."""
    return F.filter(entries, lambda e: ~e["list"] | (F.size(e["plain"]) > 0) | (e["key"] == "tags"))


def ordered(entries: Column) -> Column:
    """The known keys in their order, then the others as they came."""
    known = F.lit(list(ORDER))
    place = lambda e, i: F.struct(F.coalesce(F.nullif(F.array_position(known, e["key"]), F.lit(0)), F.lit(1000) + i).cast("long").alias("place"), e.alias("e"))
    return F.transform(F.array_sort(F.transform(entries, place)), lambda x: x["e"])


def rendered(entries: Column) -> Column:
    """entries as a front matter block."""
    listed = lambda e: F.when(F.size(e["shown"]) > 0, F.concat(F.lit(":"), F.array_join(F.transform(e["shown"], lambda v: F.concat(F.lit("\n  - "), v)), ""))).otherwise(": []")
    line = lambda e: F.concat(e["key"], F.when(e["list"], listed(e)).otherwise(F.concat(F.lit(": "), F.get(e["shown"], F.lit(0)))))
    return F.concat_ws("\n", F.lit("---"), F.nullif(F.array_join(F.transform(entries, line), "\n"), F.lit("")), F.lit("---"))


def enriched(entries: Column, tags: list[str]) -> Column:
    """The title among the aliases, first if it was not there, and further tags, each once. Nothing else changes."""
    title = value(entries, "title")
    aliases = values(entries, "aliases")
    named = F.when(F.array_contains(aliases, title), aliases).otherwise(F.concat(F.array(title), aliases))
    clean = F.filter(F.lit(list(tags)).cast("array<string>"), lambda t: X.clean_tag(t) != "")
    new, old = F.array_distinct(F.transform(clean, X.clean_tag)), values(entries, "tags")
    tagged = F.concat(old, F.filter(new, lambda t: ~F.array_contains(old, t)))
    return F.when(title.isNotNull(), put(entries, {"aliases": named, "tags": tagged})).otherwise(put(entries, {"tags": tagged}))


def restamped(entries: Column, prefix: str, tag: Column) -> Column:
    """tags with those of a namespace replaced by one."""
    kept = F.filter(values(entries, "tags"), lambda t: ~t.startswith(prefix))
    return put(entries, {"tags": F.concat(kept, F.array(F.concat(F.lit(prefix), tag)))})


def with_body(head: Column, body: Column) -> Column:
    text = F.concat(head, F.lit("\n\n"), body)
    return F.when(F.right(text, F.lit(1)) == "\n", text).otherwise(F.concat(text, F.lit("\n")))


def unpublished(notes: DataFrame, there: DataFrame, key: str = "name") -> DataFrame:
    """notes with status: skip where the vault has the name already, else ok."""
    seen = there.select(F.col(key).alias("seen")).distinct()
    return notes.join(seen, notes[key] == seen["seen"], "left").withColumn("status", F.when(F.col("seen").isNotNull(), "skip").otherwise("ok")).drop("seen")


def published(files: DataFrame, there: DataFrame | None = None, tags: tuple[str, ...] = ("pdf-importado",), overwrite: bool = False) -> DataFrame:
    """(name, title, source, status, entries, text) of files (name without its ending, text): note names, enriched front matter, and skip where the vault has the note.

    Files without front matter that can be read are taken as they are; index pages and names with `_` in front are left out. Of names that collide the first by source is ok, the others skip.
    """
    rows = with_entries(files.where(~F.col("name").startswith("_") & (F.col("name") != INDEX)).withColumnRenamed("name", "stem"))
    body = F.regexp_replace(F.regexp_replace("text", FENCE, ""), r"\A\n+", "")
    text = F.when(F.size("entries") > 0, with_body(rendered(enriched(F.col("entries"), list(tags))), body)).otherwise(F.col("text"))
    rows = rows.select(X.file_slug(F.col("stem")).alias("name"), F.coalesce(value(F.col("entries"), "title"), "stem").alias("title"), F.concat("stem", F.lit(".md")).alias("source"), "entries", text.alias("text"))
    rows = unpublished(rows, there) if there is not None and not overwrite else rows.withColumn("status", F.lit("ok"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("source"))
    return rows.withColumn("status", F.when(nth > 1, "skip").otherwise(F.col("status"))).select("name", "title", "source", "status", "entries", "text")


def summary(rows: DataFrame) -> DataFrame:
    """(status, n): how many of each status."""
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def index_records(notes: DataFrame) -> DataFrame:
    """(note, title, source, pages, ocr, language, date_processed, json): a record for each note that is ok or skipped; json as the index file has it, absent values as null."""
    e = F.col("entries")
    raw = lambda k: F.get(_of(e, k)["shown"], F.lit(0))
    rows = notes.where(F.col("status").isin("ok", "skip")).select("name", F.col("name").alias("note"), "title", "source", value(e, "pages").try_cast("int").alias("pages"), (raw("ocr") == "true").alias("ocr"), value(e, "language").alias("language"), value(e, "date_processed").alias("date_processed"))
    record = F.to_json(F.struct("note", "title", "source", "pages", "ocr", "language", "date_processed"), {"ignoreNullFields": "false"})
    return rows.withColumn("json", record).drop("name")


def index_entries(notes: DataFrame) -> DataFrame:
    """What `markdown.index_lines` takes, of published notes."""
    e = F.col("entries")
    return notes.where(F.col("status").isin("ok", "skip")).select("name", "title", value(e, "pages").try_cast("int").alias("pages"), (value(e, "ocr").isin("True", "true")).alias("ocr"), value(e, "ocr_confidence").try_cast("double").alias("ocr_confidence"), value(e, "date_processed").alias("date_processed"))


def page(title: str, tags: list[str], heading: str, note: str) -> str:
    """The head of an index or hub page."""
    q = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return "\n".join(["---", f"title: {q(title)}", "tags:", *(f"  - {q(t)}" for t in tags), "---", "", f"# {heading}", "", f"> {note}", ""]) + "\n"


def write_page(spark: SparkSession, path: str, head: str, lines: DataFrame, column: str = "line") -> None:
    """A page of many lines: the sorted lines stream through the driver a partition at a time and are never all in its memory. Written beside its place, then moved."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8", newline="") as f:
        f.write(head)
        for row in lines.select(column).toLocalIterator():
            f.write(row[0] + "\n")
    os.replace(part, path)


def write_jsonl(records: DataFrame, path: str) -> None:
    """One record a line, by note."""
    write_page(records.sparkSession, path, "", records.orderBy("note"), "json")


def organised(notes: DataFrame) -> DataFrame:
    """(name, title, grupo, entries, text) of notes (name, text): each under the format it came from, with its tag origen/<group> replaced."""
    rows = with_entries(notes)
    e = F.col("entries")
    rows = rows.withColumn("grupo", X.origin(F.coalesce(value(e, "file_type"), F.lit("")), F.coalesce(value(e, "source"), F.lit("")))).withColumn("title", F.coalesce(value(e, "title"), "name"))
    body = F.regexp_replace(F.regexp_replace("text", FENCE, ""), r"\A\n+", "")
    stamped = restamped(e, "origen/", X.tag_slug(F.col("grupo"), "general"))
    text = F.when(F.size("entries") > 0, with_body(rendered(stamped), body)).otherwise(F.col("text"))
    return rows.select("name", "title", "grupo", F.when(F.size("entries") > 0, stamped).otherwise(e).alias("entries"), text.alias("text"))


def groups(notes: DataFrame) -> DataFrame:
    """(grupo, n) by falling number, then name in lower case."""
    return notes.groupBy("grupo").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.lower("grupo"), "grupo")


def write_hubs(members: DataFrame, folder: str, prefix: str, head: Callable[[str, int], tuple[str, str]], least: int = 1) -> list[tuple[str, str, int]]:
    """A page for each hub of members (hub, name, title) with `least` notes, links by title; pages of hubs that are no more are deleted. head(hub, n): (page name, head). Returns (page name, hub, n).

    The hubs (formats, themes of a lexicon) are few by their nature; their links are streamed, so no hub is ever held whole.
    """
    spark = members.sparkSession
    made, kept = [], set()
    for r in members.groupBy("hub").agg(F.countDistinct("name", "title").alias("n")).where(F.col("n") >= least).orderBy("hub").collect():
        name, text = head(r["hub"], r["n"])
        links = members.where(F.col("hub") == r["hub"]).select("name", "title").distinct().orderBy(F.lower("title"), "name").select(F.concat(F.lit("- "), X.wikilink(F.col("name"), F.col("title"))).alias("line"))
        write_page(spark, os.path.join(folder, f"{name}.md"), text, links)
        made.append((name, r["hub"], r["n"]))
        kept.add(f"{name}.md")
    for file in os.listdir(folder):
        if file.startswith(prefix) and file.endswith(".md") and file not in kept:
            os.remove(os.path.join(folder, file))
    return made


def write_hub_index(made: list[tuple[str, str, int]], path: str, head: str) -> None:
    """The page of hub pages: most notes first, then by name."""
    lines = [f"- [[{name}|{label}]] ({n})\n" for name, label, n in sorted(made, key=lambda x: (-x[2], x[1].lower()))]
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.writelines([head, *lines])


def warnings_text(documents: DataFrame) -> DataFrame:
    """(name, text) of documents (name, source, warnings, pages array<struct<page, warnings>>) that have any."""
    whole = F.transform("warnings", lambda w: F.concat(F.lit("  - "), w))
    paged = F.flatten(F.transform("pages", lambda p: F.transform(p["warnings"], lambda w: F.concat(F.lit("  - [pág. "), p["page"].cast("string"), F.lit("] "), w))))
    lines = F.concat(F.coalesce(whole, F.array().cast("array<string>")), F.coalesce(paged, F.array().cast("array<string>")))
    return documents.withColumn("lines", lines).where(F.size("lines") > 0).select(F.concat("name", F.lit("_avisos")).alias("name"), F.concat(F.lit("Avisos para "), "source", F.lit(":\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("text"))


def append_failures(documents: DataFrame, path: str) -> int:
    """Appends (at, source, error) of failed documents to the table of failures; returns how many. Never overwrites what earlier runs said."""
    rows = documents.where("status = 'failed'").select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("at"), "source", "error")
    rows.write.mode("append").parquet(path)
    return documents.where("status = 'failed'").count()


def convert(documents: DataFrame, folder: str, errors: str, overwrite: bool = False, on_event: Callable[[str, str, str], None] | None = None) -> dict[str, int]:
    """Writes documents (as `layout.office_metadata` has them) as notes, warnings as files, failures as a table; counts by status. on_event(status, name, detail) hears of each document, streamed."""
    names = ["title", "source", "file_type", "ocr", "language", "date_processed", "author", "words", "sheets", "tags"]
    good = documents.where("status = 'ok'")
    head = M.front_matter(good, names)
    notes = good.select("name", M.document(M.compact(head, names), F.col("blocks")).alias("text"))
    done = M.write_vault(notes, folder, overwrite).persist()
    M.write_vault(warnings_text(good.select("name", "source", "warnings", F.lit(None).cast("array<struct<page:int,warnings:array<string>>>").alias("pages"))).selectExpr("name", "text"), errors, True, ".txt").write.format("noop").mode("overwrite").save()
    append_failures(documents, os.path.join(errors, "documentos_con_problemas"))
    counts = {r["status"]: r["n"] for r in summary(done).collect()} | {"failed": documents.where("status = 'failed'").count()}
    if on_event:
        for r in done.toLocalIterator():
            on_event(r["status"], r["name"], "")
        for r in documents.where("status = 'failed'").select("source", "error").toLocalIterator():
            on_event("error", r["source"], r["error"])
    done.unpersist()
    return counts


def read_jsonl(spark: SparkSession, path: str) -> list[dict]:
    """The records of an index file."""
    with open(path, encoding="utf-8") as f:
        return [json.loads(line) for line in f]
