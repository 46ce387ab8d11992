"""Notes of a vault: Markdown files with front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumaria.functions.text import without_relations

# Pages that are no notes.
INDEXES = ("Índice", "Indice", "Mapa de Temas")
FENCE = r"(?s)\A---[ \t]*\n(.*?\n)?---[ \t]*(?:\n|\z)"


def _scalar(c: Column) -> Column:
    c = F.trim(c)
    quoted = c.rlike(r'^".*"$')
    inner = F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), r"\\(.)", "$1")
    return F.when(quoted, inner).otherwise(F.regexp_replace(c, "^'|'$", ""))


def front_matter(text: Column) -> Column:
    """map<key, array<string>>: scalars as one entry, lists as theirs; empty without a closed fence. In the JVM, for flat keys."""
    head = F.regexp_extract(text, FENCE, 1)
    field = r"(?m)^([^\s:#-][^:\n]*):[ \t]*([^\n]*(?:\n[ \t]*- [^\n]*)*)"
    keys, values = F.regexp_extract_all(head, F.lit(field), F.lit(1)), F.regexp_extract_all(head, F.lit(field), F.lit(2))

    def value(v):
        items = F.transform(F.filter(F.split(v, r"\n[ \t]*- "), lambda x: F.trim(x) != ""), _scalar)
        inline = F.transform(F.split(F.regexp_replace(F.trim(v), r"^\[|\]$", ""), r",\s*"), _scalar)
        return F.when(F.trim(v).rlike(r"^\[\s*\]$"), F.array().cast("array<string>")).when(F.trim(v).rlike(r"^\[.*\]$"), inline).otherwise(items)

    entries = F.zip_with(keys, F.transform(values, value), lambda k, v: F.struct(F.trim(k).alias("key"), v.alias("value")))
    # The last of repeated keys counts.
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def body(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, FENCE, ""), r"\A\n+", "")


def is_note(name: Column) -> Column:
    return ~(name.isin(*INDEXES) | name.startswith("Tema - ") | name.startswith("Mapa - ") | name.startswith("_"))


def read_notes(spark: SparkSession, folder: str, whole: bool = False, every: bool = False) -> DataFrame:
    """(name, title, meta, body) of the folder's notes, or (name, text); indexes and hubs are left out, unless `every` file is asked for."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    name = F.regexp_extract(F.url_decode(F.replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.lit("+"), F.lit("%2B"))), r"^(.*)\.md$", 1)
    rows = files.select(name.alias("name"), F.col("value").alias("text"))
    rows = rows if every else rows.where(is_note(F.col("name")))
    if whole:
        return rows
    meta = front_matter(F.col("text"))
    return rows.select("name", F.coalesce(F.get(F.try_element_at(meta, F.lit("title")), F.lit(0)), F.col("name")).alias("title"), meta.alias("meta"), without_relations(body(F.col("text"))).alias("body"))
