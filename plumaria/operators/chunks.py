"""Chunks of Markdown for retrieval: one for each section, long ones packed by paragraph. Within the row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumaria.functions.text import PAGE_MARK, stripped

HEADING = r"^(#{1,6})\s+(.*)$"


def packed(text, longest: int):
    """Pieces of a text: paragraphs in order until the next would pass `longest`; one that is longer stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("now"))

    def add(s, para):
        full = (s["now"] != "") & (F.length(s["now"]) + F.length(para) > longest)
        return F.struct(F.when(full, F.array_append(s["parts"], stripped(s["now"]))).otherwise(s["parts"]).alias("parts"), F.concat(F.when(full, "").otherwise(s["now"]), para, F.lit("\n\n")).alias("now"))

    def end(s):
        return F.when(stripped(s["now"]) == "", s["parts"]).otherwise(F.array_append(s["parts"], stripped(s["now"])))

    return F.when(F.length(text) <= longest, F.array(text)).otherwise(F.aggregate(F.split(text, "\n\n"), start, add, end))


def chunks(notes: DataFrame, longest: int = 1500) -> DataFrame:
    """(doc_id, seq, text, heading_path, page) of (doc_id, text). A page marker's line goes; a chunk has the page at its section's end."""
    body = F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", "")
    lines = F.transform(
        F.split(body, r"\R"),
        lambda x, at: F.struct(
            at.alias("at"), x.alias("line"), F.regexp_extract(x, PAGE_MARK, 1).try_cast("int").alias("page"),
            F.when(F.regexp_extract(x, PAGE_MARK, 1) == "", F.length(F.regexp_extract(x, HEADING, 1))).otherwise(0).alias("level"),
        ),
    )
    rows = notes.select("doc_id", lines.alias("lines"))
    rows = rows.select("doc_id", "lines", F.filter("lines", lambda x: x["level"] > 0).alias("heads"), F.filter("lines", lambda x: x["page"].isNotNull()).alias("pages"))
    # Section k follows heading k; section 0 is what stands before the first.
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("heads"))).alias("k"))
    first = F.when(F.col("k") == 0, 0).otherwise(F.get("heads", F.col("k") - 1)["at"] + 1)
    after = F.coalesce(F.get("heads", F.col("k"))["at"], F.size("lines"))
    rows = rows.withColumns({"first": first, "after": after})
    own = F.filter(F.slice("lines", F.col("first") + 1, F.col("after") - F.col("first")), lambda x: x["page"].isNull())
    above = F.slice("heads", 1, F.col("k"))
    path = F.filter(above, lambda h: ~F.exists(above, lambda other: (other["at"] > h["at"]) & (other["level"] <= h["level"])))
    page = F.filter("pages", lambda p: p["at"] < F.col("after"))
    rows = rows.select(
        "doc_id", "k", stripped(F.array_join(F.transform(own, lambda x: x["line"]), "\n")).alias("body"),
        F.transform(path, lambda h: F.trim(F.regexp_extract(h["line"], HEADING, 2))).alias("heading_path"), F.get(page, F.size(page) - 1)["page"].alias("page"),
    ).where("body <> ''")
    pieces = rows.select("doc_id", "k", "heading_path", "page", F.posexplode(packed(F.col("body"), longest)).alias("piece", "text"))
    return pieces.select("doc_id", F.struct("k", "piece").alias("seq"), "text", "heading_path", "page")
