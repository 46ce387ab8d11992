"""A lexicon of concepts and events (the user's knowledge of a domain) as small tables.

The YAML form has `conceptos` (id: label, padre or parent, terminos) and `eventos` (id: terminos). Terms go through the tokens and stems of the notes, so both sides agree.
What a lexicon has is written by hand and held by the driver while it is read; its tables are broadcast only under `BROADCAST_ROWS`.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumaria.functions import text as X
from plumaria.operators import relate as R

BROADCAST_ROWS = 200_000
NO_FILE = "nofile"


@dataclass
class Lexicon:
    """concepts (cid, label, parent), terms (cid, n, term), event_terms (event, ord, n, term), closure (cid, ancestor, k), and a signature of the text."""

    concepts: DataFrame
    terms: DataFrame
    event_terms: DataFrame
    closure: DataFrame
    signature: str
    longest: int


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has few enough rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _terms(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows with `term` as stems with blanks between, and n, how many; terms of stopwords alone go."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("stems", F.transform(X.stems(F.col("term")), lambda s: s["stem"])).where(F.size("stems") > 0).withColumns({"n": F.size("stems"), "term": F.array_join("stems", " ")}).drop("stems").distinct()


def parsed(spark: SparkSession, data: dict, signature: str) -> Lexicon:
    """A lexicon of what the YAML file says."""
    concepts, terms, events = [], [], []
    for cid, spec in (data.get("conceptos") or {}).items():
        spec = spec or {}
        concepts.append((str(cid), str(spec.get("label", cid)), spec.get("padre") or spec.get("parent")))
        terms += [(str(cid), str(t)) for t in spec.get("terminos") or []]
    for i, (eid, spec) in enumerate((data.get("eventos") or {}).items()):
        events += [(str(eid), i, str(t)) for t in (spec or {}).get("terminos") or []]
    known = spark.createDataFrame(concepts, "cid string, label string, parent string")
    own, of_events = _terms(spark, terms, "cid string, term string"), _terms(spark, events, "event string, ord int, term string")
    longest = max(own.agg(F.max("n")).first()[0] or 1, of_events.agg(F.max("n")).first()[0] or 1)
    n = len(terms) + len(concepts)
    # Events match by words and pairs of words; longer terms are loaded and never matched.
    return Lexicon(known, small(own, n), small(of_events.where("n <= 2"), len(events)), small(R.ancestors(known.select("cid", "parent")), 32 * len(concepts)), signature, longest)


def load(spark: SparkSession, path: str | None) -> Lexicon:
    """The lexicon of a YAML file; without a file, or without a YAML reader, an empty one."""
    try:
        import yaml
    except ImportError:
        yaml = None
    if yaml is None or not path or not os.path.exists(path):
        return parsed(spark, {}, NO_FILE)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return parsed(spark, yaml.safe_load(text) or {}, hashlib.sha1(text.encode()).hexdigest()[:12])


def labels(lexicon: Lexicon, rows: DataFrame) -> DataFrame:
    """rows (…, cid) with label: the concept's, or the id where the lexicon does not have it."""
    return rows.join(lexicon.concepts.select("cid", "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
