"""Office files, notes, Markdown and the watched folder."""

import os
import time

from pyspark.sql import functions as F

from tests_support import docx, xlsx

from plumaria.sinks import markdown as M
from plumaria.sources import notes as N
from plumaria.sources import office as O

def test_office_documents(spark):
    files = spark.createDataFrame([("a.docx", docx()), ("b.XLSX", xlsx()), ("c.doc", b""), ("d.docx", b"no zip"), ("e.pdf", b"")], "path string, content binary")
    rows = {r["source"]: r for r in O.office_documents(files).collect()}
    assert [rows[n]["status"] for n in sorted(rows)] == ["ok", "ok", "failed", "failed", "failed"]
    kinds = [(b["type"], b["text"], b["items"]) for b in rows["a.docx"]["blocks"]]
    assert kinds == [("heading", "Acta", None), ("list", None, ["uno", "dos"]), ("list", None, ["tres"]), ("table", None, None), ("paragraph", "fin", None)]
    assert rows["b.XLSX"]["blocks"][0]["rows"] == [["x", "", "2"], ["Sí", "0.123457", ""]]


def test_document_text_and_front_matter_round_trip(spark):
    docs = O.office_documents(spark.createDataFrame([("a.docx", docx())], "path string, content binary"))
    docs = docs.withColumns({"title": F.lit('di "x" \\ y'), "tags": F.array(F.lit("uno"), F.lit("d: os")), "none": F.array().cast("array<string>"), "ocr": F.lit(True)})
    text = docs.select(M.document(M.front_matter(docs, ["title", "tags", "none", "ocr"]), F.col("blocks")).alias("text"))
    row = text.select("text", N.front_matter(F.col("text")).alias("meta"), N.body(F.col("text")).alias("body")).first()
    assert row["body"] == "<!-- página 1 -->\n# Acta\n\n- uno\n- dos\n\n1. tres\n\n| a\\|b | c |\n| --- | --- |\n| 1 |  |\n\nfin\n"
    assert row["meta"] == {"title": ['di "x" \\ y'], "tags": ["uno", "d: os"], "none": [], "ocr": ["true"]}


def test_unclosed_front_matter_is_body(spark):
    row = spark.createDataFrame([("---\na: b\nc",)], "t string").select(N.front_matter(F.col("t")).alias("m"), N.body(F.col("t")).alias("b")).first()
    assert row["m"] == {} and row["b"] == "---\na: b\nc"


def test_vault(spark, tmp_path):
    notes = spark.createDataFrame([("nota uno", "---\ntitle: \"T\"\n---\n\ncuerpo\n"), ("nota uno", "zzz"), ("Índice", "x")], "name string, text string")
    status = lambda **how: sorted(tuple(r) for r in M.write_vault(notes, str(tmp_path), **how).collect())
    assert status() == [("nota uno", "ok"), ("nota uno", "skip"), ("Índice", "ok")]
    assert status() == [("nota uno", "same"), ("nota uno", "skip"), ("Índice", "same")]
    assert [(r["name"], r["title"], r["body"]) for r in N.read_notes(spark, str(tmp_path)).collect()] == [("nota uno", "T", "cuerpo\n")]


def test_related_section_replaces_itself(spark):
    rel = F.array(F.struct(F.lit("b").alias("name"), F.lit("B").alias("title"), F.lit(0.525).alias("confidence"), F.array(F.lit("tema")).alias("reasons")))
    once = M.related_section(F.lit("cuerpo\n"), rel)
    row = spark.range(1).select(once.alias("one"), M.related_section(once, rel).alias("two"), M.own_tags(F.array(F.lit("a"), F.lit("tema/x")), F.array(F.lit("tema/y"))).alias("tags")).first()
    assert row["one"] == row["two"] and "- [[b|B]] — **52%** · tema" in row["one"] and row["tags"] == ["a", "tema/y"]


def test_themes_hubs_and_index(spark):
    hits = spark.createDataFrame([(1, "hijo", 3), (1, "padre", 2), (2, "hijo", 1)], "doc_id long, cid string, hits long")
    closure = spark.createDataFrame([("hijo", "hijo", 0), ("hijo", "padre", 1), ("padre", "padre", 0)], "cid string, ancestor string, k int")
    assert [tuple(r) for r in M.theme_tags(hits, closure).collect()] == [(1, ["tema/padre", "tema/padre/hijo"])]
    members = spark.createDataFrame([("A", "n2", "b"), ("A", "n1", "B"), ("B", "n3", "c")], "hub string, name string, title string")
    assert [r["text"] for r in M.hubs(members, 2).collect()] == ["# A\n\n- [[n1|B]]\n- [[n2|b]]\n"]
    notes = spark.createDataFrame([("n", "T", 3, True, 92.4, None), ("m", "m", None, None, None, None)], "name string, title string, pages int, ocr boolean, ocr_confidence double, date_processed string")
    assert [r["line"] for r in M.index_lines(notes).collect()] == ["- [[m]]", "- [[n|T]] — 3 pág. · OCR 92.4%"]


def test_watched_folder(spark, tmp_path):
    from plumaria.streaming.watch import StableReader, watch

    folder = {n: str(tmp_path / n) for n in ("in", "notes", "done", "bad", "state")}
    os.makedirs(folder["in"])
    reader = StableReader(folder["in"])
    (tmp_path / "in" / "a.docx").write_bytes(docx())
    (tmp_path / "in" / "b.docx").write_bytes(b"broken")
    (tmp_path / "in" / "~$a.docx").write_bytes(b"lock")
    first, one = reader.read(reader.initialOffset())
    second, two = reader.read(one)
    assert list(first) == [] and [n for n, _ in second] == ["a.docx", "b.docx"] == [n for n, _ in reader.readBetweenOffsets(one, two)]
    query = watch(spark, folder["in"], folder["notes"], folder["done"], folder["bad"], folder["state"], every="1 second")
    try:
        end = time.time() + 60
        while time.time() < end and not (os.path.exists(f"{folder['done']}/a.docx") and os.path.exists(f"{folder['bad']}/b.docx")):
            assert query.exception() is None
            time.sleep(0.5)
    finally:
        query.stop()
    assert os.listdir(folder["notes"]) == ["a.md"] and os.listdir(folder["done"]) == ["a.docx"] and sorted(os.listdir(folder["bad"])) == ["b.docx", "documentos_con_problemas"]
