"""The vault end to end: publishing, organising, relating, and that a second run writes nothing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from plumaria.config import Config
from plumaria.functions import text as X
from plumaria.operators import confidence as C
from plumaria.operators import profiles as P
from plumaria.plans import vault as W
from plumaria.sinks import vault as V
from plumaria.sources import lexicon as L

yaml = pytest.importorskip("yaml")

LEXICON = """
conceptos:
  energia:
    label: "Energía"
    terminos: [energia, energetico, generacion electrica, matriz energetica]
  bombeo:
    label: "Bombeo"
    padre: energia
    terminos: [hidrobombeo, central reversible]
  personal:
    label: "Personal"
    terminos: [vacaciones, recursos humanos, nomina]
eventos:
  reunion:
    terminos: [reunion, minuta, convocatoria]
  informe:
    terminos: [informe, informe de avance]
"""
NOTES = {
    "2026-08-03-Reunion": ("Reunión sobre la matriz energética", "Minuta de la reunión sobre la matriz energética y la generación eléctrica. Convocatoria próxima."),
    "2026-08-01-Proyecto": ("Proyecto de hidrobombeo", "Proyecto de hidrobombeo de la EGEHID con embalse superior y turbinas reversibles."),
    "2026-08-10-Informe": ("Informe de avance del proyecto", "Informe de avance del proyecto de hidrobombeo de EGEHID. La central reversible avanza."),
    "2026-08-09-Vacaciones": ("Solicitud de vacaciones", "Solicitud de vacaciones a recursos humanos; actualizar la nómina."),
}


@pytest.fixture
def lexicon(spark, tmp_path):
    path = tmp_path / "lexicon.yaml"
    path.write_text(LEXICON, encoding="utf-8")
    return L.load(spark, str(path))


@pytest.fixture
def vault(tmp_path):
    folder = tmp_path / "vault"
    folder.mkdir()
    for name, (title, body) in NOTES.items():
        (folder / f"{name}.md").write_text(f'---\ntitle: "{title}"\nsource: "{name}.pdf"\nfile_type: "pdf"\npages: 2\ntags:\n  - "a b"\n  - "tema/viejo"\n---\n\n<!-- página 1 -->\n{body}\n', encoding="utf-8")
    return folder


def read(path):
    return path.read_text(encoding="utf-8")


def test_lexicon(spark, lexicon, tmp_path):
    terms = {(r.cid, r.n, r.term) for r in lexicon.terms.collect()}
    assert ("energia", 2, "gener electrica") in terms and ("personal", 1, "vac") in terms and lexicon.longest == 2
    assert {(r.event, r.ord, r.term) for r in lexicon.event_terms.collect()} == {("reunion", 0, "reunion"), ("reunion", 0, "minuta"), ("reunion", 0, "convocatoria"), ("informe", 1, "informe"), ("informe", 1, "informe avance")}
    assert {(r.cid, r.ancestor, r.k) for r in lexicon.closure.collect()} >= {("bombeo", "energia", 1), ("bombeo", "bombeo", 0)}
    assert [r.label for r in L.labels(lexicon, spark.createDataFrame([("energia",), ("otro",)], "cid string")).orderBy("cid").collect()] == ["Energía", "otro"]
    none = L.load(spark, str(tmp_path / "nothing.yaml"))
    assert none.signature == "nofile" and none.terms.count() == 0 and none.concepts.count() == 0


def test_relate_vault(spark, lexicon, vault):
    first = W.relate_vault(spark, str(vault), lexicon)
    assert first["total"] == 4 and first["reused"] == 0 and first["written"] == 4 and first["temas"] >= 1
    run = W.relate(W.read_notes(spark, str(vault)), lexicon, settings=W.Settings(threshold=0.15))
    pairs = {(r.a, r.b): (r.confidence, list(r.reasons)) for r in run.relations.collect()}
    assert not any("2026-08-09-Vacaciones" in p for p in pairs)
    assert ("2026-08-01-Proyecto", "2026-08-03-Reunion") in pairs  # by the parent concept: 0.34 * 2 / sqrt(20) and two days apart
    assert pairs["2026-08-01-Proyecto", "2026-08-03-Reunion"][0] == pytest.approx(0.34 * 2 / 20**0.5 + 0.05 * (1 - 2 / 21))
    strong = pairs["2026-08-01-Proyecto", "2026-08-10-Informe"]
    assert strong[0] == max(c for c, _ in pairs.values()) and strong[1][:3] == ["tema", "entidad", "texto"] and "fecha" in strong[1]
    project, control = read(vault / "2026-08-01-Proyecto.md"), read(vault / "2026-08-09-Vacaciones.md")
    assert "## 🔗 Notas relacionadas" in project and "Notas relacionadas" not in control and "related" not in control
    meta = yaml.safe_load(project.split("---")[1])
    assert meta["tags"][0] == "a b" and "tema/viejo" not in meta["tags"] and {"tema/energia", "tema/energia/bombeo", "entidad/egehid"} <= set(meta["tags"]) and meta["pages"] == 2
    assert "hidrobombeo" in meta["keywords"] and meta["entidades"] == ["EGEHID"] and "[[2026-08-10-Informe]]" in meta["related"] and "Bombeo" in meta["conceptos"]
    assert list(meta) == [k for k in V.ORDER if k in meta]
    themes = sorted(f for f in os.listdir(vault) if f.startswith("Tema - "))
    assert "Tema - Bombeo.md" in themes and "- [[2026-08-01-Proyecto|Proyecto de hidrobombeo]]" in read(vault / "Tema - Bombeo.md") and "[[Tema - Bombeo|Bombeo]] (2)" in read(vault / "Mapa de Temas.md")
    audit = read(vault / "_relaciones.md")
    assert "Umbral de confianza: **22%**" in audit and "## Solicitud de vacaciones" in audit and "(sin relaciones sobre el umbral)" in audit and "evento: informe" in audit
    second = W.relate_vault(spark, str(vault), lexicon)
    assert second["written"] == 0 and second["reused"] == 4 and second["links"] == first["links"]
    # A changed title is a changed profile; a theme that is no more loses its page.
    for n in ("2026-08-01-Proyecto", "2026-08-10-Informe"):
        (vault / f"{n}.md").write_text(f'---\ntitle: "Otro"\n---\n\nnada que decir de {n[-8:]}\n', encoding="utf-8")
    third = W.relate_vault(spark, str(vault), lexicon)
    assert third["reused"] == 2 and not (vault / "Tema - Bombeo.md").exists()
    assert P.load(spark, str(vault / "_semantica")).count() == 4


def test_profiles_need_the_same_lexicon(spark, lexicon, vault):
    notes = W.read_notes(spark, str(vault))
    cached = P.profiles(notes, lexicon)
    assert P.refreshed(notes, cached, lexicon)[1].count() == 4
    assert P.refreshed(notes, cached, L.parsed(spark, {}, "other"))[1].count() == 0
    row = cached.where("name = '2026-08-10-Informe'").first()
    assert row.event == "informe" and str(row.doc_date) == "2026-08-10" and row.tf["hidrobombeo"]["tf"] == 1 and row.tf["proyecto"]["tf"] == 4 and row.surface["avance"] == "avance" and row.hits["bombeo"] == 3


def test_an_embedder_that_fails_is_left_out(spark, lexicon, vault):
    def broken(rows):
        raise RuntimeError("no model")

    notes = W.read_notes(spark, str(vault))
    assert W.relate(notes, lexicon, embedder=broken).relations.count() == W.relate(notes, lexicon).relations.count()
    alike = W.relate(notes, lexicon, embedder=lambda rows: rows.select("doc_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding")))
    assert {(r.a, r.b) for r in alike.relations.collect()} >= {("2026-08-01-Proyecto", "2026-08-09-Vacaciones")} and alike.relations.count() == 6
    assert all("semántica" in r.reasons for r in alike.relations.collect()) and W.strongest(alike, 2).count() == 2


def test_confidence_with_embeddings_loses_no_pair(spark):
    import math
    import random

    rng = random.Random(11)
    words = {d: {rng.randrange(40): rng.random() for _ in range(3)} for d in range(40)}
    unit = lambda v: {k: x / math.sqrt(sum(y * y for y in v.values())) for k, x in v.items()}
    words = {d: unit(v) for d, v in words.items()}
    vectors = {d: list(unit(dict(enumerate(rng.gauss(0, 1) for _ in range(3)))).values()) for d in range(40) if d % 7}
    df = {k: sum(k in v for v in words.values()) for k in range(40)}
    text = spark.createDataFrame([(d, k, x, df[k]) for d, v in words.items() for k, x in v.items()], "doc_id long, key long, w double, df long")
    info = spark.createDataFrame([(d, None, None, vectors.get(d)) for d in range(40)], "doc_id long, event string, date date, embedding array<double>")
    got = {(r.a, r.b): round(r.confidence, 9) for r in C.pair_confidence(text, None, None, info).collect()}
    want = {}
    for a in range(40):
        for b in range(a + 1, 40):
            t = sum(x * words[b].get(k, 0) for k, x in words[a].items())
            both = a in vectors and b in vectors
            e = max(0.0, sum(x * y for x, y in zip(vectors[a], vectors[b], strict=True))) if both else 0.0
            v = 0.38 * t * 0.6 + 0.4 * e if both else 0.38 * t
            if v >= 0.22 and (t >= 0.08 or e >= 0.35):
                want[a, b] = round(v, 9)
    assert got == want and any(t not in {p for p in want if set(words[p[0]]) & set(words[p[1]])} for t in want)
    many = {(r.a, r.b) for r in C.dense_pairs(info.where("embedding is not null"), 0.9, rows=5).collect()}
    assert many == {(a, b) for a in vectors for b in vectors if a < b and sum(x * y for x, y in zip(vectors[a], vectors[b], strict=True)) >= 0.9}


def test_publish_and_organise(spark, tmp_path):
    source, folder = tmp_path / "md", tmp_path / "out"
    source.mkdir()
    (source / "uno?.md").write_text('---\ntitle: "Primero"\nfile_type: "docx"\npages: 3\nocr: true\nocr_confidence: 92.4\nlanguage: "es"\nextra:\n  a: 1\naliases: "Uno"\ntags: []\n---\n\ncuerpo\n', encoding="utf-8")
    (source / "dos.md").write_text("sin cabecera\n", encoding="utf-8")
    (source / "tres.md").write_text("---\n: [\n---\nroto", encoding="utf-8")
    (source / "_sistema.md").write_text("x", encoding="utf-8")
    heard = []
    assert W.publish_folder(spark, str(source), str(folder), ("#pdf importado",), on_event=lambda *x: heard.append(x)) == {"published": 3, "skipped": 0, "failed": 0, "total": 3}
    assert sorted(h[:2] for h in heard) == [("ok", "dos.md"), ("ok", "tres.md"), ("ok", "uno?.md")]
    one = read(folder / "uno.md")
    assert one.startswith('---\ntitle: "Primero"\nfile_type: "docx"\npages: 3\nocr: true\nocr_confidence: 92.4\nlanguage: "es"\nextra: "{\'a\': 1}"\naliases:\n  - "Primero"\n  - "Uno"\ntags:\n  - "pdf-importado"\n---\n\ncuerpo\n')
    assert read(folder / "dos.md") == "sin cabecera\n" and read(folder / "tres.md") == "---\n: [\n---\nroto"
    assert "- [[uno|Primero]] — 3 pág. · OCR 92.4%\n" in read(folder / "Índice.md")
    records = {r["note"]: r for r in V.read_jsonl(spark, str(folder / "_indice.jsonl"))}
    assert records["uno"] == {"note": "uno", "title": "Primero", "source": "uno?.md", "pages": 3, "ocr": True, "language": "es", "date_processed": None} and set(records) == {"uno", "dos", "tres"}
    assert W.publish_folder(spark, str(source), str(folder))["skipped"] == 3
    assert W.publish_folder(spark, str(source), str(folder), overwrite=True)["published"] == 3
    (folder / "Mapa - Viejo.md").write_text("x", encoding="utf-8")
    assert W.organise_vault(spark, str(folder)) == {"total": 3, "grupos": {"Otros": 2, "Word": 1}, "mocs": 2}
    assert not (folder / "Mapa - Viejo.md").exists() and "- [[uno|Primero]]" in read(folder / "Mapa - Word.md") and '  - "origen/word"' in read(folder / "uno.md")
    assert "[[Mapa - Otros|Otros]] (2)\n- [[Mapa - Word|Word]] (1)" in read(folder / "Índice.md") and read(folder / "dos.md") == "sin cabecera\n"
    json.dumps(records)


def test_warnings_failures_and_config(spark, tmp_path):
    docs = spark.createDataFrame([("a", "a.pdf", ["w1"], [(2, ["p"])]), ("b", "b.pdf", [], None)], "name string, source string, warnings array<string>, pages array<struct<page:int,warnings:array<string>>>")
    assert [tuple(r) for r in V.warnings_text(docs).collect()] == [("a_avisos", "Avisos para a.pdf:\n  - w1\n  - [pág. 2] p\n")]
    failed = spark.createDataFrame([("x.pdf", "failed", "ValueError: no"), ("y.pdf", "ok", None)], "source string, status string, error string")
    path = str(tmp_path / "failures")
    assert [V.append_failures(failed, path), V.append_failures(failed, path)] == [1, 1] and spark.read.parquet(path).count() == 2
    (tmp_path / "c.yaml").write_text("relate_top_k: 3\nunknown: 1\nvault_dir: /v\n", encoding="utf-8")
    c = Config.load(str(tmp_path / "c.yaml"))
    assert (c.relate_top_k, c.notes_dir, c.settings().top_k, Config.load(None).vault_dir) == (3, "/v/PDF importados", 3, None) and "unknown" not in c.as_dict()


def test_command_line(spark, tmp_path, capsys):
    from tests_support import docx

    from plumaria.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "acta.docx").write_bytes(docx())
    (tmp_path / "in" / "mala.docx").write_bytes(b"x")
    flags = ["--input", f"{tmp_path}/in", "--output", f"{tmp_path}/md", "--errors", f"{tmp_path}/bad", "--vault", f"{tmp_path}/vault", "--config", f"{tmp_path}/none.yaml"]
    said = []
    for command in ("convert", "convert", "publish", "organise", "relate"):
        main([command, *flags])
        said.append(json.loads(capsys.readouterr().out.splitlines()[-1]))
    assert said[0]["ok"] == 1 and said[0]["failed"] == 1 and said[1]["skip"] == 1 and said[2]["published"] == 1 and said[3]["grupos"] == {"Word": 1} and said[4]["total"] == 1
    note = (tmp_path / "vault" / "PDF importados" / "acta.md").read_text(encoding="utf-8")
    assert 'file_type: "docx"' in note and "words: " in note and '  - "origen/word"' in note and "author" not in note


def test_stopwords_and_stems(spark):
    row = spark.range(1).select(F.transform(X.stems(F.lit("Las centrales y los proyectos de las reuniones presentan señales")), lambda s: s["stem"]).alias("s"), X.clean_text(F.lit(" a\tb  c​\n　")).alias("c")).first()
    assert row.s[:3] == ["central", "proyecto", "reunion"] and row.c == "ab c"
