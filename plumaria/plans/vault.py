"""Relating the notes of a vault, end to end: profiles, signals, confidence, neighbours, and what is written back."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumaria.functions import text as X
from plumaria.operators import confidence as C
from plumaria.operators import entities as E
from plumaria.operators import profiles as P
from plumaria.operators import relate as R
from plumaria.sinks import markdown as M
from plumaria.sinks import vault as V
from plumaria.sources.lexicon import Lexicon, labels
from plumaria.sources.notes import read_notes
from plumaria.storage import stored

#: (names and texts) -> (doc_id, embedding of unit norm): a model of the user's, as a DataFrame function, such as one that maps Arrow batches.
Embedder = Callable[[DataFrame], DataFrame]


@dataclass
class Settings:
    """How notes are related."""

    threshold: float = 0.22
    top_k: int = 6
    keywords: int = 8
    floor: float = 0.08
    days: int = 21
    concept_least: float = 2.0
    alpha: float = 0.5
    entity_least: int = 2
    entity_share: float = 0.5
    embed_share: float = 0.4
    weights: dict[str, float] = field(default_factory=lambda: dict(C.WEIGHTS))


@dataclass
class Related:
    """Tables of a run: profiles; relations (a, b, confidence, reasons) of all pairs at the threshold; neighbours (note, other, confidence, reasons, rank); keywords; hits; linkable keys."""

    profiles: DataFrame
    reused: DataFrame
    relations: DataFrame
    neighbours: DataFrame
    keywords: DataFrame
    hits: DataFrame
    linkable: DataFrame


def relate(notes: DataFrame, lexicon: Lexicon, cached: DataFrame | None = None, settings: Settings | None = None, embedder: Embedder | None = None) -> Related:
    """Relations of notes (name, title, body). An embedder that fails leaves its signal out."""
    s = settings or Settings()
    found, reused = P.refreshed(notes.withColumn("title", X.display_title(F.trim("title"), F.col("name"))), cached, lexicon)
    n = found.count()
    words, hits, of_notes = stored(P.word_space(found, n), "words"), stored(P.direct_hits(found), "hits"), stored(P.entity_rows(found), "entities")
    concepts, entities = stored(P.concept_space(hits, lexicon.closure), "concepts"), stored(E.entity_weights(of_notes, n), "entity-weights")
    keywords = stored(P.keywords(words, found, s.keywords), "keywords")
    info = found.select(F.col("name").alias("doc_id"), "event", F.col("doc_date").alias("date"))
    if embedder is not None:
        said = found.select(F.col("name").alias("doc_id"), "title").join(keywords, "doc_id", "left").select("doc_id", F.concat("title", F.lit(". "), F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ")).alias("text"))
        try:
            info = info.join(stored(embedder(said), "embeddings"), "doc_id", "left")
        except Exception as e:  # a model that fails must not end the run
            print(f"no embeddings: {type(e).__name__}: {e}")
    relations = stored(C.pair_confidence(words.select("doc_id", "key", "w", "df"), concepts, entities, info, s.threshold, s.weights, s.floor, s.days, s.embed_share), "relations")
    neighbours = R.top_neighbours(relations.withColumnRenamed("confidence", "score"), s.top_k, F.concat("other", F.lit(".md")), ["reasons"])
    return Related(found, reused, relations, stored(neighbours.withColumnRenamed("score", "confidence"), "neighbours"), keywords, hits, stored(E.linkable(of_notes, n, s.entity_least, s.entity_share), "linkable"))


def rewritten(texts: DataFrame, run: Related, lexicon: Lexicon, settings: Settings | None = None) -> DataFrame:
    """(name, text) of notes (name, text): tags tema/, evento/ and entidad/ made anew, keywords, conceptos, entidades and related, canonical order, and the section of related notes."""
    s = settings or Settings()
    p = run.profiles
    none = F.array().cast("array<string>")
    themes = M.theme_tags(run.hits, lexicon.closure, s.concept_least).select(F.col("doc_id").alias("name"), F.col("tags").alias("themes"))
    strong = labels(lexicon, run.hits.where(F.col("hits") >= s.concept_least))
    concepts = strong.groupBy(F.col("doc_id").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("o"), "cid", "label"))), lambda x: x["label"]).alias("conceptos"))
    linked = P.entity_rows(p).join(run.linkable.select("key"), "key").groupBy(F.col("doc_id").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "display"))), lambda x: x["display"]).alias("shown"))
    near = run.neighbours.join(p.select(F.col("name").alias("other"), F.col("title").alias("other_title")), "other", "left")
    near = near.groupBy(F.col("note").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("other").alias("name"), F.coalesce("other_title", "other").alias("title"), "confidence", "reasons"))), lambda x: F.struct(x["name"].alias("name"), x["title"].alias("title"), x["confidence"].alias("confidence"), x["reasons"].alias("reasons"))).alias("relations"))
    rows = V.with_entries(texts.select("name", "text"))
    for part in (p.select("name", "event"), themes, concepts, linked, near, run.keywords.withColumnRenamed("doc_id", "name")):
        rows = rows.join(part, "name", "left")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("themes", "conceptos", "shown", "keywords")})
    event = F.when(F.col("event").isNotNull(), F.array(F.concat(F.lit("evento/"), X.tag_slug(F.col("event"))))).otherwise(none)
    entity = F.transform(F.slice("shown", 1, 5), lambda x: F.concat(F.lit("entidad/"), X.tag_slug(x)))
    kept = F.filter(V.values(F.col("entries"), "tags"), lambda t: ~(t.startswith("tema/") | t.startswith("evento/") | t.startswith("entidad/")))
    new = F.array_distinct(F.concat("themes", event, entity))
    links = F.coalesce(F.transform("relations", lambda r: F.concat(F.lit("[["), r["name"], F.lit("]]"))), none)
    e = V.filled(V.put(F.col("entries"), {"tags": F.concat(kept, F.array_except(new, kept)), "keywords": F.col("keywords"), "conceptos": F.col("conceptos"), "entidades": F.slice("shown", 1, 8), "related": links}))
    body = F.regexp_replace(F.regexp_replace("text", V.FENCE, ""), r"\A\n+", "")
    section = F.regexp_replace(M.related_section(body, F.col("relations")), r"\A\n+", "")
    return rows.select("name", V.with_body(V.rendered(V.ordered(e)), section).alias("text"))


def theme_members(run: Related, lexicon: Lexicon, least: float = 2.0) -> DataFrame:
    """(cid, hub, name, title): notes under each concept that they mention often enough, by the concept's label."""
    rows = labels(lexicon, run.hits.where(F.col("hits") >= least)).join(run.profiles.select(F.col("name").alias("doc_id"), "title"), "doc_id")
    return rows.select("cid", F.col("label").alias("hub"), F.col("doc_id").alias("name"), "title")


def audit(run: Related) -> DataFrame:
    """(name, text): what was found of each note, by name."""
    p = run.profiles
    near = run.neighbours.join(p.select(F.col("name").alias("other"), F.col("title").alias("other_title")), "other", "left")
    line = F.concat(F.lit("- "), F.bround(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%  "), F.coalesce("other_title", "other"), F.lit("  ("), F.array_join("reasons", ", "), F.lit(")"))
    near = near.groupBy(F.col("note").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    bits = F.concat_ws(" · ", F.when(F.size("hits") > 0, F.concat(F.lit("conceptos: "), F.array_join(F.array_sort(F.map_keys("hits")), ", "))), F.concat(F.lit("evento: "), "event"))
    rows = p.join(near, "name", "left")
    text = F.concat_ws("\n", F.concat(F.lit("## "), "title"), F.when(bits != "", F.concat(F.lit("_"), bits, F.lit("_"))), F.coalesce(F.array_join("lines", "\n"), F.lit(V.NO_RELATION)), F.lit(""))
    return rows.select("name", text.alias("text")).orderBy("name")


def organise_vault(spark: SparkSession, folder: str, title: str | None = None) -> dict:
    """Groups the notes of a folder by the format they came from: tags, a page for each group, an index of the pages."""
    notes = stored(V.organised(read_notes(spark, folder, whole=True)), "organised")
    M.write_vault(notes.select("name", "text"), folder, True).write.format("noop").mode("overwrite").save()
    members = notes.select(F.col("grupo").alias("hub"), "name", "title")
    made = V.write_hubs(members, folder, V.HUB, lambda hub, n: (f"{V.HUB}{hub}", V.page(f"{V.MAP}{hub}", ["moc", f"origen/{hub.lower()}"], hub, f"{n} documento(s)")))
    total, name = notes.count(), title or os.path.basename(folder.rstrip("/"))
    V.write_hub_index(made, os.path.join(folder, f"{V.INDEX}.md"), V.page(f"Índice — {name}", ["moc", "índice"], f"Índice — {name}", f"{total} documento(s) en {len(made)} apartados · actualizado {date.today().isoformat()}"))
    return {"total": total, "grupos": {hub: n for _, hub, n in made}, "mocs": len(made)}


def publish_folder(spark: SparkSession, source: str, folder: str, tags: tuple[str, ...] = ("pdf-importado",), overwrite: bool = False, title: str | None = None, on_event: Callable[[str, str, str], None] | None = None) -> dict:
    """Publishes the notes of a folder into a vault's folder, then writes its index page and index records."""
    os.makedirs(folder, exist_ok=True)
    files = read_notes(spark, source, whole=True, every=True)
    there = spark.createDataFrame([(f.removesuffix(".md"),) for f in os.listdir(folder) if f.endswith(".md")], "name string")
    notes = stored(V.published(files, there, tags, overwrite), "published")
    done = stored(M.write_vault(notes.where("status = 'ok'").select("name", "text"), folder, True).select("name", F.col("status").alias("put")), "put")
    notes = stored(notes.join(done, "name", "left").withColumn("status", F.when(F.col("put") == "failed", "error").otherwise(F.col("status"))).drop("put"), "published")
    name = title or os.path.basename(folder.rstrip("/"))
    n = notes.where("status in ('ok', 'skip')").count()
    V.write_page(spark, os.path.join(folder, f"{V.INDEX}.md"), V.page(f"Índice — {name}", ["índice"], f"Índice — {name}", f"{n} documento(s) · actualizado {date.today().isoformat()}"), M.index_lines(V.index_entries(notes)))
    V.write_jsonl(V.index_records(notes), os.path.join(folder, "_indice.jsonl"))
    if on_event:
        for r in notes.select("status", "source", "name").toLocalIterator():
            on_event(r["status"], r["source"], r["name"])
    counts = {r["status"]: r["n"] for r in V.summary(notes).collect()}
    return {"published": counts.get("ok", 0), "skipped": counts.get("skip", 0), "failed": counts.get("error", 0), "total": sum(counts.values())}


def relate_vault(spark: SparkSession, folder: str, lexicon: Lexicon, settings: Settings | None = None, embedder: Embedder | None = None) -> dict:
    """Relates the notes of a folder and writes back what changed, theme pages, the index of profiles and the audit. A run without changes writes no note."""
    s, index = settings or Settings(), os.path.join(folder, "_semantica")
    texts = stored(read_notes(spark, folder, whole=True), "texts")
    if texts.isEmpty():
        return {"total": 0, "reused": 0, "written": 0, "links": 0, "temas": 0}
    notes = read_notes(spark, folder)
    run = relate(notes, lexicon, P.load(spark, index), s, embedder)
    done = stored(M.write_vault(rewritten(texts, run, lexicon, s), folder, True), "done")
    members = stored(theme_members(run, lexicon, s.concept_least), "themes")
    ids = {r["hub"]: r["cid"] for r in members.select("hub", "cid").distinct().collect()}  # concepts of the lexicon at most
    roots = {r["cid"]: r["root"] for r in lexicon.closure.groupBy("cid").agg(F.max_by("ancestor", "k").alias("root")).collect()}
    slug = lambda x: spark.range(1).select(X.tag_slug(F.lit(x))).first()[0]

    def head(hub: str, n: int) -> tuple[str, str]:
        cid = ids[hub]
        tag = f"tema/{slug(cid)}" if roots.get(cid, cid) == cid else f"tema/{slug(roots[cid])}/{slug(cid)}"
        name = spark.range(1).select(X.file_slug(F.lit(f"{V.THEME}{hub}"))).first()[0]
        return name, V.page(f"Tema — {hub}", ["moc", tag], hub, f"{n} nota(s) sobre este tema")

    made = V.write_hubs(members.select("hub", "name", "title"), folder, V.THEME, head, least=2)
    themes = os.path.join(folder, f"{V.THEMES}.md")
    if made:
        V.write_hub_index(made, themes, V.page(V.THEMES, ["moc", "índice"], V.THEMES, f"{len(made)} tema(s) · actualizado {date.today().isoformat()}"))
    elif os.path.exists(themes):
        os.remove(themes)
    P.save(run.profiles, index)
    total = run.profiles.count()
    V.write_page(spark, os.path.join(folder, "_relaciones.md"), f"# Auditoría de relaciones (archivo de sistema)\n\nUmbral de confianza: **{round(s.threshold * 100)}%** · máx. {s.top_k} por nota · {total} notas.\n\n", audit(run), "text")
    return {"total": total, "reused": run.reused.count(), "written": done.where("status = 'ok'").count(), "links": run.relations.count(), "temas": len(made)}


def strongest(run: Related, k: int = 12) -> DataFrame:
    """The k relations of most confidence."""
    return run.relations.orderBy(F.round("confidence", 6).desc(), "a", "b").limit(k)
