"""Queries over the driver's tables, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumaria.functions import text as X
from plumaria.operators import chunks as K
from plumaria.operators import confidence as C
from plumaria.operators import entities as E
from plumaria.operators import layout as Y
from plumaria.operators import profiles as P
from plumaria.operators import relate as R
from plumaria.sinks import markdown as M
from plumaria.sinks import vault as V
from plumaria.sources import lexicon as L
from plumaria.storage import stored
from plumaria.streaming import watch as W

CONCEPTS = [("root", None), ("words", "root"), ("articles", "words"), ("german", "root")]
TERMS = [("articles", 1, "the"), ("words", 2, "that and"), ("words", 1, "was"), ("german", 1, "und"), ("german", 1, "der"), ("root", 1, "with")]
EVENTS = [("junta", 0, 1, "the"), ("junta", 0, 2, "that and"), ("informe", 1, 1, "und"), ("informe", 1, 1, "der"), ("acta", 2, 1, "was"), ("acta", 2, 1, "with")]


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def tokens_per_doc(spark, sf_dir):
    return R.note_terms(notes(spark, sf_dir)).groupBy("doc_id").agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_stems"))


def stem_counts(spark, sf_dir):
    return R.note_terms(notes(spark, sf_dir)).groupBy("stem").agg(F.sum("tf").alias("n"))


def term_df_idf(spark, sf_dir):
    docs = notes(spark, sf_dir)
    return R.idf(R.note_terms(docs), docs.count()).select("stem", "df", F.round("idf", 6).alias("idf"))


def doc_keywords_top8(spark, sf_dir):
    return R.keywords(notes(spark, sf_dir)).select("doc_id", F.col("rank").cast("long").alias("rank"), "stem", F.round("tfidf", 4).alias("tfidf"))


def surface_forms(spark, sf_dir):
    return R.note_terms(notes(spark, sf_dir)).select("doc_id", "stem", "raw")


def content_hash(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", X.content_hash(F.col("text")).alias("hash"))


def page_kind(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", X.page_kind(F.col("text")).alias("kind"))


def clean_text(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("clean_md5"))


def slugs(spark, sf_dir):
    p = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", X.tag_slug(p).alias("tag"), X.file_slug(p).alias("file"), X.wikilink(p, F.col("p_type")).alias("link"), X.table_row([p, F.col("p_brand")]).alias("row"))


def _terms(spark):
    return spark.createDataFrame(TERMS, "cid string, n int, term string"), spark.createDataFrame(CONCEPTS, "cid string, parent string")


def ancestor_closure(spark, sf_dir):
    return R.ancestors(_terms(spark)[1]).select("cid", "ancestor", F.col("k").cast("long").alias("k"))


def concept_vectors(spark, sf_dir):
    terms, concepts = _terms(spark)
    hits = R.concept_hits(notes(spark, sf_dir), L.small(terms, len(TERMS)))
    return R.concept_vectors(hits, L.small(R.ancestors(concepts), 32 * len(CONCEPTS))).select("doc_id", "cid", F.round("weight", 6).alias("weight"))


def near_dup_links(spark, sf_dir):
    pairs = R.text_pairs(notes(spark, sf_dir), 0.8)
    return pairs.select("a", "b", F.round("cosine", 4).alias("cosine"))


def embedding_topk(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return R.vector_topk(v, v.where("vec_id % 50 = 0")).select("query", "vec_id", F.round("cosine", 5).alias("cosine"), F.col("rank").cast("long").alias("rank"))


def temporal_proximity(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    before = F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select("o_orderkey", F.round(X.proximity(F.to_date("o_orderdate"), F.to_date(before)), 6).alias("score"))


def publish_skip(spark, sf_dir):
    return V.unpublished(notes(spark, sf_dir), read(spark, sf_dir, "labels"), "doc_id").where("status = 'ok'").select("doc_id", "status")


def organise_counts(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "pdf").when(F.col("lang") == "es", "DOCX").when(F.col("lang") == "fr", "").otherwise("txt")
    group = X.origin(kind, F.concat("source", F.when(F.col("lang") == "fr", F.lit(".XLSX")).otherwise("")))
    return d.groupBy(group.alias("grupo")).agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


def running_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.split("text", "\n").alias("l"))
    return R.running_lines(lines.select("doc", "page", F.element_at("l", 1).alias("first"), F.element_at("l", -1).alias("last")), share=0.05)


def watch_stability(spark, sf_dir):
    polls = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.floor("value").cast("long").alias("size"))
    return W.stable_sizes(polls, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "size")


def note_entities(spark, sf_dir):
    return E.entities(notes(spark, sf_dir))


def linkable_entities(spark, sf_dir):
    docs = notes(spark, sf_dir)
    return E.linkable(E.entities(docs), docs.count())


def joined_lines(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", F.md5(X.join_lines(F.split("text", "\n"))).alias("joined_md5"))


def note_dates(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", F.date_format(X.doc_date(F.lit(""), F.col("text")), "yyyy-MM-dd").alias("date"))


def list_lines(spark, sf_dir):
    lines = notes(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.where(X.is_list_line(F.col("text"))).select("doc_id", F.col("line").cast("long").alias("line"), X.strip_list_marker(F.col("text")).alias("item"))


def note_chunks(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n"), "text").alias("text"))
    return K.chunks(d).select("doc_id", F.col("seq.k").alias("k"), F.col("seq.piece").alias("piece"), "text", "heading_path", "page")


def _relations(spark, sf_dir, best=None):
    """All six signals: text, concepts, entities, events, dates and embeddings (of the documents that have one)."""
    docs = notes(spark, sf_dir)
    terms, concepts = _terms(spark)
    n = docs.count()
    words = stored(R.weights(docs).select("doc_id", F.col("stem").alias("key"), "w", "df"), "words")
    space = stored(P.concept_space(R.concept_hits(docs, terms), R.ancestors(concepts)), "concepts")
    found = stored(E.entity_weights(E.entities(docs), n), "entities")
    info = docs.join(E.events(docs, _events(spark)), "doc_id", "left").select("doc_id", "event", X.doc_date(F.lit(""), F.col("text")).alias("date"))
    info = info.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return C.pair_confidence(words, space, found, stored(info, "info"), best=best)


def pair_confidence(spark, sf_dir):
    return _relations(spark, sf_dir).select("a", "b", F.round("confidence", 3).alias("confidence"), F.array_join("reasons", ", ").alias("reasons"))


def related_topk(spark, sf_dir):
    pairs = _relations(spark, sf_dir, best=6).withColumnRenamed("confidence", "score")
    return R.top_neighbours(pairs).select("note", "other", F.col("rank").cast("long").alias("rank"))


def _events(spark):
    return spark.createDataFrame(EVENTS, "event string, ord int, n int, term string")


def concept_hits(spark, sf_dir):
    return R.concept_hits(notes(spark, sf_dir), _terms(spark)[0])


def doc_event(spark, sf_dir):
    return E.events(notes(spark, sf_dir), _events(spark))


def theme_tags(spark, sf_dir):
    terms, concepts = _terms(spark)
    hits = R.concept_hits(notes(spark, sf_dir), terms)
    return M.theme_tags(hits, R.ancestors(concepts)).select("doc_id", F.array_join("tags", " ").alias("tags"))


def title_weighted_stems(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", X.analysis_text(F.col("source"), F.col("text")).alias("text"))
    return R.note_terms(d).groupBy("doc_id").agg(F.max("tf").alias("most"), F.sum("tf").alias("n"))


def keyword_forms(spark, sf_dir):
    best = F.transform(F.array_sort(F.collect_list(F.struct("rank", "raw"))), lambda x: x["raw"])
    return R.keywords(notes(spark, sf_dir)).groupBy("doc_id").agg(F.array_join(F.array_distinct(best), " ").alias("keywords"))


def profile_reuse(spark, sf_dir):
    """The cache holds every third document as it was, and the next with another title; the others are new."""
    d = read(spark, sf_dir, "documents").where("lang = 'es'").select("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("title"), F.col("text").alias("body"))
    lexicon = L.parsed(spark, {}, "s")
    old = d.where("doc_id % 3 < 2").withColumn("title", F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x"), "title")).otherwise(F.col("title")))
    found, reused = P.refreshed(d, stored(P.profiles(old, lexicon), "cached"), lexicon)
    out = found.join(reused.withColumn("reused", F.lit(True)), "name", "left")
    return out.select("name", "content_hash", "n_tokens", F.date_format("doc_date", "yyyy-MM-dd").alias("date"), F.coalesce("reused", F.lit(False)).alias("reused"))


def _published(spark, sf_dir):
    """Notes of orders, as front matter columns would be read."""
    o = read(spark, sf_dir, "orders")
    e = lambda k, v, listed=False: F.struct(F.lit(k).alias("key"), F.lit(listed).alias("list"), F.transform(v, V.quoted).alias("shown"), v.alias("plain"))
    one = lambda c: F.array(c.cast("string"))
    entries = F.array(e("title", one(F.col("o_orderpriority"))), e("pages", one(F.col("o_custkey") % 4)), e("tags", F.array(F.col("o_orderstatus"), F.lit("tema/viejo")), True), e("date_processed", one(F.date_format("o_orderdate", "yyyy-MM-dd"))))
    return o.select(F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("source"), F.when(F.col("o_orderkey") % 5 == 0, "error").otherwise("ok").alias("status"), entries.cast(V.ENTRIES).alias("entries"))


def enriched_front_matter(spark, sf_dir):
    rows = _published(spark, sf_dir)
    return rows.select("name", V.rendered(V.restamped(F.col("entries"), "tema/", F.lit("nuevo"))).alias("stamped"), F.md5(V.rendered(V.enriched(F.col("entries"), ["#O", "pdf importado", "O"]))).alias("enriched_md5"))


def index_page(spark, sf_dir):
    lines = M.index_lines(V.index_entries(_published(spark, sf_dir)))
    return lines.select("line")


def index_records(spark, sf_dir):
    return V.index_records(_published(spark, sf_dir)).select("note", F.md5("json").alias("json_md5"))


def hub_pages(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("hub"), F.col("c_name").alias("name"), F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("title"))
    return M.hubs(c, 2).select("hub", "n", F.md5("text").alias("text_md5"))


def _spans(spark, sf_dir):
    q = F.col("l_quantity")
    word = F.when(q < 10, "1. item").when(q < 18, "- dash").when(q < 35, "word-").otherwise("Fin.")
    page, block = (F.col("l_orderkey") % 4 + 1).cast("int"), F.col("l_orderkey")
    x, y = (block * 7 % 100).cast("double"), (block * 13 % 300).cast("double")
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 20).alias("doc"), page.alias("page"), block.alias("block"), (F.col("l_linenumber") % 3).alias("line"), (F.col("l_linenumber") * F.lit(10**12) + F.col("l_partkey") * F.lit(10**6) + F.col("l_suppkey")).alias("span"), F.concat(word, "l_returnflag").alias("text"),
        (F.col("l_discount") * 50 + 8).alias("size"), (F.col("l_tax") > 0.04).alias("bold"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 10).alias("y1"),
    )


def _boxes(spark, sf_dir):
    k = F.col("s_suppkey")
    x, y = (k * 3 % 60).cast("double"), (k * 17 % 250).cast("double")
    return read(spark, sf_dir, "supplier").select((k % 20).alias("doc"), (k % 4 + 1).cast("int").alias("page"), F.array(F.array("s_name", F.lit(" a\nb ")), F.array(F.lit(" "), F.lit(None).cast("string"))).alias("rows"), x.alias("x0"), y.alias("y0"), (x + 30).alias("x1"), (y + 20).alias("y1"))


def font_model(spark, sf_dir):
    return Y.font_model(_spans(spark, sf_dir))


def line_info(spark, sf_dir):
    return Y.line_info(_spans(spark, sf_dir))


def table_box_filter(spark, sf_dir):
    blocks = _spans(spark, sf_dir).select("doc", "page", "block", "x0", "y0", "x1", "y1").distinct()
    return Y.inside_tables(blocks, _boxes(spark, sf_dir)).groupBy("doc", "page").agg(F.count("*").alias("n"), F.sum("block").alias("blocks"))


def page_blocks(spark, sf_dir):
    rows = Y.page_blocks(_spans(spark, sf_dir), _boxes(spark, sf_dir)).where("b.type <> 'table'")
    return rows.select("doc", "page", "top", "b.type", "b.text", F.col("b.level").alias("level"), F.array_join("b.items", "|").alias("items"), F.col("b.ordered").alias("ordered"))


def table_blocks(spark, sf_dir):
    rows = Y.page_blocks(_spans(spark, sf_dir), _boxes(spark, sf_dir)).where("b.type = 'table'")
    return rows.select("doc", "page", "top", F.array_join(F.transform("b.rows", lambda r: F.array_join(r, "|")), ";").alias("cells"))


def cleaned_blocks(spark, sf_dir):
    """Lines of documents as blocks; each source a document of pages."""
    lines = read(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    blocks = lines.withColumn("b", Y._block("paragraph", text=F.col("line"))).drop("line")
    return Y.clean_blocks(blocks).groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.length("b.text")).cast("long").alias("chars"))


def _words(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("doc"), (F.col("l_orderkey") % 9 + 1).cast("int").alias("page"), (F.col("l_orderkey") % 30).alias("block"), (F.col("l_partkey") % 3).alias("par"), (q % 2).alias("line"), (F.col("l_linenumber") * F.lit(10**17) + F.col("l_orderkey") * F.lit(10**9) + F.col("l_partkey") * F.lit(10**4) + F.col("l_suppkey")).alias("word"),
        F.concat(F.when(q < 12, "2) uno").when(q < 30, "dos").otherwise(" "), "l_returnflag").alias("text"), (F.lit(10) + F.col("l_linenumber") * F.col("l_linenumber") % 9).cast("double").alias("height"), F.round(F.col("l_discount") * 1000 - 5, 0).cast("string").alias("conf"),
    )


def ocr_paragraphs(spark, sf_dir):
    return Y.ocr_blocks(_words(spark, sf_dir)).select("doc", "page", F.col("seq").cast("long").alias("seq"), "b.type", F.md5(F.coalesce("b.text", F.array_join("b.items", "|"))).alias("text_md5"), F.col("b.level").alias("level"))


def ocr_confidence(spark, sf_dir):
    return Y.ocr_confidence(_words(spark, sf_dir)).select("doc", "page", "confidence", "n_low", "warning")


def ocr_documents(spark, sf_dir):
    return Y.document_confidence(Y.ocr_confidence(_words(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (
        note_entities, linkable_entities, joined_lines, note_dates, list_lines, note_chunks, pair_confidence, tokens_per_doc, stem_counts, term_df_idf, doc_keywords_top8, surface_forms, content_hash, page_kind, clean_text, slugs, ancestor_closure,
        concept_vectors, near_dup_links, related_topk, embedding_topk, temporal_proximity, publish_skip, organise_counts, running_lines, watch_stability, concept_hits, doc_event, theme_tags, title_weighted_stems, keyword_forms, profile_reuse,
        enriched_front_matter, index_page, index_records, hub_pages, font_model, line_info, table_box_filter, page_blocks, table_blocks, cleaned_blocks, ocr_paragraphs, ocr_confidence, ocr_documents,
    )
}

_stem = "CASE WHEN length(raw) <= 4 THEN raw " + " ".join(f"WHEN ends_with(raw, '{e}') AND length(raw) >= {len(e) + 3} THEN left(raw, length(raw) - {len(e)})" for e in X.ENDINGS) + " WHEN ends_with(raw, 'ces') THEN left(raw, length(raw) - 3) || 'z' WHEN regexp_matches(raw, '[^aeiou]es$') THEN left(raw, length(raw) - 2) WHEN regexp_matches(raw, '[aeiou]s$') THEN left(raw, length(raw) - 1) ELSE raw END"
_stop = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_tokens = f"""
t0 AS (SELECT doc_id, regexp_extract_all(lower(text), '{X.TOKEN}') AS l FROM documents),
t1 AS (SELECT doc_id, unnest(l) AS r, generate_subscripts(l, 1) - 1 AS pos FROM t0),
t2 AS (SELECT doc_id, pos, translate(r, '{X.ACCENTS}', '{X.PLAIN}') AS raw FROM t1),
t3 AS (SELECT doc_id, pos, raw, {_stem} AS stem FROM t2 WHERE raw NOT IN ({_stop})),
tok AS (SELECT * FROM t3 WHERE length(stem) >= 3 AND stem NOT IN ({_stop})),
tf AS (SELECT doc_id, stem, count(*) AS tf, min(pos) AS first_pos FROM tok GROUP BY ALL),
idf AS (SELECT stem, count(*) AS df, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf FROM tf GROUP BY stem),
tw AS (SELECT doc_id, stem, first_pos, df, (1 + ln(tf)) * idf AS tfidf FROM tf JOIN idf USING (stem)),
nw AS (SELECT *, tfidf / sqrt(sum(tfidf * tfidf) OVER (PARTITION BY doc_id)) AS w FROM tw)"""
_pairs = f"""WITH {_tokens},
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS cosine FROM nw a JOIN nw b ON a.stem = b.stem AND a.doc_id < b.doc_id GROUP BY ALL HAVING sum(a.w * b.w) >= 0.8)"""
_closure = """WITH RECURSIVE c(cid, parent) AS (VALUES ('root', NULL), ('words', 'root'), ('articles', 'words'), ('german', 'root')),
cl AS (SELECT cid, cid AS ancestor, 0 AS k FROM c UNION ALL SELECT cl.cid, c.parent, k + 1 FROM cl JOIN c ON cl.ancestor = c.cid WHERE c.parent IS NOT NULL)"""
_months = "|".join(E.MONTHS)
_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
_plain = f"translate(lower(d), '{X.ACCENTS}', '{X.PLAIN}')"
# DuckDB's \b knows ASCII only, so every run of word characters is put between marks.
_M = ""
_name = rf"[A-ZÁÉÍÓÚÑ][a-záéíóúñü]{{2,}}{_M}(?:\\s+{_M}(?:de|del|la|las|los|y|e){_M}\\s+|\\s+)".replace("\\\\", "\\")
_last = "[A-ZÁÉÍÓÚÑ][a-záéíóúñü]{2,}"
_marked = (
    rf"{_M}([A-ZÁÉÍÓÚÑ]{{2,8}}){_M}",
    rf"((?:{_M}[A-Za-zÁÉÍÓÚÑ]{{1,4}}(?:{_M}-{_M})?|{_M}-{_M}|{_M})\d{{2,4}}(?:{_M}-{_M}\d{{1,4}})+){_M}",
    rf"{_M}(\d{{1,2}}{_M}[/-]{_M}\d{{1,2}}{_M}[/-]{_M}\d{{2,4}}|\d{{4}}{_M}-{_M}\d{{2}}{_M}-{_M}\d{{2}}){_M}",
    rf"(?i){_M}(\d{{1,2}}{_M}\s+{_M}de{_M}\s+{_M}(?:{_months})(?:{_M}\s+{_M}de{_M}\s+{_M}\d{{4}})?)",
    rf"{_M}((?:{_name}{_M}){{1,3}}{_last}){_M}",
)
_entities = f"WITH b AS (SELECT doc_id, regexp_replace(text, '([\\p{{L}}\\p{{N}}\\p{{M}}_]+)', '{_M}\\1{_M}', 'g') AS t FROM documents), m0 AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS o, '{E.PATTERNS[i][0]}' AS kind, unnest(regexp_extract_all(t, '{pattern}', 1)) AS d, generate_subscripts(regexp_extract_all(t, '{pattern}', 1), 1) AS i FROM b" for i, pattern in enumerate(_marked)) + f"""),
m AS (SELECT doc_id, o, kind, replace(d, '{_M}', '') AS d, i FROM m0),
c AS (SELECT *, trim(d, ' .,:;') AS display FROM m WHERE NOT (kind = 'sigla' AND (d IN ({_quoted(E.NOT_ACRONYM)}) OR {_plain} IN ({_stop}))) AND NOT (kind = 'nombre' AND regexp_extract({_plain}, '^(\\S+)', 1) IN ({_quoted(E.NOT_FIRST)}))),
k AS (SELECT *, trim(regexp_replace(translate(lower(display), '{X.ACCENTS}', '{X.PLAIN}'), '\\s+', ' ', 'g')) AS key FROM c),
g AS (SELECT doc_id, key, count(*) AS freq, min((o, i, kind, display)) AS f FROM k WHERE length(key) >= 2 GROUP BY ALL),
e AS (SELECT doc_id, key, f[3] AS kind, f[4] AS display, freq FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, f[3], key) <= 40)"""
_date = r"""SELECT doc_id, strftime(try_cast(CASE WHEN x <> '' THEN regexp_extract(x, '[/-](\d{4})$', 1) || '-' || lpad(regexp_extract(x, '[/-](\d+)[/-]', 1), 2, '0') || '-' || lpad(regexp_extract(x, '^(\d+)', 1), 2, '0') END AS DATE), '%Y-%m-%d') AS date FROM (SELECT doc_id, regexp_extract(text, '\b(\d{1,2}[/-]\d{1,2}[/-]\d{4})\b', 1) AS x FROM documents)"""

_closure_part = _closure.removeprefix("WITH RECURSIVE ")
_hits = f"""WITH RECURSIVE {_closure_part}, {_tokens}, terms(cid, n, term) AS (VALUES {", ".join(str(t) for t in TERMS)}),
g0 AS (SELECT doc_id, stem, lead(stem, 1) OVER o AS s2, lead(stem, 2) OVER o AS s3 FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT doc_id, 1 AS n, stem AS term FROM g0 UNION ALL SELECT doc_id, 2, stem || ' ' || s2 FROM g0 WHERE s2 IS NOT NULL UNION ALL SELECT doc_id, 3, stem || ' ' || s2 || ' ' || s3 FROM g0 WHERE s3 IS NOT NULL),
h AS (SELECT doc_id, cid, sum(terms.n) AS hits FROM g JOIN terms ON g.n = terms.n AND g.term = terms.term GROUP BY ALL)"""
_event = f"""et(event, ord, n, term) AS (VALUES {", ".join(str(t) for t in EVENTS)}), ec AS (SELECT doc_id, event, ord, count(*) AS c FROM g JOIN et ON g.n = et.n AND g.term = et.term GROUP BY ALL),
ev AS (SELECT doc_id, event FROM ec QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, ord) = 1)"""
_entities_apart = _entities.removeprefix("WITH ").replace("\nc AS (", "\nec0 AS (").replace("FROM c)", "FROM ec0)").replace("\ng AS (", "\neg AS (").replace("FROM g QUALIFY", "FROM eg QUALIFY")
_six = f"""{_hits}, {_event}, {_entities_apart},
cv0 AS (SELECT doc_id, ancestor AS key, sum(CAST(hits AS DOUBLE) * pow(0.5, k)) AS wt FROM h JOIN cl ON h.cid = cl.cid GROUP BY ALL), cv AS (SELECT doc_id, key, wt / sqrt(sum(wt * wt) OVER (PARTITION BY doc_id)) AS w FROM cv0),
ei AS (SELECT key, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf FROM e GROUP BY key), ew AS (SELECT doc_id, key, idf / sqrt(sum(idf * idf) OVER (PARTITION BY doc_id)) AS w FROM e JOIN ei USING (key)),
tp AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS t FROM nw a JOIN nw b ON a.stem = b.stem AND a.doc_id < b.doc_id GROUP BY ALL),
cp AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS cn FROM cv a JOIN cv b ON a.key = b.key AND a.doc_id < b.doc_id GROUP BY ALL),
ep AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS en FROM ew a JOIN ew b ON a.key = b.key AND a.doc_id < b.doc_id GROUP BY ALL),
mp AS (SELECT a.vec_id AS a, b.vec_id AS b, greatest(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0.0) AS em FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id),
dates AS ({_date}), di AS (SELECT doc_id, event, CAST(date AS DATE) AS date FROM documents LEFT JOIN ev USING (doc_id) JOIN dates USING (doc_id)),
s AS (SELECT x.doc_id AS a, y.doc_id AS b, coalesce(t, 0) AS t, coalesce(cn, 0) AS cn, coalesce(en, 0) AS en, em, coalesce(x.event = y.event, false) AS ev, coalesce(greatest(0.0, 1 - abs(date_diff('day', x.date, y.date)) / 21.0), 0.0) AS ti
    FROM di x JOIN di y ON x.doc_id < y.doc_id LEFT JOIN tp ON tp.a = x.doc_id AND tp.b = y.doc_id LEFT JOIN cp ON cp.a = x.doc_id AND cp.b = y.doc_id LEFT JOIN ep ON ep.a = x.doc_id AND ep.b = y.doc_id LEFT JOIN mp ON mp.a = x.doc_id AND mp.b = y.doc_id),
r0 AS (SELECT *, 0.38 * t + 0.34 * cn + 0.18 * en + 0.05 * (CASE WHEN ev THEN 1 ELSE 0 END) + 0.05 * ti AS sparse FROM s WHERE cn > 0 OR en > 0 OR t >= 0.08 OR coalesce(em, 0) >= 0.35),
r AS (SELECT *, least(CASE WHEN em IS NULL THEN sparse ELSE 0.6 * sparse + 0.4 * em END, 1.0) AS conf FROM r0)"""
_joined = r"regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform({0}, lambda x: regexp_replace(x, '\s+$', '')), lambda x: x <> ''), chr(10)), '-\n(\p{{Ll}})', '\1', 'g'), '\n\s*', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_fonts = """WITH sp AS (SELECT l_orderkey % 20 AS doc, CAST(l_orderkey % 4 + 1 AS INTEGER) AS page, l_orderkey AS block, l_linenumber % 3 AS line, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS span,
    CASE WHEN l_quantity < 10 THEN '1. item' WHEN l_quantity < 18 THEN '- dash' WHEN l_quantity < 35 THEN 'word-' ELSE 'Fin.' END || l_returnflag AS text, CAST(round_even(l_discount * 50 + 8, 0) AS INTEGER) AS size, l_tax > 0.04 AS bold,
    CAST(l_orderkey * 7 % 100 AS DOUBLE) AS x0, CAST(l_orderkey * 13 % 300 AS DOUBLE) AS y0 FROM lineitem),
sums AS (SELECT doc, size, sum(length(text)) AS chars, min((page, block, line, span)) AS place FROM sp GROUP BY ALL), bodies AS (SELECT doc, arg_min(size, (-chars, place)) AS body FROM sums GROUP BY doc),
fonts AS (SELECT doc, size, chars, body, CASE WHEN size > body THEN CAST(least(dense_rank() OVER (PARTITION BY doc ORDER BY size DESC), 4) AS INTEGER) END AS level FROM sums JOIN bodies USING (doc)),
ls AS (SELECT doc, page, block, line, arg_min(size, (-n, place)) AS size FROM (SELECT doc, page, block, line, size, sum(length(text)) AS n, min(span) AS place FROM sp GROUP BY ALL) GROUP BY ALL),
info AS (SELECT doc, page, block, line, string_agg(text, '' ORDER BY span, text) AS text, any_value(ls.size) AS size, sum(CASE WHEN bold THEN length(text) ELSE 0 END) / sum(length(text)) > 0.6 AS bold FROM sp JOIN ls USING (doc, page, block, line) GROUP BY ALL)"""
_layout = _fonts + """, box AS (SELECT s_suppkey % 20 AS doc, CAST(s_suppkey % 4 + 1 AS INTEGER) AS page, s_suppkey * 3 % 60 AS tx, s_suppkey * 17 % 250 AS ty FROM supplier),
free AS (SELECT DISTINCT doc, page, block, y0 FROM sp WHERE NOT EXISTS (SELECT 1 FROM box WHERE box.doc = sp.doc AND box.page = sp.page AND x0 + 20 BETWEEN tx AND tx + 30 AND y0 + 5 BETWEEN ty AND ty + 20))"""
_ocr = """WITH w AS (SELECT * FROM (SELECT l_suppkey % 20 AS doc, CAST(l_orderkey % 9 + 1 AS INTEGER) AS page, l_orderkey % 30 AS block, l_partkey % 3 AS par, CAST(l_quantity AS INTEGER) % 2 AS line, l_linenumber * 100000000000000000 + l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey AS word,
    trim(CASE WHEN l_quantity < 12 THEN '2) uno' WHEN l_quantity < 30 THEN 'dos' ELSE ' ' END || l_returnflag) AS text, CAST(10 + l_linenumber * l_linenumber % 9 AS DOUBLE) AS height, round(l_discount * 1000 - 5, 0) AS conf FROM lineitem) WHERE conf >= 0 AND text <> '')"""

ORACLE_SQL = {
    "note_entities": f"{_entities} SELECT * FROM e",
    "linkable_entities": f"{_entities} SELECT key, count(DISTINCT doc_id) AS df FROM e GROUP BY key HAVING count(DISTINCT doc_id) BETWEEN 2 AND greatest(2, (SELECT count(*) // 2 FROM documents))",
    "joined_lines": r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+$', '')), lambda x: x <> ''), chr(10)), '-\n(\p{Ll})', '\1', 'g'), '\n\s*', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS joined_md5 FROM documents",
    "note_dates": _date,
    "list_lines": rf"SELECT doc_id, line, regexp_replace(regexp_replace(regexp_replace(t, '{X.BULLET}', ''), '{X.ORDERED}', ''), '^\s+|\s+$', '', 'g') AS item FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents) WHERE regexp_matches(t, '{X.BULLET}') OR regexp_matches(t, '{X.ORDERED}')",
    "pair_confidence": f"{_six} SELECT a, b, round(conf, 3) AS confidence, concat_ws(', ', CASE WHEN cn > 0.05 THEN 'tema' END, CASE WHEN en > 0.05 THEN 'entidad' END, CASE WHEN t >= 0.08 THEN 'texto' END, CASE WHEN em >= 0.35 THEN 'semántica' END, CASE WHEN ev THEN 'evento' END, CASE WHEN ti > 0 THEN 'fecha' END) AS reasons FROM r WHERE conf >= 0.22",
    "related_topk": f"{_six}, two AS (SELECT a AS note, b AS other, conf FROM r WHERE conf >= 0.22 UNION ALL SELECT b, a, conf FROM r WHERE conf >= 0.22) SELECT note, other, rank FROM (SELECT *, row_number() OVER (PARTITION BY note ORDER BY round(conf, 6) DESC, other) AS rank FROM two) WHERE rank <= 6",
    "concept_hits": f"{_hits} SELECT doc_id, cid, CAST(hits AS BIGINT) AS hits FROM h",
    "doc_event": f"{_hits}, {_event} SELECT doc_id, event FROM ev",
    "theme_tags": f"""{_hits}, root AS (SELECT cid, arg_max(ancestor, k) AS root FROM cl GROUP BY cid), x AS (SELECT doc_id, h.cid AS cid, hits, root FROM h JOIN root USING (cid) WHERE hits >= 2),
        y AS (SELECT doc_id, hits, cid, 1 AS o, 'tema/' || root AS tag FROM x UNION ALL SELECT doc_id, hits, cid, 2, 'tema/' || root || '/' || cid FROM x WHERE root <> cid),
        z AS (SELECT doc_id, tag, min((-hits, cid, o)) AS place FROM y GROUP BY ALL) SELECT doc_id, string_agg(tag, ' ' ORDER BY place) AS tags FROM z GROUP BY doc_id""",
    "title_weighted_stems": "WITH " + _tokens.replace("lower(text)", r"lower(source || '. ' || source || '. ' || source || '. ' || regexp_replace(text, '<!--\s*página\s+(\d+)\s*-->', ' ', 'g'))") + " SELECT doc_id, max(tf) AS most, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id",
    "keyword_forms": f"""WITH {_tokens}, best AS (SELECT doc_id, stem, row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 6) DESC, first_pos) AS rank FROM tw QUALIFY rank <= 8),
        sf AS (SELECT doc_id, stem, raw FROM (SELECT doc_id, stem, raw, row_number() OVER (PARTITION BY doc_id, stem ORDER BY count(*) DESC, min(pos)) AS r FROM tok GROUP BY doc_id, stem, raw) WHERE r = 1)
        SELECT doc_id, string_agg(raw, ' ' ORDER BY rank) AS keywords FROM (SELECT doc_id, raw, min(rank) AS rank FROM best JOIN sf USING (doc_id, stem) GROUP BY ALL) GROUP BY doc_id""",
    "profile_reuse": "WITH " + _tokens.replace("lower(text)", r"lower(source || '. ' || source || '. ' || source || '. ' || regexp_replace(text, '<!--\s*página\s+(\d+)\s*-->', ' ', 'g'))") + f", dates AS ({_date}), n AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id) SELECT 'n' || doc_id AS name, left(sha1(source || chr(0) || text), 16) AS content_hash, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, date, doc_id % 3 = 0 AS reused FROM documents LEFT JOIN n USING (doc_id) JOIN dates USING (doc_id) WHERE lang = 'es'",
    "enriched_front_matter": r"""SELECT 'n' || o_orderkey AS name, '---' || chr(10) || t || p || 'tags:' || chr(10) || '  - "' || o_orderstatus || '"' || chr(10) || '  - "tema/nuevo"' || chr(10) || d || '---' AS stamped,
        md5('---' || chr(10) || t || p || 'tags:' || chr(10) || '  - "' || o_orderstatus || '"' || chr(10) || '  - "tema/viejo"' || chr(10) || CASE WHEN o_orderstatus <> 'O' THEN '  - "O"' || chr(10) ELSE '' END || '  - "pdf-importado"' || chr(10) || d || 'aliases:' || chr(10) || '  - "' || o_orderpriority || '"' || chr(10) || '---') AS enriched_md5
        FROM (SELECT *, 'title: "' || o_orderpriority || '"' || chr(10) AS t, 'pages: "' || o_custkey % 4 || '"' || chr(10) AS p, 'date_processed: "' || strftime(o_orderdate, '%Y-%m-%d') || '"' || chr(10) AS d FROM orders)""",
    "index_page": "SELECT '- [[n' || o_orderkey || '|' || o_orderpriority || ']] — ' || CASE WHEN o_custkey % 4 > 0 THEN (o_custkey % 4) || ' pág. · ' ELSE '' END || 'procesado ' || strftime(o_orderdate, '%Y-%m-%d') AS line FROM orders WHERE o_orderkey % 5 <> 0",
    "index_records": """SELECT 'n' || o_orderkey AS note, md5('{"note":"n' || o_orderkey || '","title":"' || o_orderpriority || '","source":"s' || o_orderkey || '","pages":' || o_custkey % 4 || ',"ocr":null,"language":null,"date_processed":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}') AS json_md5 FROM orders WHERE o_orderkey % 5 <> 0""",
    "hub_pages": "SELECT c_mktsegment AS hub, count(*) AS n, md5('# ' || c_mktsegment || chr(10) || chr(10) || string_agg('- [[' || c_name || '|T' || c_nationkey || ']]', chr(10) ORDER BY lower('T' || c_nationkey), c_name) || chr(10)) AS text_md5 FROM customer GROUP BY c_mktsegment HAVING count(*) >= 2",
    "font_model": f"{_fonts} SELECT doc, size, CAST(chars AS BIGINT) AS chars, body, level FROM fonts",
    "line_info": f"{_fonts} SELECT doc, page, block, line, text, coalesce(size, 0) AS size, bold FROM info",
    "table_box_filter": f"{_layout} SELECT doc, page, count(*) AS n, CAST(sum(block) AS BIGINT) AS blocks FROM free GROUP BY ALL",
    "page_blocks": f"""{_layout}, whole AS (SELECT doc, page, block, max(y0) AS top, max(size) AS size, bool_or(bold) AS bold, list_filter(list(text ORDER BY line), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '') AS texts FROM info JOIN free USING (doc, page, block) GROUP BY ALL),
        j AS (SELECT *, {_joined.format("texts")} AS joined FROM whole WHERE len(texts) > 0),
        m AS (SELECT j.*, b.body, l.level FROM j JOIN (SELECT DISTINCT doc, body FROM fonts) b USING (doc) LEFT JOIN (SELECT doc, size, level FROM fonts WHERE level IS NOT NULL) l ON l.doc = j.doc AND l.size = j.size),
        k AS (SELECT *, CASE WHEN len(texts) <= 2 AND joined <> '' AND length(joined) <= 120 AND right(joined, 1) NOT IN ('.', ',', ';', ':') AND (level IS NOT NULL OR (bold AND size >= body AND length(joined) <= 60)) THEN 'heading'
            WHEN len(list_filter(texts, lambda x: NOT regexp_matches(x, '{X.BULLET}') AND NOT regexp_matches(x, '{X.ORDERED}'))) = 0 THEN 'list' ELSE 'paragraph' END AS type FROM m)
        SELECT doc, page, top, type, CASE WHEN type <> 'list' THEN joined END AS text, CASE WHEN type = 'heading' THEN coalesce(level, 3) END AS level,
        CASE WHEN type = 'list' THEN array_to_string(list_transform(texts, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '{X.BULLET}', ''), '{X.ORDERED}', ''), '^\\s+|\\s+$', '', 'g')), '|') END AS items, CASE WHEN type = 'list' THEN regexp_matches(texts[1], '{X.ORDERED}') END AS ordered FROM k""",
    "table_blocks": "SELECT s_suppkey % 20 AS doc, CAST(s_suppkey % 4 + 1 AS INTEGER) AS page, CAST(s_suppkey * 17 % 250 AS DOUBLE) AS top, s_name || '|a b' AS cells FROM supplier",
    "cleaned_blocks": r"""WITH l AS (SELECT source AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS seq FROM documents),
        s AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS st FROM l), e AS (SELECT doc, page, arg_min(st, seq) AS top, arg_max(st, seq) AS bottom FROM s GROUP BY ALL), p AS (SELECT doc, count(DISTINCT page) AS pages FROM s GROUP BY doc HAVING count(DISTINCT page) >= 3),
        n AS (SELECT doc, 1 AS which, top AS t, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT doc, 2, bottom, count(*) FROM e GROUP BY ALL), g AS (SELECT DISTINCT doc, t FROM n JOIN p USING (doc) WHERE length(t) BETWEEN 1 AND 80 AND n >= greatest(2, floor(pages * 0.6)))
        SELECT doc, count(*) AS n, CAST(sum(length(regexp_replace(st, '[ \x{a0}]+', ' ', 'g'))) AS BIGINT) AS chars FROM s WHERE st <> '' AND NOT EXISTS (SELECT 1 FROM g WHERE g.doc = s.doc AND g.t = s.st) GROUP BY doc""",
    "ocr_paragraphs": f"""{_ocr}, wl AS (SELECT doc, page, block, par, line, string_agg(text, ' ' ORDER BY word, text) AS text FROM w GROUP BY ALL), ll AS (SELECT doc, page, block, par, list(text ORDER BY line) AS texts FROM wl GROUP BY ALL),
        hh AS (SELECT doc, page, block, par, median(height) AS height FROM w GROUP BY ALL), bb AS (SELECT doc, page, arg_min(tall, (-n, place)) AS body FROM (SELECT doc, page, CAST(height AS INTEGER) AS tall, count(*) AS n, min((block, par, line, word)) AS place FROM w GROUP BY ALL) GROUP BY ALL),
        j AS (SELECT *, {_joined.format("texts")} AS joined FROM ll JOIN hh USING (doc, page, block, par) JOIN bb USING (doc, page)),
        k AS (SELECT *, CASE WHEN len(texts) = 1 AND body > 0 AND height > body * 1.25 AND length(joined) <= 80 AND right(joined, 1) NOT IN ('.', ',') THEN 'heading'
            WHEN len(list_filter(texts, lambda x: NOT regexp_matches(x, '{X.BULLET}') AND NOT regexp_matches(x, '{X.ORDERED}'))) = 0 THEN 'list' ELSE 'paragraph' END AS type FROM j WHERE joined <> '')
        SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY block, par) AS seq, type, md5(CASE WHEN type = 'list' THEN array_to_string(list_transform(texts, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '{X.BULLET}', ''), '{X.ORDERED}', ''), '^\\s+|\\s+$', '', 'g')), '|') ELSE joined END) AS text_md5,
        CASE WHEN type = 'heading' THEN CASE WHEN height > body * 1.6 THEN 1 ELSE 2 END END AS level FROM k""",
    "ocr_confidence": f"{_ocr} SELECT doc, page, round(avg(conf), 1) AS confidence, count(*) FILTER (conf < 60) AS n_low, CASE WHEN count(*) FILTER (conf < 60) > 0 THEN count(*) FILTER (conf < 60) || ' palabra(s) con baja confianza OCR (<60%). Ejemplos: ' || array_to_string((list(text ORDER BY block, par, line, word, text) FILTER (conf < 60))[1:15], ', ') END AS warning FROM w GROUP BY ALL",
    "ocr_documents": f"{_ocr} SELECT doc, count(*) AS ocr_pages, round(avg(c), 1) AS ocr_confidence FROM (SELECT doc, page, round(avg(conf), 1) AS c FROM w GROUP BY ALL) GROUP BY doc",
    "tokens_per_doc": f"WITH {_tokens} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT stem) AS n_stems FROM tok GROUP BY doc_id",
    "stem_counts": f"WITH {_tokens} SELECT stem, count(*) AS n FROM tok GROUP BY stem",
    "term_df_idf": f"WITH {_tokens} SELECT stem, df, round(idf, 6) AS idf FROM idf",
    "doc_keywords_top8": f"WITH {_tokens} SELECT doc_id, rank, stem, round(tfidf, 4) AS tfidf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 6) DESC, first_pos) AS rank FROM tw) WHERE rank <= 8",
    "surface_forms": f"WITH {_tokens} SELECT doc_id, stem, raw FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, stem ORDER BY n DESC, p) AS r FROM (SELECT doc_id, stem, raw, count(*) AS n, min(pos) AS p FROM tok GROUP BY ALL)) WHERE r = 1",
    "content_hash": "SELECT doc_id, left(sha1(text), 16) AS hash FROM documents",
    "page_kind": r"SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 100 THEN 'text' ELSE 'ocr' END AS kind FROM documents",
    "clean_text": r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(text, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '[\x00-\x09\x0b-\x1f\x7f-\x9f\p{Cf}\p{Co}]', '', 'g'), '[ \x{a0}]+', ' ', 'g'), '^[\s\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')) AS clean_md5 FROM documents",
    "slugs": r"""SELECT p_partkey, coalesce(nullif(trim(regexp_replace(translate(lower(p_name), 'áéíóúñü', 'aeiounu'), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'x') AS tag,
        coalesce(nullif(rtrim(left(trim(regexp_replace(regexp_replace(p_name, '[\\/:*?"<>|#^\[\]]', ' ', 'g'), '\s+', ' ', 'g'), ' .'), 120), ' .'), ''), 'documento') AS file,
        '[[' || p_name || CASE WHEN trim(regexp_replace(coalesce(p_type, ''), '[\[\]|]', ' ', 'g')) IN ('', p_name) THEN '' ELSE '|' || trim(regexp_replace(p_type, '[\[\]|]', ' ', 'g')) END || ']]' AS link,
        '| ' || replace(p_name, '|', '\|') || ' | ' || replace(p_brand, '|', '\|') || ' |' AS row FROM part""",
    "ancestor_closure": f"{_closure} SELECT cid, ancestor, CAST(k AS BIGINT) AS k FROM cl",
    "concept_vectors": f"""{_closure}, {_tokens}, terms(cid, n, term) AS (VALUES {", ".join(str(t) for t in TERMS)}),
        g0 AS (SELECT doc_id, stem, lead(stem, 1) OVER o AS s2, lead(stem, 2) OVER o AS s3 FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
        g AS (SELECT doc_id, 1 AS n, stem AS term FROM g0 UNION ALL SELECT doc_id, 2, stem || ' ' || s2 FROM g0 WHERE s2 IS NOT NULL UNION ALL SELECT doc_id, 3, stem || ' ' || s2 || ' ' || s3 FROM g0 WHERE s3 IS NOT NULL),
        h AS (SELECT doc_id, cid, sum(terms.n) AS hits FROM g JOIN terms ON g.n = terms.n AND g.term = terms.term GROUP BY ALL)
        SELECT doc_id, ancestor AS cid, round(sum(CAST(hits AS DOUBLE) * pow(0.5, k)), 6) AS weight FROM h JOIN cl ON h.cid = cl.cid GROUP BY ALL""",
    "near_dup_links": f"{_pairs} SELECT a, b, round(cosine, 4) AS cosine FROM p",
    "embedding_topk": "SELECT query, vec_id, round(cosine, 5) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(cosine, 6) DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query, v.vec_id AS vec_id, greatest(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 0.0) AS cosine FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 10",
    "temporal_proximity": "SELECT o_orderkey, round(coalesce(greatest(0.0, 1 - abs(date_diff('day', CAST(p AS DATE), CAST(o_orderdate AS DATE))) / 21.0), 0.0), 6) AS score FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)",
    "publish_skip": "SELECT doc_id, 'ok' AS status FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "organise_counts": "SELECT CASE lang WHEN 'en' THEN 'PDF' WHEN 'es' THEN 'Word' WHEN 'fr' THEN 'Excel' ELSE 'Otros' END AS grupo, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1",
    "running_lines": r"""WITH l AS (SELECT source AS doc, doc_id AS page, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc, page, l[1] AS line FROM l UNION SELECT doc, page, l[-1] FROM l),
        n AS (SELECT doc, line, count(DISTINCT page) AS n FROM e WHERE length(line) BETWEEN 1 AND 80 GROUP BY ALL), p AS (SELECT source AS doc, count(*) AS pages FROM documents GROUP BY 1 HAVING count(*) >= 3)
        SELECT doc, line, n FROM n JOIN p USING (doc) WHERE n >= greatest(2, floor(pages * 0.05))""",
    "watch_stability": "SELECT user_id, event_id, size FROM (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS size, lag(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE size > 0 AND size = p",
}
