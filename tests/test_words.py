"""What is counted within notes, against the words one by one."""

from collections import Counter

from pyspark.sql import functions as F

from plumaria.functions import text as X
from plumaria.operators import entities as E
from plumaria.operators import relate as R

NOTES = "doc_id long, text string"
ROWS = [(1, "Canciones, canción y canciones; Luces luz LUCES İstanbul Kilos pingüino AÑOS señales"), (2, None), (3, ""), (4, "de la que"), (None, "acta del acta"), (5, "aaamiento miento relojes reloj clases crisis\ntesis ﬁn ﬁno ayudadoras ayudadora nación naciones")]


def shuffled(df):
    """Exchanges by hash of df's plan."""
    return str(df._jdf.queryExecution().executedPlan().toString()).count("hashpartitioning")


def words(spark, rows):
    """The words as expressions of columns have them: (doc_id, pos, raw, stem)."""
    return spark.createDataFrame(rows, NOTES).select("doc_id", F.inline(X.stems(F.col("text")))).collect()


def test_terms_equal_the_words(spark):
    for rows in (ROWS, [*ROWS, (1, "luz canción canción")]):  # also where a doc_id has several rows
        told = {}
        for r in words(spark, rows):
            told.setdefault((r["doc_id"], r["stem"]), []).append((r["pos"], r["raw"]))
        got = {(r["doc_id"], r["stem"]): r for r in R.note_terms(spark.createDataFrame(rows, NOTES)).collect()}
        assert got.keys() == told.keys() and len(got) > 15
        for key, seen in told.items():
            n = Counter(raw for _, raw in seen)
            best = min(n, key=lambda raw: (-n[raw], min(p for p, x in seen if x == raw)))
            assert (got[key]["tf"], got[key]["first_pos"], got[key]["raw"]) == (len(seen), min(seen)[0], best)


def test_words_are_not_shuffled(spark, small):
    from plumaria.plans import queries as Q

    assert shuffled(Q.surface_forms(spark, small)) == 0
    plan = Q.concept_hits(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
    assert shuffled(Q.doc_event(spark, small)) <= 2 and "Window" not in Q.doc_event(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert shuffled(Q.keyword_forms(spark, small)) <= 4


def test_matches_of_more_terms_than_go_to_all_tasks(spark, monkeypatch):
    notes = spark.createDataFrame(ROWS, NOTES)
    terms = spark.createDataFrame([("a", 1, "cancion"), ("a", 2, "luz luz"), ("b", 1, "luz"), ("b", 3, "cancion cancion cancion"), ("c", 1, "acta")], "cid string, n int, term string")
    events = terms.select(F.col("cid").alias("event"), F.lit(0).alias("ord"), "n", "term")
    told = lambda: sorted(map(repr, [*R.concept_hits(notes, terms).collect(), *E.events(notes, events).collect()]))
    few = told()
    monkeypatch.setattr(R, "WANTED", 1)
    assert told() == few
    assert [tuple(r) for r in R.concept_hits(notes, terms).orderBy("doc_id", "cid").collect()] == [(None, "c", 2), (1, "a", 7), (1, "b", 6)]


def test_pairs_are_scored_in_blocks(spark):
    from plumaria.operators import confidence as C

    rows = [(d, k, 0.5 if k < 9 else 0.1, 40) for d in range(40) for k in {d % 3, 3 + d % 5, 9 + d % 7, 20}]
    w = spark.createDataFrame(rows, "doc_id long, key long, w double, df long")
    notes = spark.createDataFrame([(d, "e" if d % 2 else None) for d in range(40)], "doc_id long, event string").withColumn("date", F.lit(None).cast("date"))
    told = lambda df: sorted((r["a"], r["b"], round(r["confidence"], 9), tuple(r["reasons"])) for r in df.collect())
    whole, parts = C.pair_confidence(w, None, None, notes, least=0.1, rows=40), C.pair_confidence(w, None, None, notes, least=0.1, rows=7)
    assert shuffled(parts) == 1  # pairs are not shuffled, only blocks of notes
    assert told(whole) == told(parts) and len(told(whole)) > 50
    ranked = lambda df: sorted(map(tuple, R.top_neighbours(df.withColumnRenamed("confidence", "score"), 3).select("note", "other", "rank").collect()))
    assert ranked(C.pair_confidence(w, None, None, notes, least=0.1, rows=7, best=3)) == ranked(whole)
