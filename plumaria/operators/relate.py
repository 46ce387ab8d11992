"""Terms, weights, concepts and relations of notes (doc_id, text), as relational plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumaria.operators import words as W
from plumaria.storage import stored

QUERY_BLOCK = 2048
#: Terms of a lexicon that go to all tasks; with more, matches are joined.
WANTED = 200_000


def note_terms(notes: DataFrame) -> DataFrame:
    """(doc_id, stem, tf, first_pos, raw) of (doc_id, text): no stopwords, no stems under three letters; raw is the most frequent form, the earliest of equals."""
    if not W.repeated(notes):
        return W.by_note(notes, W.terms, "stem string, tf bigint, first_pos int, raw string")
    rows = W.by_note(notes, W.forms, "stem string, raw string, n bigint, pos int").groupBy("doc_id", "stem", "raw").agg(F.sum("n").alias("n"), F.min("pos").alias("p"))
    return rows.groupBy("doc_id", "stem").agg(F.sum("n").alias("tf"), F.min("p").alias("first_pos"), F.max_by("raw", F.struct(F.col("n"), -F.col("p"))).alias("raw"))


def idf(counts: DataFrame, n_notes: int) -> DataFrame:
    return counts.groupBy("stem").agg(F.count("*").alias("df")).withColumn("idf", F.log((1.0 + n_notes) / (1.0 + F.col("df"))) + 1.0)


def weights(notes: DataFrame) -> DataFrame:
    """(doc_id, stem, tf, first_pos, raw, tfidf, w): w has unit norm in each note."""
    # Counted once for both of its uses. The number of notes is one row; idf has a row for each term, so that join is by term and never a broadcast of the vocabulary.
    return weighted(stored(note_terms(notes), "counts"), notes.count())


def weighted(counts: DataFrame, n_notes: int) -> DataFrame:
    """(doc_id, stem, tf, first_pos, df, idf, tfidf, w) of counts (doc_id, stem, tf, first_pos), and what else they have."""
    rows = counts.join(idf(counts, n_notes), "stem").withColumn("tfidf", (1 + F.log("tf")) * F.col("idf"))
    return rows.withColumn("w", F.col("tfidf") / F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf")).over(Window.partitionBy("doc_id"))))


def keywords(notes: DataFrame, k: int = 8) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.round("tfidf", 6).desc(), "first_pos")
    return weights(notes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ancestors(concepts: DataFrame, depth: int = 32) -> DataFrame:
    """(cid, ancestor, k) of a forest (cid, parent), k = 0 for itself. Stops at roots and, with cycles, at `depth`."""
    level = concepts.select("cid", F.col("cid").alias("ancestor"), F.lit(0).alias("k"))
    out, parents = [level], concepts.select(F.col("cid").alias("ancestor"), "parent").where("parent is not null")
    for k in range(1, depth):
        level = level.join(parents, "ancestor").where("parent <> cid").select("cid", F.col("parent").alias("ancestor"), F.lit(k).alias("k"))
        if level.isEmpty():
            break
        out.append(level)
    return reduce(DataFrame.unionByName, out).groupBy("cid", "ancestor").agg(F.min("k").alias("k"))


def matches(notes: DataFrame, terms: DataFrame, longest: int) -> DataFrame:
    """terms (n, term, …) that occur in notes (doc_id, text), with doc_id and count. What a lexicon of up to `WANTED` terms does not have is passed over where the text is read."""
    held = terms.select("n", "term").distinct().limit(WANTED + 1).collect()
    wanted = frozenset((r["n"], r["term"]) for r in held) if len(held) <= WANTED else None
    rows = W.by_note(notes, W.grams(longest, wanted), "n int, term string, count bigint")
    return rows.join(terms if wanted is None else F.broadcast(terms), ["n", "term"])


def concept_hits(notes: DataFrame, terms: DataFrame, longest: int = 3) -> DataFrame:
    """(doc_id, cid, hits): matches of terms (cid, n, term), each weighing its number of words. Words of a phrase also count alone."""
    return matches(notes, terms, longest).groupBy("doc_id", "cid").agg(F.sum(F.col("n") * F.col("count")).cast("long").alias("hits"))


def concept_vectors(hits: DataFrame, closure: DataFrame, alpha: float = 0.5) -> DataFrame:
    return hits.join(closure, "cid").groupBy("doc_id", F.col("ancestor").alias("cid")).agg(F.sum(F.col("hits") * F.pow(F.lit(alpha), F.col("k"))).alias("weight"))


def prefix_pairs(w: DataFrame, bound: float) -> DataFrame:
    """(a, b), a < b: a superset of the pairs with cosine >= bound of unit vectors (doc_id, key, w, df).

    Keys of the most frequent first are left out while the norm of what is left out stays under the bound, so only rarer ones are joined. What two notes share beyond the keys that met comes before
    the first of these, and before the first that one of them keeps: at most the norm that one leaves out times the other's up to the first that met. Pairs whose sum stays under the bound even with that are not passed on.
    """
    order = Window.partitionBy("doc_id").orderBy(F.col("df").desc(), "key")
    kept = w.where("df > 1").withColumn("norm2", F.sum(F.col("w") * F.col("w")).over(order)).where(F.sqrt("norm2") >= bound - 1e-9)
    kept = kept.withColumn("before", F.sqrt(F.greatest(F.col("norm2") - F.col("w") * F.col("w"), F.lit(0.0)))).withColumn("out", F.min("before").over(Window.partitionBy("doc_id")))
    side = lambda x: kept.select(F.col("doc_id").alias(x), "key", *[F.col(c).alias(f"{x}_{c}") for c in ("w", "before", "out")])
    met = side("a").join(side("b"), "key").where("a < b").groupBy("a", "b")
    met = met.agg(F.sum(F.col("a_w") * F.col("b_w")).alias("met"), *[F.min(c).alias(c) for c in ("a_before", "b_before", "a_out", "b_out")])
    more = F.greatest(F.col("a_out") * F.col("b_before"), F.col("b_out") * F.col("a_before"))
    return met.where(F.col("met") + more >= bound - 1e-9).select("a", "b")


def text_pairs(notes: DataFrame, bound: float = 0.8) -> DataFrame:
    """(a, b, cosine) of pairs with TF-IDF cosine >= bound: candidates by prefix filtering, scored in full."""
    w = stored(weights(notes).where("df > 1").select("doc_id", F.col("stem").alias("key"), "w", "df"), "weights")  # other terms are in no product
    pairs = stored(prefix_pairs(w, bound), "pairs")
    left = pairs.join(w.select(F.col("doc_id").alias("a"), "key", F.col("w").alias("wa")), "a")
    both = left.join(w.select(F.col("doc_id").alias("b"), "key", F.col("w").alias("wb")), ["b", "key"])
    return both.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")).where(F.col("cosine") >= bound)


def top_neighbours(pairs: DataFrame, k: int = 6, ties="other", more: list[str] = []) -> DataFrame:  # noqa: B006
    """(note, other, score, more…, rank): both directions of (a, b, score, more…), each note's k best; equal scores by `ties`."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("note"), F.col("b").alias("other"), "score", *more), F.struct(F.col("b").alias("note"), F.col("a").alias("other"), "score", *more))).alias("e")).select("e.*")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("note").orderBy(F.round("score", 6).desc(), ties))).where(F.col("rank") <= k)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, vec_id, cosine, rank): the k nearest of unit vectors (vec_id, embedding), exactly; negative cosines count as 0.

    queries is a stated set: it meets all rows in blocks of `QUERY_BLOCK`, each of which goes to all tasks, so what is sent has that bound. A task multiplies its batch with a block at once and passes
    on each query's k best, so what is shuffled grows with the number of batches, not of rows.
    """
    wide = queries.select(F.col("vec_id").alias("query"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    kind, spark, found, held = dict(vectors.dtypes)["vec_id"], vectors.sparkSession, [], []

    def block(rows):
        import numpy as np

        sent = spark.sparkContext.broadcast((np.array([r["query"] for r in rows]), np.array([r["q"] for r in rows], float)))

        def best(batches):
            import pyarrow as pa

            ids, q = sent.value
            for batch in batches:
                own = batch.column("vec_id")
                v = batch.column("embedding")
                if not len(own):
                    continue
                m = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1)
                # A sum of equal order for any batch and block: elementwise, not by a matrix product that may round otherwise.
                names = own.to_numpy(zero_copy_only=False)
                top = min(k + 1, len(names))
                out = []
                for i in range(len(ids)):
                    c = np.maximum((m * q[i]).cumsum(1)[:, -1], 0.0)
                    order = np.lexsort((names, -np.round(c, 6)))[:top]
                    order = order[names[order] != ids[i]][:k]
                    out.append(pa.table({"query": pa.array([ids[i]] * len(order), own.type), "vec_id": own.take(pa.array(order)), "cosine": c[order]}))
                yield from pa.concat_tables(out).combine_chunks().to_batches()

        return vectors.select("vec_id", "embedding").mapInArrow(best, f"query {kind}, vec_id {kind}, cosine double")

    for row in wide.toLocalIterator():
        held.append(row)
        if len(held) == QUERY_BLOCK:
            found.append(block(held))
            held = []
    if held or not found:
        found.append(block(held) if held else vectors.limit(0).selectExpr("vec_id AS query", "vec_id", "0D AS cosine"))
    order = Window.partitionBy("query").orderBy(F.round("cosine", 6).desc(), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def running_lines(lines: DataFrame, share: float = 0.6, least_pages: int = 3, longest: int = 80) -> DataFrame:
    """(doc, line, n): first or last lines (doc, page, first, last) that recur on the threshold's number of pages."""
    pages = lines.groupBy("doc").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    ends = lines.select("doc", "page", F.explode(F.array_distinct(F.array("first", "last"))).alias("line")).where(F.length("line").between(1, longest))
    n = ends.groupBy("doc", "line").agg(F.countDistinct("page").alias("n")).join(pages, "doc")
    return n.where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share))).select("doc", "line", "n")
