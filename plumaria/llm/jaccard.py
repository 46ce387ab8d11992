r"""N-gram Jaccard join by chosen paths (Christiani and Pagh, 2017; CPSJoin, 2018).

A document is the set of its 5-word shingles (case-folded words); links are pairs of documents whose sets have a Jaccard similarity of 0.8 or more.

1. Documents with equal sets are one node, found by an aggregate on a 128-bit hash of the set; its least doc_id names it.
2. Each of `runs` runs sends a node down a path: a coordinate of its min-wise sample, chosen by the path so far, extends the path by the token sampled there.
   Paths of one node end; buckets of at most `limit` nodes are compared by brute force; larger ones are split again, up to `depth` times. What is larger
   even then is compared by brute force in pairs of blocks, spread over tasks, so that nothing is left out.
3. Two nodes of similarity 0.8 stay together in a run with probability 0.8 for each level, so `runs` = 8 miss a pair with probability 0.2^8 at one level
   and under 0.004 at three: recall above 0.99 at any depth.
4. A pair is counted in the first run whose bucket holds it, which both members' paths tell. Pairs never leave a task: a bucket returns each node's
   number of links and one edge to the least node it is connected with there. Classes are the connected components of these edges.

Defined cases: a text of 1 to 4 words has one shingle, all its words; texts without words (null, empty) and rows with a null doc_id have no links and form
classes of their own; ids of another type than integers raise a TypeError; rows that repeat a doc_id are one document with several texts; links count documents, copies included, without the document itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumaria.llm.common import SIMILARITY, arrow_parts, arrow_rows, components, mixed, overlaps, shingles, spare, utf8, whole_groups, with_long_ids, written

SAMPLES = 48


def sampled_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, s1, s2, sample): a 128-bit hash of the set, null without words, and SAMPLES min-wise sampled tokens."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        seeds = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
        for batch, texts in arrow_parts(batches):
            tokens, first = shingles(texts)
            full = np.flatnonzero(np.diff(first))
            sample = np.zeros((len(texts), SAMPLES), np.int32)
            if len(full):
                for k, seed in enumerate(seeds):
                    h = (tokens ^ seed) * seed
                    sample[full, k] = np.minimum.reduceat(((h ^ (h >> np.uint64(29))) * seeds[0]) >> np.uint64(32), first[full]).astype(np.uint32).view(np.int32)
            digests = [xxhash.xxh3_128_digest(np.unique(tokens[a:b]).tobytes()) if b > a else None for a, b in zip(first, first[1:], strict=False)]
            both = np.frombuffer(b"".join(d or bytes(16) for d in digests), np.int64).reshape(-1, 2)
            none = np.array([d is None for d in digests], bool)
            yield arrow_rows({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "s1": pa.array(both[:, 0], mask=none), "s2": pa.array(both[:, 1], mask=none),
                "sample": pa.ListArray.from_arrays(np.arange(0, SAMPLES * len(texts) + 1, SAMPLES, dtype=np.int32), sample.ravel()),
            })

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, s1 long, s2 long, sample array<int>")


def bucket_links(sets: list[np.ndarray], copies: np.ndarray, skip: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node within a bucket, and the least index it is connected with. skip: pairs that an earlier run has; side: of a pair of blocks, or -1."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    inter = overlaps(sets)
    linked = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-3
    linked &= ~skip
    linked &= (side[:, None] != side[None, :]) | (side[:, None] < 0)
    np.fill_diagonal(linked, False)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(1))
        if (new == label).all():
            return linked @ copies, label
        label = new


def near_duplicates(docs: DataFrame, runs: int = 8, limit: int = 256, depth: int = 3, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, class_id, n_links), a row for each row of docs; class_id is the least doc_id of the class."""
    docs = with_long_ids(docs.select("doc_id", "text"))
    sets = written(sampled_sets(docs), "sets")
    real = sets.where("s1 is not null and doc_id is not null")
    nodes = real.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "text_hash")).alias("name"), F.countDistinct("doc_id").alias("copies"), F.max("sample").alias("sample"))
    nodes = written(nodes.select("s1", "s2", F.col("name.doc_id").alias("node"), F.col("name.text_hash").alias("text_hash"), "copies", "sample"), "nodes")

    # One path a run; those that end alone go at once.
    start = F.array(*[F.xxhash64(F.lit(r), F.element_at("sample", r + 1)) for r in range(runs)])
    paths = nodes.select("node", "s1", "s2", F.posexplode(start).alias("run", "path"))
    live, done = _shared(paths), []
    for level in range(2, depth + 1):
        live = written(live, "paths")
        done.append(live.where(F.col("n") <= limit))
        live = live.where(F.col("n") > limit).drop("n")
        if live.isEmpty():
            break
        at = F.pmod(F.xxhash64("path", F.lit(level)), F.lit(SAMPLES)).cast("int") + 1
        live = live.join(nodes.select("s1", "s2", "sample"), ["s1", "s2"]).select("node", "s1", "s2", "run", F.xxhash64("path", F.element_at("sample", at)).alias("path"))
        live = _shared(live)
    else:
        done.append(live)
    ends = done[0]
    for more in done[1:]:
        ends = ends.unionByName(more)

    # Each node once with all its ends, then its text, then a row for each bucket or pair of blocks it is in.
    ends = ends.groupBy("s1", "s2").agg(F.collect_list(F.struct("run", "path", "n")).alias("ends"))
    ends = ends.join(nodes.select("s1", "s2", "node", "text_hash", "copies"), ["s1", "s2"]).select(F.col("node").alias("doc_id"), "text_hash", "copies", "ends")
    texts = docs.withColumn("text_hash", F.xxhash64("text")).join(ends, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    blocks = F.ceil(F.col("end.n") / (2 * limit)).cast("int")
    rows = texts.select("doc_id", "text_hash", "text", "copies", "ends", F.explode("ends").alias("end"))
    rows = rows.withColumn("blocks", F.when(F.col("end.n") > limit, blocks).otherwise(1)).withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        F.xxhash64("end.run", "end.path", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"), F.col("end.run").alias("run"), F.when(F.col("block") == F.col("other"), -1).otherwise((F.col("block") < F.col("other")).cast("int")).alias("side"),
        "doc_id", "copies", F.transform(F.array(*[F.lit(r) for r in range(runs)]), lambda r: F.aggregate("ends", F.lit(0).cast("long"), lambda s, e: F.when(e["run"] == r, e["path"]).otherwise(s))).alias("all_paths"), "text",
    )
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "doc_id")

    def compare(batches):
        for group in map(_columns, whole_groups(batches, "bucket", ["text"])):
            tokens, first = shingles(group["text"])
            cuts = np.flatnonzero(np.append(True, group["bucket"][1:] != group["bucket"][:-1]))
            out = []
            for a, b in zip(cuts, np.append(cuts[1:], len(group["bucket"])), strict=True):
                if b - a < 2:
                    continue
                of = slice(a, b)
                own, run = group["paths"][of], int(group["run"][a])
                skip = np.zeros((b - a, b - a), bool)
                for r in range(run):
                    skip |= (own[:, None, r] == own[None, :, r]) & (own[:, None, r] != 0)
                links, label = bucket_links([np.unique(tokens[first[i] : first[i + 1]]) for i in range(a, b)], group["copies"][of], skip, group["side"][of], threshold)
                ids = group["doc_id"][of]
                out += [(ids[i], ids[label[i]], links[i]) for i in np.flatnonzero(links)]
            yield arrow_rows({c: np.array([o[k] for o in out], np.int64) for k, c in enumerate(("a", "b", "links"))})

    found = written(rows.mapInArrow(compare, "a long, b long, links long"), "links")
    roots = components(found.select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    named = nodes.join(counts, nodes.node == counts.a, "left").join(roots, nodes.node == roots.id, "left")
    named = named.select("s1", "s2", F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    out = sets.select("doc_id", "text_hash", F.when(F.col("doc_id").isNotNull(), F.col("s1")).alias("s1"), "s2").join(named, ["s1", "s2"], "left")
    return out.select("doc_id", "text_hash", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _shared(paths: DataFrame) -> DataFrame:
    """paths that two nodes or more share, with n, how many. The counts are a table of their own, so that the rows of a path that many share are split at run time."""
    n = written(paths.groupBy("run", "path").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    return paths.join(n, ["run", "path"])


def _columns(rows) -> dict:
    return {c: rows.column(c).to_numpy() for c in ("bucket", "run", "side", "doc_id", "copies")} | {"paths": rows.column("all_paths").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1), "text": utf8(rows.column("text"))}


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each class: that of the least doc_id. Rows with a null doc_id stay; of rows that repeat their doc_id and text one stays."""
    found = near_duplicates(docs, **how)
    gone = found.where("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if found.where("doc_id is not null").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        return kept
    rank, columns = spare(docs.columns, "rank"), [F.col(f"`{c}`") for c in docs.columns]
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*columns))
    return kept.withColumn(rank, F.when(F.col("doc_id").isNull(), 1).otherwise(F.row_number().over(order))).where(F.col(rank) == 1).select(*columns)
