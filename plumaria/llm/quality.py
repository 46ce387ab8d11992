r"""Quality rules, and an isolation forest on their statistics.

Statistics of each text: words (runs outside ``[\x20\x09-\x0D]``), their code points, symbols of ``#*$%&|<>``, lines with a word
that equal an earlier line, and word positions inside 3-word windows that occur twice or more. A text fails the base
rules with fewer than 50 words or more than half of its words in repeated windows.

The forest (after Liu, Ting, Zhou, 2008) learns what normal documents look like from all labelled rows of quality 1: each tree splits
the box of all labelled rows at random features and values, and each node weighs all normal rows in it; its share of them, times 256, stands for the number that a draw of 256 would have there.
A document whose mean path is short is an anomaly. One labelled row in five (by a checksum of its id) grows no tree: the threshold on the anomaly
score is the one with the best balanced accuracy over all these, or over all where they lack a quality. Labelled rows stay in a table: the driver has the box, counts by leaf and sums by
score, whose number does not grow with them.

Defined cases: a null or empty text has no words and fails; repeated doc_ids each give their row; ids with contradicting
labels count as quality 0; null labels are ignored; without labelled documents of both qualities that pass the base rules (an empty table included) these
alone decide; other columns are ignored. Arrow batches are split by text length, so a long text costs its own size.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumaria.llm.common import WordIds, arrow_parts, arrow_rows, id_type, word_ids, written

SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_lines")
SPACES = tuple(b"\t\n\v\f\r ")
UPPER = np.array([chr(c).isupper() if c < 128 else False for c in range(256)])
WORD_LIMIT = 1 << 20


def repeated_windows(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each text, the word positions within 3-word windows that it holds twice or more."""
    n = len(ids)
    inside = np.zeros(n, bool)
    if n >= 3:
        of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        at = np.flatnonzero(of[:-2] == of[2:])
        _, pair = np.unique(ids[at] * (int(ids.max()) + 1) + ids[at + 1], return_inverse=True)
        _, window = np.unique(pair * (int(ids.max()) + 1) + ids[at + 2], return_inverse=True)
        if len(at):
            _, back, count = np.unique(of[at] * (int(window.max()) + 1) + window, return_inverse=True, return_counts=True)
            twice = at[count[back] > 1]
            for k in range(3):
                inside[twice + k] = True
    total = np.concatenate([[0], np.cumsum(inside)])
    return total[starts[1:]] - total[starts[:-1]]


def text_stats(texts: list[bytes], words: WordIds) -> np.ndarray:
    """A row for each text: STATS, then MORE."""
    ids, starts = word_ids(texts, words)
    out = np.zeros((len(texts), len(STATS) + len(MORE)), np.int64)
    out[:, 0], out[:, 4] = np.diff(starts), repeated_windows(ids, starts)
    for i, text in enumerate(texts):
        raw = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        chars = int(raw.sum() - raw[128:192].sum())
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[i, 1] = chars - sum(int(raw[c]) for c in SPACES)
        out[i, 2] = sum(int(raw[ord(c)]) for c in SYMBOLS)
        out[i, 3] = len(lines) - len(set(lines))
        out[i, 5:] = raw[UPPER].sum(), len(lines)
    return out


def features(stats: np.ndarray) -> np.ndarray:
    """Of the rules' statistics, what does not grow with a text's length; roots spread values near 0, where most are."""
    words, chars, symbols, dup, repeat, upper, lines = stats.T.astype(float)
    w = np.maximum(words, 1)
    return np.stack([np.sqrt(symbols / w), np.sqrt(dup / np.maximum(lines, 1)), np.sqrt(repeat / w), np.sqrt(upper / w), chars / w], 1)


class Forest:
    """Isolation trees over the box of all labelled rows, as arrays; path lengths of many rows at once.

    Splits are drawn from a node's box, not from the normal rows in it, so that a region without any is cut off early.
    """

    def __init__(self, box: tuple[np.ndarray, np.ndarray], trees: int = 128, size: int = 256, depth: int = 10, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size, self.depth = size, depth
        self.feature, self.cut = np.full((trees, 2 << depth), -1, np.int16), np.zeros((trees, 2 << depth))
        self.length = np.zeros((trees, 2 << depth))
        can = np.flatnonzero(box[1] > box[0])
        low, high = (np.broadcast_to(x, (trees, 1, len(x))) for x in box)
        for level in range(depth if len(can) else 0):
            f = can[rng.integers(0, len(can), (trees, 1 << level))]
            since, to = (np.take_along_axis(x, f[..., None], 2)[..., 0] for x in (low, high))
            cut = since + (to - since) * rng.random(f.shape)
            self.feature[:, 1 << level : 2 << level], self.cut[:, 1 << level : 2 << level] = f, cut
            halves = [np.repeat(x, 2, 1) for x in (low, high)]
            for k, half in enumerate(halves):  # the left child's box ends at the cut, the right one's begins there
                np.put_along_axis(half[:, 1 - k :: 2], f[..., None], cut[..., None], 2)
            low, high = halves

    def nodes(self, rows: np.ndarray):
        """Of each tree, the node where each row ends."""
        every = np.arange(len(rows))
        for feature, cut in zip(self.feature, self.cut, strict=True):
            node = np.ones(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + (rows[every, f] >= cut[node]))
            yield node

    def counts(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(node, minlength=self.feature.shape[1]) for node in self.nodes(rows)])

    def weigh(self, counts: np.ndarray, n: int) -> Forest:
        """Sets path lengths by how many of the n normal rows end in each node; nodes with fewer than two rows in a draw are not split."""
        self.size = min(self.size, n)
        weight = counts.astype(float)
        for level in range(self.depth - 1, -1, -1):
            weight[:, 1 << level : 2 << level] += weight[:, 2 << level : 4 << level].reshape(len(weight), -1, 2).sum(2)
        weight *= self.size / n
        level = np.log2(np.maximum(np.arange(weight.shape[1]), 1)).astype(int)
        every = np.arange(self.size + 1)
        self.length = level + np.interp(weight, every, [self.rest(k) for k in every])
        self.feature[weight < 2] = -1
        return self

    @staticmethod
    def rest(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores, 0 to 1: high for short paths."""
        total = np.zeros(len(rows))
        for node, length in zip(self.nodes(rows), self.length, strict=True):
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / max(self.rest(self.size), 1e-9))


def calibrated(scores: DataFrame) -> float:
    """The threshold above which rows (score, good boolean) are anomalies, by balanced accuracy; ties go to the highest, which keeps more.

    Sums run within buckets of scores, of which the driver has the totals.
    """
    good = F.col("good").cast("long")
    each = written(scores.groupBy("score").agg(F.sum(good).alias("g"), F.sum(1 - good).alias("b")).withColumn("bucket", F.floor(F.col("score") * 4096)), "scores")
    totals = sorted(map(tuple, each.groupBy("bucket").agg(F.sum("g"), F.sum("b")).collect()))
    ends = np.cumsum([t[1:] for t in totals], 0).tolist()
    before = each.sparkSession.createDataFrame([(k, e[0] - g, e[1] - b) for (k, g, b), e in zip(totals, ends, strict=True)], "bucket long, g0 long, b0 long")
    so_far = Window.partitionBy("bucket").orderBy("score")
    value = (F.col("g0") + F.sum("g").over(so_far)) / F.lit(float(ends[-1][0])) - (F.col("b0") + F.sum("b").over(so_far)) / F.lit(float(ends[-1][1]))
    best = each.join(F.broadcast(before), "bucket").select("score", value.alias("value")).agg(F.max(F.struct("value", "score")).alias("x")).first()["x"]["score"]
    after = each.where(F.col("score") > best).agg(F.min("score")).first()[0]
    return (best + (best if after is None else after)) / 2


def stats_of(docs: DataFrame) -> DataFrame:
    names = (*STATS, *MORE)

    def run(batches):
        words = WordIds()
        for batch, texts in arrow_parts(batches):
            stats = text_stats(texts, words)
            words.cut(WORD_LIMIT)
            yield arrow_rows({"doc_id": batch.column("doc_id")} | {n: stats[:, i] for i, n in enumerate(names)})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, " + ", ".join(f"{n} long" for n in names))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fitted(stats: DataFrame, labels: DataFrame) -> tuple[Forest, float] | None:
    """The forest and its threshold from the statistics of all labelled documents."""
    given = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    names = [*STATS, *MORE]
    # The least statistics of an id stand for its rows.
    found = stats.where(~base_failed()).groupBy("doc_id").agg(F.min(F.struct(*names)).alias("s")).join(given, "doc_id")
    found = written(found.select("s.*", "good", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).alias("apart")), "labelled")
    n = {(r["good"], r["apart"]): r["n"] for r in found.groupBy("good", "apart").agg(F.count("*").alias("n")).collect()}
    if len({good for good, _ in n}) < 2:
        return None
    if not all(n.get(k) for k in ((True, True), (False, True), (True, False))):
        grows, judges = F.col("good"), F.lit(True)
    else:
        grows, judges = F.expr("good and not apart"), F.col("apart")

    def rows_of(batch):
        return features(np.stack([batch.column(k).to_numpy() for k in names], 1))

    def extent(batches):
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch)
                yield arrow_rows({"f": np.arange(x.shape[1]), "low": x.min(0), "high": x.max(0)})

    box = found.mapInArrow(extent, "f long, low double, high double").groupBy("f").agg(F.min("low"), F.max("high")).orderBy("f").collect()
    forest = Forest((np.array([r[1] for r in box]), np.array([r[2] for r in box])))

    def count(batches):
        total = np.zeros(forest.feature.shape, np.int64)
        for batch in batches:
            total += forest.counts(rows_of(batch))
        at = np.flatnonzero(total)
        yield arrow_rows({"node": at, "n": total.ravel()[at]})

    normal = found.where(grows)
    total = np.zeros(forest.feature.size, np.int64)
    for r in normal.mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).toLocalIterator():  # a row for each leaf of the trees at most
        total[r["node"]] = r["n"]
    forest.weigh(total.reshape(forest.feature.shape), normal.count())

    def score(batches):
        for batch in batches:
            yield arrow_rows({"score": forest.scores(rows_of(batch)), "good": batch.column("good")})

    return forest, calibrated(found.where(judges).mapInArrow(score, "score double, good boolean"))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the statistics, base_failed, anomaly double, kept) for each row of docs."""
    stats = written(stats_of(docs), "stats")
    model = docs.sparkSession.sparkContext.broadcast(fitted(stats, labels))  # bounded: 128 trees of 2,048 nodes

    def run(batches):
        for batch in batches:
            score, failed = judged(np.stack([batch.column(n).to_numpy() for n in (*STATS, *MORE)], 1), model.value)
            kept = ~failed & (score <= model.value[1] if model.value else True)
            yield arrow_rows({n: batch.column(n) for n in ("doc_id", *STATS)} | {"base_failed": failed, "kept": kept, "anomaly": score})

    return stats.mapInArrow(run, f"doc_id {id_type(docs)}, " + ", ".join(f"{n} long" for n in STATS) + ", base_failed boolean, kept boolean, anomaly double")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without what the rules or the forest reject: judged row by row in one pass, so repeated ids stay apart."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(written(stats_of(docs), "stats"), labels))

    def run(batches):
        import pyarrow as pa

        words = WordIds()
        for batch, texts in arrow_parts(batches):
            stats = text_stats(texts, words)
            words.cut(WORD_LIMIT)
            score, failed = judged(stats, model.value)
            yield batch.filter(pa.array(~failed & (score <= model.value[1] if model.value else True)))

    return docs.mapInArrow(run, docs.schema)


def judged(stats: np.ndarray, model: tuple[Forest, float] | None) -> tuple[np.ndarray, np.ndarray]:
    """Anomaly scores, and which rows the base rules reject."""
    failed = (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])
    return model[0].scores(features(stats)) if model else np.zeros(len(stats)), failed
