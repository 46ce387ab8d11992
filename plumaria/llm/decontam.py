r"""Benchmark decontamination: rare words that a match cannot do without, then Smith-Waterman alignment.

Words are case-folded and lose punctuation at both ends. Benchmark items are taken in blocks of at most `block_bytes` of text,
each against all documents, so what is broadcast has that bound at any size of either table. For a block:

1. The document frequency of every word of its items is counted over all documents.
2. To reach `threshold` of its own score, an item of L words must have m = threshold * L of them matched. So of any L - m + k of its places at least k
   are matched: those of its rarest words are its seeds. The matched words and edits take (3 - 2 * threshold) * L words of a document at most.
3. Where a document has k seeds of an item within that span, all words that an alignment through them could reach are aligned with the item:
   match 2, mismatch and gap -1. Stretches that do not have m of the item's words in its order are skipped. None of these steps loses a pair.

A pair counts if its best local score is at least `threshold` of the item's own score. The default of one half takes passages with
a good part of their words replaced, and halves of items. Items of fewer than 2 * `n` words must also have a run of `n` words in common with the document.

Defined cases: null or empty texts and items have no words and match nothing; items shorter than the n-gram are sought whole; equal
items each give their pairs; items with a null id are sought too and give a null item_id; repeated documents each give their rows; of equal scores the first stretch counts; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumaria.llm.common import arrow_parts, arrow_rows, encoded, fold, id_type

EDGES = bytes(range(33, 48)) + b":;<=>?@[\\]^_`{|}~"
WORD_LIMIT = 1 << 20
NEED = 4  # seeds that a match has at least


def plain(word: bytes) -> bytes:
    return fold(word).strip(EDGES)


class Known(dict):
    """Raw word -> id of its plain form in the block's vocabulary, -1 if it has none, -2 if nothing is left of it."""

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        p = plain(word)
        i = self[word] = self.vocabulary.get(p, -1) if p else -2
        return i


class Block:
    """The items of a block, what they need to match, and their seeds."""

    def __init__(self, rows: list[tuple], n: int, threshold: float):
        self.vocabulary: dict[bytes, int] = {}
        self.items, self.words = [], []
        for item_id, text in rows:
            words = [p for p in map(plain, encoded(text).split()) if p]
            if words:
                self.items.append(item_id)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64))
        self.bits: list[dict[int, int]] = [{} for _ in self.words]
        for bits, words in zip(self.bits, self.words, strict=True):
            for k, w in enumerate(words.tolist()):
                bits[w] = bits.get(w, 0) | 1 << k
        self.n, self.threshold = n, threshold
        length = np.array([len(w) for w in self.words], np.int64)
        self.least = np.maximum(np.ceil(threshold * length - 1e-9).astype(np.int64), 1)
        self.span = np.maximum(np.floor((3 - 2 * threshold) * length + 1e-9).astype(np.int64), length)
        self.need = np.minimum(self.least, NEED)

    def choose_seeds(self, frequency: np.ndarray) -> None:
        """frequency: of each word. Any choice of as many places finds the same pairs."""
        held = np.bincount(np.concatenate([np.zeros(0, np.int64), *map(np.unique, self.words)]), minlength=len(self.vocabulary))
        seeds = []
        for w, least, need in zip(self.words, self.least, self.need, strict=True):
            order = np.lexsort((w, held[w], frequency[w]))
            seeds.append(np.unique(w[order[: max(len(w) - least + need, 0)]]))
        word = np.concatenate([np.zeros(0, np.int64), *seeds])
        item = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
        self.item = item[np.argsort(word, kind="stable")]
        # One entry more, for the id -1 of words that no item has.
        self.count = np.append(np.bincount(word, minlength=len(self.vocabulary)), 0)
        self.first = np.cumsum(self.count) - self.count

    def stretches(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, start, end) wherever a text has enough seeds of an item close enough. ids of texts end to end."""
        at = np.flatnonzero(self.count[ids])
        n = self.count[ids[at]]
        entry = np.repeat(self.first[ids[at]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = np.sort(self.item[entry] * len(ids) + np.repeat(at, n))
        item, place = np.divmod(key, max(len(ids), 1))
        last = np.arange(len(key)) + self.need[item] - 1
        end = np.minimum(last, len(key) - 1)
        close = np.flatnonzero((last == end) & (item[end] == item) & (place[end] - place < self.span[item]))
        item, place, end = item[close], place[close], place[end[close]]
        text = np.searchsorted(starts, place, side="right") - 1
        inside = end < starts[text + 1]
        item, place, end, text = item[inside], place[inside], end[inside], text[inside]
        low, high = np.maximum(end + 1 - self.span[item], starts[text]), np.minimum(place + self.span[item], starts[text + 1])
        if not len(item):
            return text, item, low, high
        begins = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (low[1:] > high[:-1])))
        return text[begins], item[begins], low[begins], high[np.append(begins[1:], len(item)) - 1]


def align(item: np.ndarray, words: np.ndarray, match: int = 2, miss: int = 1, gap: int = 1) -> tuple[int, int, int]:
    """The best local score of item against words, and the span of words it covers (end exclusive). First of equals."""
    n = len(words)
    slope = gap * np.arange(n + 1)
    row, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        diagonal = row[:-1] + np.where(words == w, match, -miss)
        up = row[1:] - gap
        new, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take_diagonal = diagonal >= up
        new[1:], start[1:] = np.where(take_diagonal, diagonal, up), np.where(take_diagonal, origin[:-1], origin[1:])
        low = new <= 0
        new[low], start[low] = 0, np.arange(n + 1)[low]
        # Gaps along the row: the best of all places to the left, less their distance.
        lifted = new + slope
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        row, origin = top - slope, start[source]
        if (high := int(row.max())) > best[0]:
            end = int(row.argmax())
            best = (high, int(origin[end]), end)
    return best


def common(bits: dict[int, int], length: int, words: list[int], least: int) -> bool:
    """Whether an item of that length, as the bits of each word's places, has `least` words or more in common with words, in order."""
    found = [b for b in map(bits.get, words) if b]
    if len(found) < least:
        return False
    full = free = (1 << length) - 1
    for b in found:  # Hyyrö's recurrence: a place's bit falls when the longest common subsequence grows there
        u = free & b
        free = ((free + u) | (free - u)) & full
    return length - free.bit_count() >= least


def has_run(words: np.ndarray, ids: np.ndarray, n: int) -> bool:
    """Whether n words in a row of the item, or all if it has fewer, are in a row in ids."""
    n = min(n, len(words))
    runs = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
    return any(tuple(ids[k : k + n]) in runs for k in range(len(ids) - n + 1))


def matches(block: Block, ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """(text, item's index, score, start, end) of each item that a text holds. ids of texts end to end."""
    out: dict[tuple[int, int], tuple[float, int, int]] = {}
    for text, i, start, end in zip(*(x.tolist() for x in block.stretches(ids, starts)), strict=True):
        words, window = block.words[i], ids[start:end]
        if not common(block.bits[i], len(words), window.tolist(), int(block.least[i])):
            continue
        if len(words) < 2 * block.n and not has_run(words, window, block.n):
            continue
        score, s, e = align(words, window)
        if score >= block.threshold * 2 * len(words) and score / 2 / len(words) > out.get((text, i), (0.0,))[0]:
            out[text, i] = (score / 2 / len(words), start + s - int(starts[text]), start + e - int(starts[text]))
    return [(*k, *out[k]) for k in sorted(out)]


def portions(block: Block, ids: list[np.ndarray], most: int = 2_000_000):
    """(number of the first text, ids end to end, starts) of texts with `most` seeds together at most; a text of more comes alone."""
    first = total = 0
    for i, x in enumerate(ids):
        n = int(block.count[x].sum())
        if i > first and total + n > most:
            yield first, np.concatenate(ids[first:i]), np.cumsum([0, *map(len, ids[first:i])])
            first, total = i, 0
        total += n
    if ids:
        yield first, np.concatenate(ids[first:]), np.cumsum([0, *map(len, ids[first:])])


def blocks_of(items: DataFrame, n: int, threshold: float, block_bytes: int):
    rows, size = [], 0
    for row in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if rows and size + len(row["text"] or "") > block_bytes:
            yield Block(rows, n, threshold)
            rows, size = [], 0
        rows.append((row["item_id"], row["text"]))
        size += len(row["text"] or "")
    if rows:
        yield Block(rows, n, threshold)


def numbered(texts: list[bytes], known: Known):
    """For each text the ids of its words that are not all punctuation, and their places among all words."""
    for text in texts:
        ids = np.fromiter(map(known.__getitem__, text.split()), np.int64)
        real = np.flatnonzero(ids > -2)
        yield (ids, np.arange(len(ids))) if len(real) == len(ids) else (ids[real], real)


def leaks(docs: DataFrame, items: DataFrame, n: int = 3, threshold: float = 0.5, block_bytes: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): pairs with the words of the document that hold the item."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    item_type = dict(items.dtypes)["item_id"]
    arrow_type = to_arrow_type(items.schema["item_id"].dataType)
    schema = f"doc_id {id_type(docs)}, item_id {item_type}, score double, start_word long, end_word long"
    found = []
    for block in blocks_of(items, n, threshold, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def count(batches, shared=shared):
            block, total = shared.value, np.zeros(len(shared.value.vocabulary), np.int64)
            known = Known(block.vocabulary)
            for _, texts in arrow_parts(batches):
                for text in texts:
                    held = set(map(known.__getitem__, text.split()))
                    total[[i for i in held if i >= 0]] += 1
                if len(known) > WORD_LIMIT:
                    known.clear()
            yield arrow_rows({"word": np.flatnonzero(total), "n": total[total > 0]})

        frequency = np.zeros(len(block.vocabulary), np.int64)
        counted = docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        for row in counted.toLocalIterator():  # a row for each word of the block at most
            frequency[row["word"]] = row["n"]
        block.choose_seeds(frequency)
        shared = spark.sparkContext.broadcast(block)

        def seek(batches, shared=shared):
            import pyarrow as pa

            block = shared.value
            known = Known(block.vocabulary)
            for batch, texts in arrow_parts(batches):
                ids, at = zip(*numbered(texts, known), strict=True)
                rows = []
                for first, together, starts in portions(block, ids):
                    for i, item, score, start, end in matches(block, together, starts):
                        real = at[first + i]
                        rows.append((first + i, block.items[item], score, int(real[start]), int(real[end - 1]) + 1))
                if len(known) > WORD_LIMIT:
                    known.clear()
                if rows:
                    who, item, score, start, end = zip(*rows, strict=True)
                    yield arrow_rows({"doc_id": batch.column("doc_id").take(pa.array(who)), "item_id": pa.array(item, arrow_type), "score": list(score), "start_word": list(start), "end_word": list(end)})

        found.append(docs.mapInArrow(seek, schema))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def clean_documents(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """docs without those that hold a benchmark item. Rows of an id that leaks go together; rows with a null id stay."""
    return docs.join(leaks(docs, items, **how).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
