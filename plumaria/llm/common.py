"""Helpers that the operators of this subpackage share.

Words are the runs of bytes outside ``[\\x20\\x09-\\x0D]``: exactly what ``bytes.split()`` yields on UTF-8.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumaria.storage import WRITTEN, drop, remove, shared_dir, sweep
from plumaria.storage import stored as written

__all__ = ["WRITTEN", "drop", "remove", "shared_dir", "sweep", "written"]
SHINGLE = 5
SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(columns, name: str) -> str:
    """name, or name with underscores after it, that no column has (letter case does not part names)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_long_ids(docs: DataFrame) -> DataFrame:
    """docs with doc_id as long. Operators that name classes by the least id take integers; other types raise here, not in a task."""
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id must be an integer, not {kind}")
    return docs.withColumn("doc_id", F.col("doc_id").cast("long"))


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def fold(word: bytes) -> bytes:
    return word.lower() if word.isascii() else word.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass")


class WordIds(dict):
    """Word -> dense id. Ids hold until cut() starts anew, which callers ask for between batches."""

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i

    def cut(self, limit: int) -> bool:
        if full := len(self) > limit:
            self.clear()
        return full


def word_ids(texts: list[bytes], words: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, end to end, and where each text starts (one more entry than texts)."""
    ids, starts = array("q"), np.zeros(len(texts) + 1, np.int64)
    get = words.__getitem__
    for i, text in enumerate(texts):
        ids.extend(map(get, text.split()))
        starts[i + 1] = len(ids)
    return np.frombuffer(ids, np.int64) if ids else np.zeros(0, np.int64), starts


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of h."""
    h = h.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(33)
    return h


BASE, SPACES = 0x9E3779B97F4A7C15, np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: A number for each byte, 0 for white space.
BYTES = np.where(SPACES, np.uint64(0), mixed(np.arange(1, 257, dtype=np.uint64)))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all case-folded words, end to end, and where each text's start. In numpy passes over the bytes, so no word becomes an object and nothing is kept between calls."""
    folded = [t.lower() if t.isascii() else t.decode("utf-8", "replace").lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(folded), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in folded])])
    space = SPACES[raw]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(raw) else np.zeros(0, np.int64)
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    place = np.arange(len(raw), dtype=np.int32)
    place[begins[0] :] -= np.repeat(begins, np.diff(np.append(begins, len(raw)))).astype(np.int32)
    powers = np.full(int(place.max()) + 1, BASE, np.uint64)
    powers[0] = 1
    value = BYTES[raw]
    value *= np.cumprod(powers)[place]
    return mixed(np.add.reduceat(value, begins)), np.searchsorted(begins, offsets)


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, end to end, and where each text's start.

    A text of fewer words, but at least one, has one shingle: all its words. A text without words has none.
    """
    h, starts = word_hashes(texts)
    n = np.diff(starts)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out = np.zeros(starts[-1] + size, np.uint64)
    ends = np.repeat(starts[1:], n)
    at = np.arange(len(h))
    factors = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(size):  # words past the text's end count as nothing
        m = max(0, len(h) - k)
        out[:m] += np.where(at[k:] < ends[:m], h[k:], np.uint64(0)) * factors[k]
    first = np.concatenate([[0], np.cumsum(count)])
    keep = np.repeat(starts[:-1] - first[:-1], count) + np.arange(first[-1])
    return mixed(out[keep]), first


def byte_cuts(columns: list, size: int) -> list[int]:
    """Where to cut rows so that each part has about `size` bytes of these string columns at most; a longer row comes alone."""
    import pyarrow.compute as pc

    lengths = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends, cuts = np.cumsum(lengths), [0]
    while cuts[-1] < len(ends):
        start = cuts[-1]
        before = int(ends[start - 1]) if start else 0
        cuts.append(max(int(np.searchsorted(ends, before + size, side="right")), start + 1))
    return cuts


def utf8(column) -> list[bytes]:
    """The strings of a column as bytes; null is empty."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def arrow_parts(batches: Iterator, size: int = 2_000_000) -> Iterator:
    """(record batch, its texts in UTF-8), of about `size` bytes of text at most (a longer text comes alone).

    The batch is cut before anything of it becomes Python objects, so these take `size` bytes at a time, whatever the batch has.
    """
    for batch in batches:
        cuts = byte_cuts([batch.column("text")], size)
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            yield part, utf8(part.column("text"))


def arrow_rows(columns: dict):
    """A record batch of the columns: pyarrow arrays, numpy arrays or lists."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], names=list(columns))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share, by products of their incidence, some thousands of elements at a time."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owner = column[shared], owner[shared]
    inter = np.zeros((n, n), np.float32)
    if len(column):
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for low in range(0, int(column[-1]) + 1, 4096):
            a, b = np.searchsorted(column, [low, low + 4096])
            m = np.zeros((n, int(column[b - 1]) - low + 1), np.float32)
            m[owner[a:b], column[a:b] - low] = 1
            inter += m @ m.T
    return inter


def whole_groups(batches: Iterator, key: str, sized: list[str], size: int = 1_000_000) -> Iterator:
    """Tables of whole groups of a key, many at a time, some `size` bytes of the `sized` columns in each (a group of more comes alone), of batches in the order of the key."""
    import pyarrow as pa

    held: list[pa.RecordBatch] = []
    for batch in batches:
        cuts = byte_cuts([batch.column(c) for c in sized], size)
        for start, end in zip(cuts, cuts[1:], strict=False):
            held.append(batch.slice(start, end - start))
            whole = pa.Table.from_batches(held)
            keys = whole.column(key).to_numpy()
            before = np.flatnonzero(keys != keys[-1])
            last = int(before[-1]) + 1 if len(before) else 0
            if last:
                yield whole.slice(0, last)
                held = whole.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def id_type(docs: DataFrame) -> str:
    return dict(docs.dtypes)["doc_id"]


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of edges (a, b): (id, root) for every id in them, root the least id.

    Alternates large-star and small-star steps (Kiveris et al., 2014); every step is written to the shared folder, its predecessor deleted,
    and no link or label is collected: two numbers tell whether a round changed anything. Least neighbours are tables of their own, so that
    where a star's centre has a large share of the edges, the join with them is split at run time. Ids without an edge are absent.
    """
    spark = edges.sparkSession
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    now = state(edges)
    for _ in range(rounds if now[0] else 0):
        folders = WRITTEN[-1:]
        near = written(both(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "near")
        large = both(edges).join(near, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        folders += WRITTEN[-1:]
        new = written(small.where("a <> b").distinct(), "edges")
        before, now = now, state(new)
        remove(spark, *folders)
        edges = new
        if now == before:
            break
    else:
        if now[0]:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
