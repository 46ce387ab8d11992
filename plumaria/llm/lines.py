r"""Line deduplication by content-defined chunks.

A text's lines are hashed; a rolling hash over the last `WINDOW` line hashes ends a chunk where it is 0 modulo `DIVISOR`, if the chunk
has `LEAST` lines (and at `MOST` in any case). Boundaries depend on nearby lines alone, so lines put in front shift none further on. Of a chunk of two lines
or more that occurs again anywhere, the first occurrence (least doc_id, then place) stays and the others go, each after its bytes
were compared with the first's.

With `runs`, as the queries use it, no boundary is left to chance: every two neighbouring lines that are not blank (with the blank ones between) are a piece,
and what repeated pieces cover goes, so that each repeated run of two such lines or more goes whole wherever it starts. A line's first occurrence always stays: what makes
a line go is a piece that holds it and came before. n_chunks and n_dropped then count the stretches that stay or go.

Locations are (doc_id, hash of the text, chunk number), so that rows repeated in full share their locations and agree, and a recomputed
task gives the same ones. Groups by chunk hash are aggregates that combine before the shuffle; no group is gathered.

Defined cases: null and empty texts have no chunk and stay as they are; blank lines belong to their chunk, a chunk of blank lines alone never
goes; rows with a null doc_id count as first occurrences but lose nothing; other columns pass through (n_chars follows the text).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumaria.llm.common import arrow_parts, arrow_rows, id_type, spare, written

WINDOW, DIVISOR, LEAST, MOST = 2, 3, 2, 64
BASE = 0x9E3779B97F4A7C15


def chunk_ends(lines: list[bytes]) -> list[int]:
    """Where each chunk ends (line numbers, exclusive)."""
    import xxhash

    h = np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64)
    roll = h.copy()
    power = np.uint64(1)
    for k in range(1, WINDOW):
        power *= np.uint64(BASE)
        roll[k:] += h[:-k] * power
    ends, last = [], 0
    cut = ((roll ^ (roll >> np.uint64(29))) * np.uint64(BASE) >> np.uint64(32)) % np.uint64(DIVISOR) == 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or i - last >= MOST or (cut[i - 1] and i - last >= LEAST):
            ends.append(i)
            last = i
    return ends


def chunks_of(text: bytes) -> list[tuple[int, bytes]]:
    """(lines, bytes) of each chunk."""
    if not text:
        return []
    lines, start, out = text.split(b"\n"), 0, []
    for end in chunk_ends(lines):
        out.append((end - start, b"\n".join(lines[start:end])))
        start = end
    return out


def line_pairs(text: bytes) -> list[tuple[int, int]]:
    """(start, end), in lines, of every two neighbouring lines that are not blank."""
    full = [i for i, line in enumerate(text.split(b"\n")) if line.strip()]
    return [(a, b + 1) for a, b in zip(full, full[1:], strict=False)]


def stretches(text: bytes, gone: set[int]) -> list[tuple[int, bytes, bool]]:
    """(lines, bytes, whether it goes) of the stretches that the numbered pairs of lines cover, and of those between."""
    lines, out = text.split(b"\n"), []
    goes = np.zeros(len(lines), bool)
    for no, (a, b) in enumerate(line_pairs(text) if gone else []):
        goes[a:b] |= no in gone
    edges = [0, *(np.flatnonzero(np.diff(goes)) + 1).tolist(), len(lines)] if text else []
    for a, b in zip(edges, edges[1:], strict=False):
        out.append((b - a, b"\n".join(lines[a:b]), bool(goes[a])))
    return out


def pieces_of(text: bytes, runs: bool) -> list[tuple[int, bytes]]:
    if not runs:
        return chunks_of(text)
    lines = text.split(b"\n")
    return [(b - a, b"\n".join(lines[a:b])) for a, b in line_pairs(text)]


def chunk_rows(docs: DataFrame, with_text: bool, runs: bool = False) -> DataFrame:
    """A row for each chunk that could go: its two hashes and location, and its bytes if asked."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch, texts in arrow_parts(batches):
            rows = [(i, no, c) for i, text in enumerate(texts) for no, (n, c) in enumerate(pieces_of(text, runs)) if n > 1 and c.strip()]
            if rows:
                at = pa.array([r[0] for r in rows])
                digest = [xxhash.xxh3_128_digest(r[2]) for r in rows]
                both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                out = {"h1": both[:, 0], "h2": both[:, 1], "doc_id": batch.column("doc_id").take(at), "text_hash": batch.column("text_hash").take(at), "chunk_no": np.array([r[1] for r in rows], np.int64)}
                yield arrow_rows(out | ({"chunk": pa.array([r[2] for r in rows], pa.binary())} if with_text else {}))

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"h1 long, h2 long, doc_id {id_type(docs)}, text_hash long, chunk_no long" + ", chunk binary" * with_text)


def repeated_chunks(docs: DataFrame, runs: bool = False) -> DataFrame:
    """(doc_id, text_hash, drop array<long>): the chunks that each text loses."""
    place = F.struct("doc_id", "text_hash", "chunk_no")
    repeated = chunk_rows(docs, False, runs).select("h1", "h2", place.alias("at")).groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    # A table of its own, and so is that of first bytes: Spark splits the rows of a frequent chunk at run time only where both sides of the join come straight from an exchange.
    repeated = written(repeated.where(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first"), "repeated")
    # Written once: else the bytes of all chunks would be shuffled for either side below.
    members = written(chunk_rows(docs, True, runs).select("h1", "h2", place.alias("at"), "chunk").join(repeated, ["h1", "h2"]), "chunks")
    # Only bytes of repeated chunks come this far. The first's bytes go to the others by hash, then are compared.
    first = written(members.where(F.col("at").eqNullSafe(F.col("first"))).groupBy("h1", "h2").agg(F.min("chunk").alias("bytes")), "first")
    others = members.where(~F.col("at").eqNullSafe(F.col("first"))).select("h1", "h2", "at", "chunk")
    same = others.join(first, ["h1", "h2"]).where("chunk = bytes")
    return same.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.text_hash").alias("text_hash")).agg(F.collect_set("at.chunk_no").alias("drop"))


def without_repeats(docs: DataFrame, counts: bool = False, runs: bool = False) -> DataFrame:
    """docs with shorter texts; with counts also n_lines, n_chunks, n_dropped, dropped_chars (long)."""
    names = docs.columns
    own, gone, other, hashed = (spare(names, n) for n in ("own_hash", "gone", "other_id", "other_hash"))
    drop = repeated_chunks(docs.select("doc_id", "text"), runs).select(F.col("doc_id").alias(other), F.col("text_hash").alias(hashed), F.col("drop").alias(gone))
    keyed = docs.withColumn(own, F.xxhash64("text"))
    joined = keyed.join(drop, (F.col("doc_id") == F.col(other)) & (F.col(own) == F.col(hashed)), "left").select(*(f"`{c}`" for c in names), gone)
    extra = ["n_lines", "n_chunks", "n_dropped", "dropped_chars"] if counts else []

    def run(batches):
        import pyarrow as pa

        for batch, texts in arrow_parts(batches):
            drops = batch.column(gone).to_pylist()
            new, told = batch.column("text").to_pylist(), []
            for i, (text, lost) in enumerate(zip(texts, drops, strict=True)):
                if lost or counts:
                    lost = set(lost or ())
                    chunks = stretches(text, lost) if runs else [(n, c, k in lost) for k, (n, c) in enumerate(chunks_of(text))]
                    if lost:
                        new[i] = b"\n".join([c for _, c, goes in chunks if not goes]).decode("utf-8", "surrogatepass")
                    told.append((sum(n for n, _, _ in chunks), len(chunks), sum(goes for _, _, goes in chunks), sum(len(c.decode("utf-8", "replace")) for _, c, goes in chunks if goes)))
            out = {c: batch.column(c) for c in names} | {"text": pa.array(new, pa.string())}
            if "n_chars" in out:
                out["n_chars"] = pa.array([len(t) if g and t is not None else n for t, g, n in zip(new, drops, out["n_chars"].to_pylist(), strict=True)], out["n_chars"].type)
            yield arrow_rows(out | {c: np.array([t[k] for t in told], np.int64) for k, c in enumerate(extra)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + "".join(f", {c} long" for c in extra)
    return joined.mapInArrow(run, schema)
