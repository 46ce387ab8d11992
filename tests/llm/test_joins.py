"""Operators that compare documents, against brute force."""

import random
from itertools import combinations

import pytest

from plumaria.llm import jaccard, lines
from plumaria.llm.common import components

SCHEMA = "doc_id long, text string, n_chars long, class_id string, node string, chunk string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, len(t or ""), "x", "y", "z") for i, t in texts], SCHEMA)


def shingle_set(text):
    w = [x.lower() for x in (text or "").split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near_copies(rng, n=150):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(rng.randint(3, 120))] for _ in range(25)]
    out = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = word()
        out.append((i, " ".join(text)))
    return out


def brute_classes(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a], links[b] = links[a] + 1, links[b] + 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


def test_jaccard_equals_brute_force(spark):
    rows = near_copies(random.Random(1)) + [(900, None), (901, ""), (902, " "), (903, "two words"), (904, "Two  words"), (905, "w " * 40_000)]
    want = brute_classes(rows)
    for how in ({}, {"limit": 4, "depth": 2}):  # the second splits, and compares blocks
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(documents(spark, rows), runs=12, **how).collect()}
        assert got == want
    kept = jaccard.one_of_each(documents(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {c for c, _ in want.values()} and kept.columns == documents(spark, []).columns


def test_jaccard_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "A b c d e f")]
    out = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard.near_duplicates(documents(spark, rows)).collect())
    assert out == [("1", "1", 1), ("1", "1", 1), ("2", "1", 1), ("None", "None", 0), ("None", "None", 0)]
    assert jaccard.near_duplicates(documents(spark, [])).count() == 0


def test_jaccard_on_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()} == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        kept = []
        for n, chunk in lines.chunks_of((t or "").encode()):
            if n < 2 or not chunk.strip() or seen.setdefault(chunk, (i, len(kept))) is None or chunk not in out.setdefault("_", set()):
                kept.append(chunk)
            if n > 1 and chunk.strip():
                out["_"].add(chunk)
        out[i] = t if t is None else b"\n".join(kept).decode()
    out.pop("_", None)
    return out


def test_line_chunks(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice("abc ") for _ in range(12)) for _ in range(40)]
    passage = [f"passage line {k}" for k in range(12)]
    rows = [(i, "\n".join([*(rng.choice(pool) for _ in range(rng.randint(0, 9))), *passage[: 12 * (i % 3 == 0)], *(rng.choice(pool) for _ in range(rng.randint(0, 9)))])) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n\n\n"), (503, "\n\n\n\n"), (504, "x" * 40_000 + "\ny"), (505, "x" * 40_000 + "\ny")]
    out = {r.doc_id: r.text for r in lines.without_repeats(documents(spark, rows)).collect()}
    assert out == brute_lines(rows)
    shorter = [i for i, t in rows if i % 3 == 0 and 0 < i < 120 and len(out[i]) < len(t)]
    assert len(shorter) > 30  # boundaries inside the passage do not move with what stands before it
    assert lines.without_repeats(documents(spark, rows)).columns == documents(spark, []).columns


def test_line_chunks_odd_rows(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (2, "a\nb"), (None, "a\nb"), (None, "c\nd"), (3, "c\nd")]
    out = sorted((str(r.doc_id), r.text, r.n_chars) for r in lines.without_repeats(documents(spark, rows)).collect())
    assert out == [("1", "", 0), ("1", "", 0), ("2", "", 0), ("3", "", 0), ("None", "a\nb", 3), ("None", "c\nd", 3)]
    assert lines.without_repeats(documents(spark, [])).count() == 0


def test_line_runs_go_whole(spark):
    rng = random.Random(4)
    own = lambda: "".join(rng.choice("abcdefgh") for _ in range(12))
    runs = [[own() for _ in range(2 + r % 3)] for r in range(60)]
    rows = []
    for i in range(240):
        run = runs[i % 60]
        rows.append((i, "\n".join([*(own() for _ in range(rng.randint(0, 4))), *run[:1], *[""] * (i % 7 == 0) * (i > 180), *run[1:], *(own() for _ in range(rng.randint(0, 4)))])))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "\n\n"), (504, f"alone {own()}\n{runs[0][0]}"), (505, "x\nx\nx"), (None, "p\nq"), (600, "o\np\nq"), (601, "\np\n\nr")]
    seen, want = set(), {}
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        text = (t or "").split("\n")
        full = [k for k, x in enumerate(text) if x.strip()]
        goes = set()
        for a, b in zip(full, full[1:], strict=False):
            piece = tuple(text[a : b + 1])
            if piece in seen and i is not None:
                goes |= set(range(a, b + 1))
            seen.add(piece)
        want[i] = t if t is None else "\n".join(x for k, x in enumerate(text) if k not in goes)
    out = {r.doc_id: r for r in lines.without_repeats(documents(spark, rows), counts=True, runs=True).collect()}
    assert {i: r.text for i, r in out.items()} == want
    assert all(not set(runs[i % 60]) & set(out[i].text.split("\n")) for i in range(60, 180))
    assert all(r.n_dropped == (r.text != t) and r.dropped_chars >= 0 for i, t in rows if t is not None and i is not None for r in [out[i]])


def test_clashing_columns_and_repeated_rows(spark):
    schema = "doc_id long, text string, __h string, __drop long, __id int, __h2 string, own_hash string, gone string, rank int, other_id int, n_chars long"
    extra = ("h", 1, 2, "h2", "o", "g", 3, 4, 5)
    docs = spark.createDataFrame([(1, "p\nq", *extra), (2, "p\nq\nr", *extra), (2, "p\nq\nr", *extra), (3, "own", *extra), (None, "own", *extra), (None, "own", *extra)], schema)
    out = lines.without_repeats(docs, runs=True)
    assert out.columns == docs.columns and sorted(str(r.text) for r in out.collect()) == ["own", "own", "own", "p\nq", "r", "r"]
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in left.collect()) == [("1", "p\nq"), ("2", "p\nq\nr"), ("3", "own"), ("None", "own"), ("None", "own")]
    with pytest.raises(TypeError):
        jaccard.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
