"""The language model against direct counts, passages against planted copies, the pipeline against its parts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from plumaria.llm import gru, substrings


def test_lm_base_and_heldout(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id", "text", "1 AS data", "2 AS chunk")
    docs = docs.unionByName(spark.createDataFrame([(None, None, 1, 2), (9001, "", 1, 2), (9001, "", 1, 2)], "doc_id long, text string, data int, chunk int"))
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    given = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = Counter(w for i, t in given if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in gru.lm_scores(docs).collect()}
    for i, t in given:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))
        assert abs(got[i].base_score - base) < 1e-6 and got[i].n_known == sum(c[w] > 0 for w in words(t)) and got[i].train_tokens == n
        assert got[i].held_out == held(i) and got[i].n_tokens == len(words(t)) and got[i].score < 0
    assert gru.lm_scores(docs.limit(0)).count() == 0


def test_compact_windows_cover():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (3, 10, 60):
        for values in (n, 3):
            h = rng.integers(0, values, n).astype(np.uint64)
            found = substrings.compact_windows(h, 4)
            for a in range(n):
                for b in range(a + 4, n + 1):
                    assert sum(left <= a <= c < b <= right and h[c] == h[a:b].min() for left, c, right in found) == 1


def test_passages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(90)]
    rows, want = [], set()
    for i in range(60):
        text = [word() for _ in range(120)]
        if i % 3 == 0:
            copy = list(passage)
            copy[rng.randrange(90)] = word()
            text[40:40] = copy
            want.add(i)
        if i % 10 == 1:
            text[5:5] = passage[:40]  # under the least length
        rows.append((i, " ".join(text)))
    rows += [(100, None), (101, ""), (102, "w " * 20_000), (103, "w " * 20_000), (None, " ".join(passage)), (105, "short"), (106, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS class_id", "2 AS v")
    out = [r for r in substrings.repeated_passages(docs).collect()]
    assert len(out) == len(rows)
    assert {r.doc_id for r in out if r.n_passages} == want | {102, 103}
    assert {r.class_id for r in out if r.doc_id in want} == {0}
    assert all(60 <= r.repeated_words <= 110 for r in out if r.doc_id in want)
    assert substrings.repeated_passages(docs.limit(0)).count() == 0


def test_passages_after_partial_quotes(spark):
    rng = random.Random(11)
    text = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    rows, whole = [], {}
    for p in range(12):
        passage = text(60)
        for k in range(12):  # of lower ids, and under the least length
            start = rng.randrange(0, 21)
            rows.append((p * 100 + k, " ".join(text(40) + passage[start : start + 40] + text(40))))
        for k in (5000, 5001):
            rows.append((k + p * 100, " ".join(text(rng.randint(30, 80)) + passage + text(50))))
            whole[k + p * 100] = 5000 + p * 100
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(7)
        out = {r.doc_id: r for r in substrings.repeated_passages(docs).collect()}
        assert {d for d, r in out.items() if r.n_passages} == set(whole)
        assert all(out[d].class_id == c and out[d].repeated_words >= 60 for d, c in whole.items())


def test_verified_asks_once_where_words_are():
    rng, calls = np.random.default_rng(2), []
    for repeats in (False, True):
        a = rng.permutation(4000)[:900].astype(np.uint32)
        b = a.copy()
        b[::40] = 5000 + np.arange(len(b[::40]))
        if repeats:
            a[700:750] = a[100:150]
        hits = [(max(0, c - 60), c, c + 60, max(0, c - 60), c, c + 60) for c in range(70, 640, 3) if a[c] == b[c]]
        spans, done = substrings.verified(a, b, hits, 46, 0.8)
        calls.append(spans)
        assert all(done) and all(e - s >= 46 and abs(s - t) <= 12 for s, e, t, u in spans)
    assert calls[0] == calls[1]


def test_passages_do_not_depend_on_the_size_of_a_key(spark, monkeypatch):
    rng = random.Random(17)
    text = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    line, rows = text(41), []
    for p in range(120):  # all quote a line under the least length; two of each three quote more around it
        before, after = text(6), text(6)
        for k in range(2):
            rows.append((p * 10 + k, " ".join(text(60) + before + line + after + text(60))))
        rows.append((p * 10 + 2, " ".join(text(60) + line + text(60))))
    docs, results = spark.createDataFrame(rows, "doc_id long, text string"), []
    for block in (substrings.BLOCK, 6):
        monkeypatch.setattr(substrings, "BLOCK", block)
        results.append({r.doc_id: (r.class_id, r.n_passages, r.spans) for r in substrings.repeated_passages(docs).collect()})
    assert results[0] == results[1]
    assert all(results[0][p * 10 + 1][0] == p * 10 and results[0][p * 10 + 2][1] == 0 for p in range(120))


def test_links_of_near_copies_grow_with_their_number():
    rng = np.random.default_rng(5)
    core, near = rng.integers(0, 1 << 32, 100, dtype=np.uint32), []
    for k in range(90):
        own = rng.integers(0, 1 << 32, 150, dtype=np.uint32)
        own[30:130] = core
        own[30 + k] = k
        near.append(own)
    near += [np.concatenate([rng.integers(0, 1 << 32, 60, dtype=np.uint32), core[:40], rng.integers(0, 1 << 32, 50, dtype=np.uint32)]) for _ in range(30)]
    n, zero = len(near), np.zeros(120, int)
    c = np.array([60 if i < 90 else 90 for i in range(n)])  # where core[30] is
    near[30][60] = core[30]
    links = list(substrings.ties(near, zero, c - 30, c, c + 20, np.tri(n, k=-1, dtype=bool), 46, 0.8))
    assert len(links) == 89 and {x for x, _, _ in links} | {0} == set(range(90))


def test_pipeline_stages(spark, small):
    import corpus_pipeline as P
    from plumaria.llm import bpe

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        out = stage(spark, docs, small)
        assert name == P.STAGES[-1][0] or out.columns == columns
        last, docs = docs, spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() <= last.count()
    want = {(r.doc_id, r.ids_sha256) for r in bpe.bpe_digests(last).collect()}
    assert {(r.doc_id, r.ids_sha256) for r in P.run(spark, small).collect()} == want


def test_gru_scores_step_by_step():
    """Scores of whole texts, whatever their length and order, equal a plain walk of one text and one unit vector at a time."""
    rng = np.random.default_rng(4)
    model = gru.Model(100, 5)
    model.p = {k: (rng.standard_normal(v.shape) * 0.4).astype(np.float32) for k, v in model.p.items()}
    model.p["w"][100:] = -30
    texts = [np.append(rng.integers(4, 105, n), 3) for n in (0, 1, 700, 16, 17, 33, 5)] + [np.array([3])] * 3
    p, n = {k: v.astype(float) for k, v in model.p.items()}, gru.HIDDEN

    def walk(text):
        h, x, total = np.zeros(n), 3, 0.0
        for y in text.tolist():
            h = h * (x != 3)
            e, u = p["E"][x] + p["b"], h @ p["U"]
            z, r = (1 / (1 + np.exp(-(e[a : a + n] + u[a : a + n]))) for a in (0, n))
            h = (1 - z) * np.tanh(e[2 * n :] + r * u[2 * n :]) + z * h
            c = y // gru.CLASS if y < 100 else model.neural + y - 100
            s = h @ p["C"] + p["c"]
            total += s[c] - np.log(np.exp(s).sum())
            if y < 100:
                t = p["W"][c * gru.CLASS : (c + 1) * gru.CLASS] @ h + p["w"][c * gru.CLASS : (c + 1) * gru.CLASS]
                total += t[y % gru.CLASS] - np.log(np.exp(t).sum())
            x = y
        return total

    assert np.allclose(model.score(texts, 3, lanes=4), [walk(t) for t in texts], rtol=1e-4)


def test_gru_does_not_depend_on_the_layout(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    long = docs.selectExpr("doc_id + 100000 AS doc_id", "repeat(text, 400) AS text").limit(1)
    docs = docs.select("doc_id", "text").unionByName(long)
    one, many = ({r.doc_id: r for r in gru.lm_scores(docs.repartition(n)).collect()} for n in (1, 13))
    assert one.keys() == many.keys() and all(abs(one[d].score - many[d].score) < 1e-6 * abs(one[d].score) and one[d].base_score == pytest.approx(many[d].base_score) for d in one)
    assert gru.grown(10**8) == 1440 < gru.grown(10**10) < gru.grown(10**13) < 32_000


def test_gru_averages_more_shards_than_fit_at_once(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    monkeypatch.setattr(gru, "SHARD", 4000)
    once = {r.doc_id: r.score for r in gru.lm_scores(docs).collect()}
    monkeypatch.setattr(gru, "FAN", 3)
    fanned = {r.doc_id: r for r in gru.lm_scores(docs).collect()}
    assert next(iter(fanned.values())).train_tokens > 4 * gru.SHARD
    assert fanned.keys() == once.keys() and all(fanned[d].score == pytest.approx(once[d], rel=1e-4) for d in once)


def test_pipeline_odd_rows(spark, small):
    """Each stage on nulls, empty and very long texts, repeated rows, columns of any name, and an empty table."""
    import corpus_pipeline as P

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    good = lambda n: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(n))
    own, long = good(8), good(4000)
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    rows = [(None, good(8)), (None, None), (1, None), (2, ""), (3, own), (3, own), (4, own + " tail"), (5, long), (6, good(3) + "\n" + item), (6, good(8)), (7, good(7))]
    names = "text_hash h1 h2 at first chunk s1 s2 node path run bucket rank gone __h __drop class_id n".split()
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(i, t, len(t or ""), *names) for i, t in rows], schema)
    left = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, small)
        assert name == P.STAGES[-1][0] or out.columns == docs.columns
        left[name] = sorted((-1 if r.doc_id is None else r.doc_id) for r in out.collect())
        empty = stage(spark, docs.limit(0), small)
        assert empty.columns == out.columns and empty.count() == 0
    everything = sorted(-1 if i is None else i for i, _ in rows)
    assert set(left["quality rules"]) <= {-1, 3, 4, 5, 6, 7} and left["quality rules"].count(3) == 2
    assert set(left["line dedup"]) >= {-1, 1, 2, 3, 5, 6, 7} and left["line dedup"].count(-1) == 2
    assert left["n-gram Jaccard join"].count(3) == 1 and 4 not in left["n-gram Jaccard join"] and left["n-gram Jaccard join"].count(-1) == 2
    assert 6 not in left["benchmark decontamination"] and left["benchmark decontamination"].count(-1) == 2
    assert left["BPE encoding"] == everything


def passage_pairs(docs, width=46, threshold=0.8):
    """Pairs of documents with stretches of `width` shingles each that are near copies: every stretch of one against every stretch of the other that shares a shingle in place."""
    sets = {}
    for i, t in docs:
        w = [x.lower() for x in t.split()]
        sets[i] = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    out, where = set(), {}
    for i, s in sets.items():
        for k, x in enumerate(s):
            where.setdefault(x, []).append((i, k))
    for i, s in sets.items():
        shared = {}
        for k, x in enumerate(s):
            for j, m in where[x]:
                if j < i:
                    shared.setdefault(j, {}).setdefault(k - m, []).append(k)
        for j, diagonals in shared.items():
            if sum(map(len, diagonals.values())) < threshold * width / (2 - threshold):
                continue
            other = sets[j]
            for d, places in diagonals.items():
                for a in {max(0, p - x) for p in places for x in range(0, width, 3)}:
                    one, two = set(s[a : a + width]), set(other[max(0, a - d) : max(0, a - d) + width])
                    if min(len(s) - a, len(other) - max(0, a - d)) >= width and len(one & two) >= threshold * len(one | two):
                        out.add((j, i))
                        break
                if (j, i) in out:
                    break
    return out


def test_passages_against_brute_force(spark, small):
    """A whole table and planted passages of 55 to 120 words, whole and with words replaced, after lines that many texts have; for any layout of the table."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    lines = [" ".join(word() for _ in range(n)) for n in (8, 30, 40)]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for p in range(40):
        passage = [word() for _ in range(rng.randint(55, 120))]
        for k in range(3):
            copy = list(passage)
            for x in rng.sample(range(len(copy)), len(copy) // 60 * (k > 0)):
                copy[x] = word()
            own = [word() for _ in range(rng.randint(10, 60))]
            rows.append((10_000 + 10 * p + k, " ".join([*own, lines[p % 3], *copy, *(word() for _ in range(20))])))
    want = passage_pairs(rows)
    results = []
    for n, size in ((1, "10000"), (16, "7")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
            results.append({r.doc_id: (r.class_id, r.n_passages, r.spans) for r in substrings.repeated_passages(docs).collect()})
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert results[0] == results[1]
    told = results[0]
    held = [(a, b) for a, b in want if told[a][0] == told[b][0] and told[a][1] and told[b][1]]
    assert len(want) > 120 and len(held) >= 0.97 * len(want), (len(held), len(want))
    clean = {i for i, _ in rows} - {x for p in want for x in p}
    assert sum(told[i][1] > 0 for i in clean) <= 0.01 * len(clean)


def test_gru_gradients_and_lookups(monkeypatch):
    rng, looked, given = np.random.default_rng(8), [], gru.Model.given
    texts = [np.append(rng.integers(1, 105, n), 0) for n in (gru.STEPS - 8, 6)]  # a window of whole texts, each ends with the symbol 0
    monkeypatch.setattr(gru.Model, "given", lambda self, x: looked.append(x.shape) or given(self, x))
    model = gru.Model(100, 5)
    before, squares = model.flat(), {k: np.full_like(v, 1e-6) for k, v in model.p.items()}
    model.train(np.concatenate(texts), 0, squares=squares)
    assert looked == [(gru.STEPS, 1)]  # what a window's inputs give is looked up once
    model.load(before)
    for name, at in (("E", (0, 20)), ("E", (texts[0][1], 3)), ("U", (2, 5)), ("U", (7, 40)), ("b", (1,)), ("b", (45,)), ("C", (3, 1)), ("c", (2,)), ("W", (texts[1][0] % 96, 4)), ("w", (texts[1][0] % 96,))):
        loss, was = [], model.p[name][at]
        for change in (1e-2, -1e-2):
            model.p[name][at] = was + change
            loss.append(-model.score(texts, 0).sum() / gru.STEPS)
        model.p[name][at] = was
        assert abs(abs(loss[0] - loss[1]) / 2e-2 - max(0, squares[name][at] - 1e-6) ** 0.5) < 1e-3, name
