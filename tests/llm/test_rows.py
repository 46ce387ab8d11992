"""Operators that work row by row, against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from plumaria.llm import bpe, chat, decontam, pii, quality

SCHEMA = "doc_id long, text string, lang string, kinds string, ids string, n_words string"


def documents(spark, texts):
    """Rows with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in texts], SCHEMA)


ODD = [(0, None), (1, ""), (2, "   \n"), (3, "word " * 60_000), (4, "same"), (4, "same"), (None, "a b c\nd é\n"), (6, "x" * 30_000)]


def brute_spans(text):
    found = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((kind, *m.span()))
    return found


def test_pii_base_equals_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("a@.1+-( )2 3@..5é9") for _ in range(rng.randint(0, 40)))
        assert [s for s in pii.find_spans(text) if s[0] in pii.KINDS[:4]] == brute_spans(text), text


def test_pii_added_kinds():
    text = "IBAN: GB82 WEST 1234 5698 7654 32 see https://example.org/a, account no 12345678; iban is a word. http://x"
    assert [text[a:b] for k, a, b in pii.find_spans(text) if k in ("url", "account")] == ["https://example.org/a", "GB82 WEST 1234 5698 7654 32", "12345678"]


def test_pii_odd_rows(spark):
    out = pii.digests(pii.pii_spans(documents(spark, [*ODD, (7, "mail a.b@c.de now")]))).collect()
    assert len(out) == len(ODD) + 1
    assert next(r for r in out if r.doc_id == 7).spans == "email:5:13"
    assert next(r for r in out if r.doc_id == 0).base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.pii_spans(documents(spark, [])).count() == 0


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)]


def test_quality_statistics():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b ", " ", "\n", "é", "\x85", " ", "#", "c ", "\x1c"]) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    from plumaria.llm.common import WordIds

    got = quality.text_stats([t.encode() for t in texts], WordIds())[:, :5].tolist()
    assert got == [brute_stats(t) for t in texts]


def test_quality_forest_keeps_clean_and_rejects_junk(spark, small):
    docs, labels = spark.read.parquet(f"{small}/../sf0.01/documents.parquet"), spark.read.parquet(f"{small}/../sf0.01/labels.parquet")
    rows = quality.quality_verdicts(docs, labels).join(labels, "doc_id").where("not base_failed").toPandas()
    assert rows[rows.quality == 0].kept.mean() < 0.1
    assert rows[rows.quality == 1].kept.mean() > 0.95
    assert {r.doc_id for r in quality.kept_documents(docs, labels).collect()} == {r.doc_id for r in quality.quality_verdicts(docs, labels).where("kept").collect()}


def test_quality_learns_from_all_labels(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefghij", k=60) + rng.choices("ab#", k=i % 40)) for i in range(7000)]
    docs, labels = documents(spark, list(enumerate(texts))), spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(7000)], "doc_id long, quality int")
    stats = quality.stats_of(docs)
    forest, threshold = quality.fitted(stats, labels)
    found = [r for r in stats.where(~quality.base_failed()).toPandas().itertuples() if r.doc_id % 5]
    grown = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5]
    x = quality.features(np.array([r[2:] for r in grown]))
    # The nodes where the rows end have all of them: a tree of one level, weighed by hand.
    small = quality.Forest((x.min(0), x.max(0)), trees=3, depth=1)
    left = [(x[:, small.feature[t, 1]] < small.cut[t, 1]).sum() for t in range(3)]
    counts = small.counts(x)
    assert [list(c) for c in counts] == [[0, 0, n, len(x) - n] for n in left] and len(x) > 4000
    weighed = small.weigh(counts, len(x))
    assert np.allclose(weighed.length[:, 2], [1 + np.interp(256 * n / len(x), range(257), [weighed.rest(k) for k in range(257)]) for n in left])
    # The threshold is the best over all rows that grew no tree.
    judge = stats.where(~quality.base_failed()).toPandas()
    judge = judge[[zlib.crc32(str(i).encode()) % 5 == 0 for i in judge.doc_id]]
    score, good = forest.scores(quality.features(judge.iloc[:, 1:].to_numpy())), judge.doc_id.to_numpy() % 5 > 0
    value = lambda t: good[score <= t].sum() / good.sum() - (~good)[score <= t].sum() / (~good).sum()
    assert len(judge) > 1200 and value(threshold) == pytest.approx(max(map(value, score)))


def test_quality_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.quality_verdicts(documents(spark, ODD), none).collect()
    assert len(out) == len(ODD) and not any(r.kept for r in out)
    assert quality.quality_verdicts(documents(spark, []), none).count() == 0


def test_bpe_equals_library(spark, small):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    rng = random.Random(3)
    pool = ["a", "b", "é", "É", "Σ", "ς", "İ", "ß", "ﬁ", "'s", "'ll", "'", "<|endoftext|>", "<|", "|>", " ", "\n", " ", " ", "\x85", "\x1c", "1", "²", "漢", "😀", "é", "́", "K", "_", "!!", "the", "aaa", "ſ"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["a" * 3000, "", "aaaa " * 100]
    texts += [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    coder = bpe.Bpe(bpe.default_path())
    ids, starts, words, word_starts = coder.encode([t.encode() for t in texts])
    for i, t in enumerate(texts):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[starts[i] : starts[i + 1]].tolist() == want, t
        assert coder.decoded_words(words[word_starts[i] : word_starts[i + 1]]).decode() == library.decode(want, skip_special_tokens=False)


def test_bpe_any_code_point():
    """The library's own version of Unicode decides, also for characters that Python or this package know otherwise."""
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    rng = random.Random(5)
    code = lambda: rng.choice([rng.randrange(0x20, 0x7F), rng.randrange(0x80, 0x3000), rng.randrange(0xA000, 0xD800), rng.randrange(0xE000, 0x110000), rng.randrange(0x10000, 0x20000)])
    texts = ["".join(chr(code()) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    coder = bpe.Bpe(bpe.default_path())
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        ids, starts, words, _ = coder.encode([t.encode()])
        assert ids.tolist() == want, ascii(t)
        assert coder.decode(ids) == coder.decoded_words(words) == library.decode(want, skip_special_tokens=False).encode()


def test_bpe_digests_decode_the_ids(spark, small):
    """On a whole table: what the digest of the decoded text says is what the ids decode to."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    coder = bpe.Bpe(bpe.default_path())
    for r in bpe.bpe_digests(docs, with_ids=True).collect():
        assert hashlib.sha256(coder.decode(np.array(r.ids, np.int64))).hexdigest() == r.decoded_sha256


def test_long_batches_are_cut_before_they_are_read():
    import pyarrow as pa
    from plumaria.llm.common import arrow_parts

    texts = ["x" * n for n in (5, 0, 3_000_000, 7, 1_500_000, 600_000)] + [None]
    parts = list(arrow_parts([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    assert [[len(t) for t in part] for _, part in parts] == [[5, 0], [3_000_000], [7, 1_500_000], [600_000, 0]]
    assert [b.num_rows for b, _ in parts] == [2, 1, 2, 2] and not list(arrow_parts([]))


def test_bpe_odd_rows(spark):
    docs = documents(spark, ODD)
    out = bpe.bpe_digests(docs, with_ids=True).collect()
    assert len(out) == len(ODD) and next(r for r in out if r.doc_id == 0).n_tokens == 0
    back = bpe.bpe_decode(bpe.bpe_encode(docs)).collect()
    assert {(r.doc_id, hashlib.sha256(r.decoded.encode()).hexdigest()) for r in back} == {(r.doc_id, r.decoded_sha256) for r in out}
    assert bpe.bpe_digests(documents(spark, [])).count() == 0


def brute_align(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_equals_table():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 30))
        score, start, end = decontam.align(a, b)
        assert score == brute_align(a, b)
        assert not score or brute_align(a, b[start:end]) == score


def test_leaks_edited_copies_and_blocks(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(40)] + [(40, None), (41, ""), (42, "lone"), (43, "two words")]
    docs, want = [], set()
    for d in range(60):
        text = [word() for _ in range(100)]
        if d % 2:
            passage = items[d % 40][1].split()
            for k in rng.sample(range(30), 5):
                passage[k] = word()
            text[50:50] = [passage[0].upper() + ",", *passage[1:]]
            want.add((d, d % 40))
        docs.append((d, " ".join(text)))
    docs += [(90, None), (91, ""), (92, "lone"), (93, "here are two words!"), (94, "two x words")]
    want |= {(92, 42), (93, 43)}
    items = spark.createDataFrame(items, "item_id long, text string")
    for size in (4_000_000, 2_000):
        out = decontam.leaks(documents(spark, docs), items, block_bytes=size).collect()
        assert {(r.doc_id, r.item_id) for r in out} == want
        assert all(45 <= r.start_word <= 60 or r.doc_id > 90 for r in out)
    kept = decontam.clean_documents(documents(spark, docs), items)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want} and len(kept.columns) == 6
    assert decontam.leaks(documents(spark, docs), items.limit(0)).count() == 0


def test_leaks_count_words_over_all_documents(spark, monkeypatch):
    rng, seen = random.Random(3), []
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(words, k=8))) for i in range(200)]
    items = spark.createDataFrame([(0, " ".join(words)), (1, "not there, w3!")], "item_id long, text string")
    choose = decontam.Block.choose_seeds

    def chosen(block, frequency):
        seen.append({w.decode(): int(frequency[i]) for w, i in block.vocabulary.items()})
        choose(block, frequency)

    monkeypatch.setattr(decontam.Block, "choose_seeds", chosen)
    decontam.leaks(documents(spark, docs), items)
    assert seen == [{w: sum(w in t.split() for _, t in docs) for w in [*words, "not", "there"]}]


def test_leaks_equal_alignment_of_all_pairs(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    usual = [word(2) for _ in range(12)]
    text = lambda n: [rng.choice(usual) if rng.random() < 0.4 else word(6) for _ in range(n)]
    items = [text(rng.randint(40, 60)) for _ in range(24)]
    docs = []
    for d in range(120):
        item = list(items[d % 24])
        if d >= 24 or d % 2:  # else a verbatim leak of every second item
            kind, k = d // 24, len(item)
            places = range(2, k, 3) if kind == 4 else rng.sample(range(k), round(k * rng.uniform(0.25, 0.34)))
            for p in sorted(places, reverse=True):
                item[p : p + 1] = [item[p], word(6)] if kind == 3 else [word(6)]
            if kind == 2:
                item[k // 2 : k // 2] = text(15)
        docs.append((d, " ".join(text(80) + item + text(80))))
    want = {(d, i) for d, t in docs for i, item in enumerate(items) if decontam.align(*map(np.array, (item, t.split())))[0] >= len(item)}
    assert 80 < len(want) < 120
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(documents(spark, docs), table).collect()} == want


def test_leaks_of_items_without_id(spark):
    item = "one two three four five six seven eight"
    docs = documents(spark, [(1, f"before {item} after"), (2, "something else")])
    for kind in ("long", "int", "string"):
        table = spark.createDataFrame([(None, item), (None, None)], f"item_id {kind}, text string")
        assert [tuple(r) for r in decontam.leaks(docs, table).collect()] == [(1, None, 1.0, 1, 9)]
        assert [r.doc_id for r in decontam.clean_documents(docs, table).collect()] == [2]


def test_chat_equals_sql_and_keeps_budget(spark, small):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant"]) if t else "system" if c % 3 else "user", "".join(rng.choice(["<|im_end|>", "<\\|", "é", "word ", "\n"]) for _ in range(rng.randint(0, 900 if c < 9 and t else 40)))) for c in range(12) for t in range(rng.randint(1, 30))]
    rows += [(50, 0, None, None), (50, 0, None, None), (51, None, "us<er\n%3C", "x"), (52, 0, "system", "alone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS idx", "'x' AS piece")
    windows = chat.chat_windows(turns)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns_ in by.items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns_)
        loss = "".join(t for r, t in turns_ if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns_), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.collect():
        assert not w.over_budget or w.n_turns - w.formatted.startswith("<|im_start|>system") <= 1
        assert w.formatted.count("<|im_start|>") == w.n_turns + w.n_context
    assert chat.chat_windows(turns.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    from plumaria.llm.queries import op1_chat_windows

    want = {r[0]: r for r in con.execute(chat.ORACLE_SQL).fetchall()}
    have = {r.conv_id: tuple(r) for r in op1_chat_windows(spark, small).collect()}
    assert have == want


def test_chat_windows_keep_the_budget(spark):
    """Only a turn that does not fit beside the system turn makes a window exceed the budget; turns of every size, and large system turns."""
    rng = random.Random(9)
    sizes = [[128, 128, 128, 383, 384]] + [[rng.choice([5, 60, 127, 129, 380, 384, 385, 500, 1000, 1500]) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    rows = []
    for c, turns in enumerate(sizes):
        system = rng.choice([0, 0, 50, 300, 700, 900, 1010, 2000])
        rows += [(c, 0, "system", "s" * (4 * system))] * (system > 0) + [(c, t + 1, ("user", "assistant")[t % 2], "x" * (4 * (n - 4))) for t, n in enumerate(turns)]
    out = chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    count = lambda text: (len(text) + 3) // 4 + 4
    for r in out:
        pieces = [p.split("\n", 1) for p in r.formatted.split("<|im_end|>\n")[:-1]]
        tokens = [count(text) for _, text in pieces]
        assert r.tokens == sum(tokens) and r.over_budget == (r.tokens > 1024)
        if r.over_budget:  # no history was added to what cannot fit, and there is one new turn besides the system turn
            system = "system" in pieces[0][0]
            assert r.n_context <= system and r.n_turns <= 1 + (system and r.window_no == 1)
    assert any(r.over_budget for r in out) and sum(r.n_context > 1 for r in out) > 20


def test_chat_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (7, 0, "user", "z" * 300_000), (7, 0, "user", "z" * 300_000), (8, 0, "system", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS idx", "'x' AS piece")
    got = {r.conv_id: r for r in chat.read_back(chat.chat_windows(turns)).collect()}
    assert got[None].turns == "\n\nuser\na\n" and got[7].n_turns == 2 and got[7].turns == ("user\n" + "z" * 300_000 + "\n") * 2 and got[8].turns == "system\n\n"
    assert chat.digests(chat.chat_windows(turns.limit(0))).count() == 0


def test_pii_work_is_linear():
    import time

    def took(text):
        began = time.perf_counter()
        pii.find_spans(text)
        return time.perf_counter() - began

    for seed in ("iban ", "http://a/", "account no 12 ", "1.1.1.", "a@", "+1 ", "4111-"):
        short, long = min(took(seed * 4000) for _ in range(3)), min(took(seed * 32000) for _ in range(2))
        assert long < 24 * max(short, 0.002), seed


def test_cuts_are_the_patterns():
    rng = random.Random(3)
    parts = ["'", "'", "s", "t", "re", "ve", "ll", "l", "m", "d", "r", " ", "\n", "1", "23", "!", '"', "é", "x", "\t"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14))).encode()
        starts, ends = bpe.cuts(np.frombuffer(text + b" " * 9, np.uint8))
        assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == re.findall(bpe.USUAL, text)


def test_bpe_long_pieces_and_mixed_texts():
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    texts = ["it's we'll 'quoted'", "a" * 9000 + " tail 12", "", "zero\0byte", "<|endoftext|> it's", "x" * 8 + " " + "x" * 9 + " " + "x" * 17, "ΣΑΣ ﬁn", "it's again"] * 2
    ids, starts, *_ = bpe.Bpe(bpe.default_path()).encode([t.encode() for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_merges_look_up_only_what_changed(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    coder, library, rng, asked = bpe.Bpe(bpe.default_path()), tokenizers.Tokenizer.from_file(bpe.default_path()), np.random.default_rng(5), []
    words = ["".join(rng.choice(list("aabcdeghilnorstuyéßñ"), n)) for n in [*range(1, 48), 200] * 12] + ["a" * n for n in range(1, 40)]
    raw = [w.encode() for w in words]
    monkeypatch.setattr(bpe.Bpe, "ranked", lambda self, left, right, f=bpe.Bpe.ranked: asked.append(len(left)) or f(self, left, right))
    ids, n = coder.merge(raw)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(w, add_special_tokens=False).ids for w in words]
    short = [w for w in raw if len(w) <= bpe.SHORT]
    assert sum(asked) < 8192 + 3 * sum(map(len, short))
    assert all(len(x) == 0 for x in coder.merge([])) and coder.merge([b"", b"ab", b""])[1].tolist() == [0, 1, 0]
