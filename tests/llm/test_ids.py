"""Token-id files: exact round trips."""

import struct
import zlib

import numpy as np
import pytest

from plumaria.llm import bpe, idfile


def test_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4096, 9000):
        ids = np.minimum(rng.zipf(1.3, n), 49_000).astype(np.int64)
        ids[::7] = 5
        data = idfile.pack([1, None], np.array([n - 1, 1]), ids)
        doc_ids, counts, back = idfile.unpack(data)
        assert doc_ids == [1, None] and counts.tolist() == [n - 1, 1] and (back == ids).all()
    broken = bytearray(data)
    broken[-20] ^= 255
    with pytest.raises((ValueError, IndexError)):
        idfile.unpack(bytes(broken))


def test_coded_words_stay_as_they_are():
    """Files that earlier versions wrote can be read."""
    places = np.arange(4096 * 3).reshape(4096, 3) ** 2 % 7919 % 900
    words = idfile.coded(places, np.array([4096, 4000, 77]), np.array([900, 900, 900]))
    assert [zlib.crc32(w.tobytes()) for w in words] == [1182735729, 1666933287, 2292067330]
    back = idfile.coded(None, np.array([4096, 4000, 77]), np.array([900, 900, 900]), words)
    assert all((back[:n, i] == places[:n, i]).all() for i, n in enumerate((4096, 4000, 77)))


def test_files(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(idfile.default_path())
    rows = [(i, f"Text number {i} with éclairs and <|endoftext|> " * (i % 7)) for i in range(200)] + [(900, None), (901, ""), (5, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS part")
    want, start = [], 0
    as_bytes = lambda t: b"".join(struct.pack("<I", i) for i in [*library.encode(t or "", add_special_tokens=False).ids, 1])
    for doc_id, raw in sorted(((d, as_bytes(t)) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        want.append((doc_id, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    got = [tuple(r) for r in idfile.read_ids(spark, idfile.write_ids(docs)).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert idfile.read_ids(spark, idfile.write_ids(docs.limit(0))).count() == 0


def test_foreseen_equals_step_by_step():
    rng = np.random.default_rng(4)
    rows, kinds = np.minimum(rng.zipf(1.4, (11, 700)), 300).astype(np.uint16) - 1, np.array([300] * 11)
    rows[3] = 7
    keys, marks = idfile.foreseen(rows.astype(np.uint16), kinds)
    for row, key, mark in zip(rows.tolist(), keys.tolist(), marks.tolist(), strict=True):
        last, a, b = ({}, {}), 300, 300
        for t, place in enumerate(row):
            held = [last[0].get(b, (0, 0)), last[1].get(a * 2053 + b & idfile.PAIRS - 1, (0, 0))]
            guess = held[1][0] or held[0][0]
            assert key[t] == guess
            assert mark[t] == held[0][1] * 2 + (held[0][0] == guess) + 16 * held[1][1] + 128 * (guess == place + 1)
            for table, context, (g, trust) in zip(last, (b, a * 2053 + b & idfile.PAIRS - 1), held, strict=True):
                table[context] = (place + 1, min(trust + 1, 7) if g == place + 1 else 1)
            a, b = b, place


def test_segments_are_filled_whatever_the_shuffle_partitions(spark):
    docs = spark.range(0, 3000, 1, 7).selectExpr("id AS doc_id", "repeat('word ', 1 + id % 9) AS text")
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 60)
    try:
        folder = idfile.write_ids(docs, segment_ids=9000)
        got = sorted((r.start, r.doc_id, r.n_tokens) for r in idfile.read_ids(spark, folder).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert [d for _, d, _ in got] == list(range(3000)) and [s for s, _, _ in got] == np.cumsum([0, *(n for _, _, n in got)])[:-1].tolist()
    sizes = [r.n_ids for r in spark.read.parquet(folder).select("n_ids").collect()]
    assert max(sizes) <= 9000 and len(sizes) < 1.6 * sum(sizes) / 9000 + spark.sparkContext.defaultParallelism


def test_narrowing_equals_whole_numbers():
    """Lanes that shift, and the border that a range is cut at, against Python's integers."""
    rng = np.random.default_rng(7)
    n = 3000
    low = rng.integers(0, 1 << 62, n).astype(np.uint64) * np.uint64(4) + np.uint64(3)
    low[::3] |= np.uint64(0xFFFFFF00)  # near a border
    span, size = rng.integers(1 << 16, 1 << 20, n).astype(np.uint64), rng.integers(16, 65537, n).astype(np.uint64)
    coder = idfile.Coder(n)
    coder.low[:], coder.range[:] = low, span
    coder.only(n)
    at, was = coder.narrow(size)
    want, cut = [], 0
    for i, (a, b) in enumerate(zip(low.tolist(), (span * size).tolist(), strict=True)):
        if b < 1 << 32:
            if a >> 32 != a + b >> 32:
                b, cut = -a % (1 << 32), cut + 1
            want.append((i, a))
            a, b = a << 32 & (1 << 64) - 1, b << 32
        assert (int(coder.low[i]), int(coder.range[i])) == (a, b)
    assert list(zip(at.tolist(), was.tolist(), strict=True)) == want and 0 < cut < len(want) < n


def test_places_and_ranges_of_few_and_of_many_kinds():
    rng = np.random.default_rng(8)
    for most, room in ((3, 4), (50_000, 50_001), (200_000, 200_001), (3_000_000, 1 << 20)):
        block = rng.integers(0, most + 1, 4096)
        block[0] = most
        distinct, at = idfile.places_in(block, np.empty(room, np.int32))
        assert (distinct == np.unique(block)).all() and (distinct[at] == block).all()
    for ids in (np.full(9000, 7), np.arange(9000), np.array([0]), np.arange(5000) % 2):
        assert (idfile.unpack(idfile.pack([1], np.array([len(ids)]), ids.astype(np.int64)))[2] == ids).all()
    # Sums of products stay below 2 ** 31, so that shares are had in 32 bits: one kind, as often as can be.
    shares = idfile.Shares(np.array([4096]), np.array([1]), False)
    shares.learn(np.zeros(4032, np.int64))
    shares.renew(4032)
    assert shares.counts.dtype == np.int32 and shares.cum.tolist() == [0, 65536]


def test_texts_known_to_be_valid_are_lowered_alike():
    pytest.importorskip("tokenizers")
    coder = idfile.loaded(idfile.default_path(), decoded=False)
    texts = ["Plain TEXT", "", "Éclair ÀÉ straße", "naïve café", "ΟΔΟΣ", "日本 text", "é joined", "odd   space", "a�b", "<|endoftext|> É", "\0 É"]
    texts = [t.encode() for t in texts]
    assert bpe.utf8_all(texts) and [coder.lowered(t, True) for t in texts] == [coder.lowered(t) for t in texts]
    assert coder.lowered(texts[2], True) == "éclair àé straße".encode()
    for broken in ([b"\xff"], [b"\xed\xa0\x80"], [b"fine", b"\xc3", b"\xa9"], [b"\xc3a\xa9"]):
        assert not bpe.utf8_all(broken)


def test_pieces_that_the_pattern_cut_before_keep_their_numbers():
    pytest.importorskip("tokenizers")
    coder = bpe.Bpe(idfile.default_path())
    for texts in (["  zyxqv wvu", "plain zyxqv"], ["zyxqv wvu newer", "  newer zyxqv"], ["wvu newer zyxqv newest"]):
        ids, starts, *_ = coder.encode([t.encode() for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [coder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(coder.words.values()) == list(range(len(coder.words))) and len(coder.lengths) == len(coder.words)
