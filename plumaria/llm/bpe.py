r"""BPE encoding and decoding in batched numpy merge rounds.

A tokenizer file of the tokenizers library (JSON; BPE with a suffix for word ends, NFC + white space + lower case, byte-level) gives
vocabulary and merges; nothing is trained. Texts are cut into the pieces that merges work on; the distinct
pieces of a batch that are not in the cache are encoded together: their symbols lie in one flat array, the pairs of neighbours get their ranks by
binary search over the sorted pair keys, and each round merges the pair of lowest rank in every piece at once, until no piece has one.

Texts whose characters outside ASCII are letters that the library's own rules treat plainly are cut by one pattern over bytes; other texts go through the library's normaliser
and pre-tokeniser, so that its version of Unicode decides in every case. With the pattern of `USUAL`, plain texts are cut in numpy passes over the bytes of many texts, and the pieces are looked up by
64-bit keys: of pieces of up to 8 bytes the bytes themselves, mixed reversibly; of longer ones a hash (two of the 500,000 of a cache would share one with a chance under 1e-8).

Defined cases: a null or empty text has no ids and decodes to the empty string; texts of any length are whole; repeated doc_ids each
give their row; strings of added tokens in a text become their ids, as in the library; other columns are ignored; an empty table gives no row.
The cache holds at most `CACHE` pieces of `CACHE_BYTES` together and starts anew beyond that, between batches.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

from plumaria.llm.common import WordIds, arrow_parts, arrow_rows, id_type, mixed

CACHE, CACHE_BYTES = 500_000, 32_000_000
#: The pattern that cuts() stands for, over bytes; slots of the direct lookup, in powers of two; bytes of a piece from which its text is cut by the pattern itself.
USUAL, SLOTS, LONG = rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z\x80-\xff0-9]+", 20, 4096
#: Kinds of bytes: white space, letters, digits, others.
SPACE, LETTER, DIGIT, OTHER = range(4)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = SPACE
KINDS[[*range(97, 123), *range(128, 256)]] = LETTER
KINDS[48:58] = DIGIT
KIND_BYTES, ASCII = KINDS.tobytes(), bytes(range(128))
#: The bytes that count of 8, by how many a piece has.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
NONE = np.iinfo(np.int64).max
#: Slots of the pairs that merge, in powers of two; a rank that no pair has; symbols of a piece that goes in a column, of 32 at most for `merged`, and columns at once.
PAIR_SLOTS, UNRANKED, SHORT, COLUMNS = 19, 1 << 25, 31, 8192


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def utf8_all(texts: list[bytes]) -> bool:
    """Whether all texts are valid UTF-8, as Python's strict decoder has it."""
    import pyarrow as pa

    try:
        pa.array([b"\n".join(texts)], pa.large_binary()).cast(pa.large_string())
    except pa.ArrowInvalid:
        return False
    return True


def cuts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of `USUAL` start and end in bytes that end in two blanks."""
    kind = np.frombuffer(raw.tobytes().translate(KIND_BYTES), np.uint8)
    starts = kind != SPACE
    ends = starts.copy()
    change = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    starts[1:] &= change
    ends[:-1] &= change | (kind[:-1] == DIGIT)
    quotes = np.flatnonzero((raw[:-2] == 39) & starts[:-2])
    one, two = raw[quotes + 1], raw[quotes + 2]
    short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
    tail = np.where(short, 1, np.where(((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")), 2, 0))
    quotes, tail = quotes[tail > 0], tail[tail > 0]
    starts[quotes + 1] = False
    after = quotes + tail + 1
    starts[after[kind[after] == LETTER]] = True
    ends[quotes] = False
    ends[quotes + tail] = True
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def piece_keys(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A key for each piece of raw, which has 8 bytes more than its pieces."""
    window = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    key = mixed(window[starts] & MASKS[np.minimum(lengths, 8)])
    at, done = np.flatnonzero(lengths > 8), 8
    while len(at):
        key[at] = mixed(key[at] * np.uint64(5) + (window[starts[at] + done] & MASKS[np.minimum(lengths[at] - done, 8)]) + np.uint64(done))
        done += 8
        at = at[lengths[at] > done]
    return key


class Bpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*self.vocab.values(), *self.added.values()])
        self.strings = [b""] * self.size
        for text, i in self.vocab.items():
            self.strings[i] = text.encode()
        for text, i in self.added.items():
            self.strings[i] = text
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, new = (np.array([self.vocab[x] for x in part], np.int64) for part in ([m[0] for m in merges], [m[1] for m in merges], [m[0] + m[1] for m in merges]))
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys, self.ranks, self.news = (left * self.size + right)[order], order, new[order]
        #: Where in keys the pair is that a hash names: -1 none, -2 several, which are searched for. By rank, what a merge makes.
        self.made = new.astype(np.int32)
        slot = self.pair_slots(self.keys)
        self.pairs = np.full(1 << PAIR_SLOTS, -1, np.int32)
        self.pairs[slot] = np.where(np.bincount(slot, minlength=len(self.pairs))[slot] > 1, -2, np.arange(len(slot)))
        #: Whether each token has one merge that makes it: then a merge's result cannot outrank the merge, and one round may merge all places.
        self.single = len(np.unique(new)) == len(new)
        chars = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.bytes = np.array([[self.vocab.get(c, -1), self.vocab.get(c + self.suffix, -1)] for c in chars], np.int64)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # Over bytes: letters of more than one byte are runs of bytes from 0x80, where a text has no other such characters.
        for unicode_class, plain in ((r"[\p{L}]", r"[a-z\x80-\xff]"), (r"[\p{N}]", "[0-9]"), (r"\p{L}\p{N}", r"a-z\x80-\xff0-9")):
            pattern = pattern.replace(unicode_class, plain)
        self.pattern = re.compile(pattern.encode())
        self.usual = self.pattern.pattern == USUAL
        self.specials = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if self.added else None
        self.plain = {chr(i) for i in range(128)}
        self.odd: set[str] = set()
        self.reset()

    def reset(self) -> None:
        self.words, self.held = WordIds(), 0
        self.slot_keys, self.slots = np.zeros(1 << SLOTS, np.uint64), np.full(1 << SLOTS, -1, np.int32)
        self.sorted_keys, self.sorted_at = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.lengths, self.decoded = np.zeros(0, np.int32), np.zeros(0, np.int64), []

    def probe(self, chars: set[str]) -> None:
        """Sorts characters: plain are letters that no rule joins with a neighbour or changes otherwise than Python does."""
        for c in chars:
            low = c.lower()
            letter = len(self.library.pre_tokenizer.pre_tokenize_str(f"a{low}a")) == 1
            same = self.library.normalizer.normalize_str(f"a{c}a") == f"a{low}a" and not any(map(unicodedata.combining, unicodedata.normalize("NFC", f"a{low}")[1:]))
            (self.plain if letter and same and len(low) == 1 and c != "Σ" and c < "\ud7a4" and not "\u1100" <= c <= "\u11ff" else self.odd).add(c)

    def pieces(self, text: bytes) -> list[bytes]:
        """The byte strings that merges work on; an added token stands as itself after a zero byte and a space, which no piece has."""
        if self.specials and any(t in text for t in self.added):
            out: list[bytes] = []
            for part in self.specials.split(text):
                out += [b"\0 " + part] if part in self.added else self.pieces(part) if part else []
            return out
        if text.isascii():
            return self.pattern.findall(text.lower())
        said = text.decode("utf-8", "replace")
        chars = set(said)
        if not chars <= self.plain:
            self.probe(chars - self.plain - self.odd)
            if not chars <= self.plain:
                found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(said))
                return [bytes(map(self.byte_of.__getitem__, piece)) for piece, _ in found]
        return self.pattern.findall(said.lower().encode())

    def lowered(self, text: bytes, valid: bool = False) -> bytes | None:
        """The text in lower case if it is plain, without added tokens and zero bytes: cuts() then finds its pieces. valid: whether it is known to be UTF-8, so that not all of it need be decoded to see."""
        if not self.usual or any(t in text for t in self.added) or b"\0" in text:
            return None
        if text.isascii():
            return text.lower()
        said = "" if valid else text.decode("utf-8", "replace")
        # Where nothing was replaced the bytes are whole characters, and those outside ASCII can be had alone.
        chars = set(said if "\ufffd" in said else text.translate(None, ASCII).decode())
        if not chars <= self.plain:
            self.probe(chars - self.plain - self.odd)
        if not chars <= self.plain:
            return None
        return (said or text.decode()).lower().encode() if "\ufffd" in chars or any(c.lower() != c for c in chars) else text.lower()

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' pieces in the cache, end to end, and where each text's start. New pieces get numbers; remember() is to follow."""
        valid = utf8_all(texts)
        low = [self.lowered(t, valid) for t in texts]
        joined = b"\n".join([t or b"" for t in low]) + b" " * 9
        raw = np.frombuffer(joined, np.uint8)
        begins, ends = cuts(raw)
        lengths = ends - begins
        first = np.searchsorted(begins, np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in low])]))
        if len(lengths) and lengths.max() >= LONG:
            for i in np.searchsorted(first, np.flatnonzero(lengths >= LONG), side="right") - 1:
                low[i] = None
        other = [i for i, t in enumerate(low) if t is None]
        if other:  # pieces of texts that turned out to be long are cut by the pattern
            kept = np.ones(len(begins), bool)
            for i in other:
                kept[first[i] : first[i + 1]] = False
            begins, lengths = begins[kept], lengths[kept]
            count = np.diff(first)
            count[other] = 0
            first = np.concatenate([[0], np.cumsum(count)])
        at = self.looked_up(piece_keys(raw, begins, lengths), joined, begins, lengths)
        if not other:
            return at, first
        parts = [at[a:b] for a, b in zip(first, first[1:], strict=False)]
        for i in other:
            parts[i] = np.array([self.words[w] for w in self.pieces(texts[i])], np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def looked_up(self, keys: np.ndarray, joined: bytes, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of pieces by their keys: from the slot that a key's last bits name, else by binary search; new ones by their bytes."""
        slot = (keys & np.uint64((1 << SLOTS) - 1)).astype(np.int64)
        at = np.where(self.slot_keys[slot] == keys, self.slots[slot], np.int32(-1))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return at
        new, sample, which = np.unique(keys[missing], return_index=True, return_inverse=True)
        place = np.searchsorted(self.sorted_keys, new)
        known = np.append(self.sorted_keys, np.uint64(0))[place] == new
        known &= place < len(self.sorted_keys)
        number = np.full(len(new), -1, np.int32)
        number[known] = self.sorted_at[place[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            # In the order of the texts, so that numbers do not depend on keys.
            fresh = fresh[np.argsort(sample[fresh], kind="stable")]
            spot = missing[sample[fresh]]
            words = [joined[b : b + n] for b, n in zip(begins[spot].tolist(), lengths[spot].tolist(), strict=True)]
            if self.words.keys().isdisjoint(words):  # else texts cut by the pattern had some of them; different keys are of different pieces
                at_first = len(self.words)
                self.words.update(zip(words, range(at_first, at_first + len(words)), strict=True))
                number[fresh] = np.arange(at_first, at_first + len(words))
            else:
                number[fresh] = [self.words[w] for w in words]
            fresh = np.sort(fresh)
            self.sorted_keys, self.sorted_at = np.insert(self.sorted_keys, place[fresh], new[fresh]), np.insert(self.sorted_at, place[fresh], number[fresh])
            free = fresh[self.slots[(new[fresh] & np.uint64((1 << SLOTS) - 1)).astype(np.int64)] < 0]
            to = (new[free] & np.uint64((1 << SLOTS) - 1)).astype(np.int64)
            to, one = np.unique(to, return_index=True)
            self.slot_keys[to], self.slots[to] = new[free[one]], number[free[one]]
        at[missing] = number[which]
        return at

    def pair_slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_SLOTS)).astype(np.int64)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, `UNRANKED` where no merge has them."""
        keys = left.astype(np.int64) * self.size + right
        at = self.pairs.take(self.pair_slots(keys))
        several = np.flatnonzero(at == -2)
        if len(several):
            at[several] = np.minimum(np.searchsorted(self.keys, keys[several]), len(self.keys) - 1)
        return np.where((self.keys.take(at, mode="clip") == keys) & (at >= 0), self.ranks.take(at, mode="clip"), UNRANKED)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, end to end, and how many each has. Short pieces go in columns of about the same length."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        raw, first = np.frombuffer(b"".join(words), np.uint8), np.cumsum(n) - n
        ends = np.zeros(len(raw), np.int64)
        ends[(first + n - 1)[n > 0]] = 1
        sym = self.bytes[raw, ends].astype(np.int32)
        rest = n > SHORT
        if len(sym) and sym.min() < 0:
            rest |= np.bincount(np.repeat(np.arange(len(words)), n)[sym < 0], minlength=len(words)) > 0
        order = np.argsort(n, kind="stable")
        order = order[(n[order] > 0) & ~rest[order]]
        ids, counts, found = [], np.zeros(len(words), np.int64), []
        for low in range(0, len(order), COLUMNS):
            at = order[low : low + COLUMNS]
            got, counts[at] = self.merged(sym, first[at], n[at])
            ids.append(got)
            found.append(at)
        if rest.any():
            at = np.flatnonzero(rest)
            got, counts[at] = self.merged_long([words[i] for i in at])
            ids.append(got)
            found.append(at)
        if not ids:
            return np.zeros(0, np.int32), counts
        ids, found = np.concatenate(ids), np.concatenate(found)
        out, size, start = np.empty(len(ids), np.int32), counts[found], (np.cumsum(counts) - counts)[found]
        out[np.repeat(start - np.cumsum(size) + size, size) + np.arange(len(ids))] = ids
        return out, counts

    def merged(self, sym: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of SHORT symbols at most, whose lengths rise, and how many each has.

        A column for each piece, flat: place k of piece i is at k * pieces + i. Each round merges the first pair of the lowest rank of each piece, as the library does; only the pairs at it get new ranks.
        """
        pieces, longest = len(n), int(n[-1])
        every, k = np.arange(pieces), np.arange(longest)[:, None]
        own = k < n
        sym = np.where(own, sym.take(first + k, mode="clip"), 0)
        rank = np.full((longest, pieces), UNRANKED << 5, np.int32)
        rank[:-1] = self.ranked(sym[:-1].ravel(), sym[1:].ravel()).reshape(longest - 1, pieces) << 5
        rank[:-1][~own[1:]] = UNRANKED << 5
        rank |= k.astype(np.int32)
        # Of each place the next one, and the one before plus 1, where 0 is none; a last row for what is past the end.
        after, before = np.repeat(np.arange(1, longest + 2, dtype=np.int8), pieces), np.repeat(np.arange(longest + 1, dtype=np.int8), pieces)
        sym, kept, live, n = sym.ravel(), own.copy().ravel(), every, n.astype(np.int8)
        flat = rank.ravel()
        while len(live):
            low = (rank if len(live) == pieces else rank[:, live]).min(0)
            more = low < UNRANKED << 5
            live, low = live[more], low[more]
            j, new = low & 31, self.made.take(low >> 5)
            at = j * pieces + live
            gone = after.take(at)
            gone_at = gone.astype(np.int64) * pieces + live
            next_ = after.take(gone_at)
            kept[gone_at], flat[gone_at], sym[at], after[at] = False, UNRANKED << 5, new, next_
            inside = next_ < n.take(live)
            next_at = next_.astype(np.int64) * pieces + live
            before[next_at] = j + 1
            flat[at] = np.where(inside, self.ranked(new, sym.take(next_at, mode="clip")), UNRANKED) << 5 | j
            back = before.take(at).astype(np.int32) - 1
            some = np.flatnonzero(back >= 0)
            back_at = back[some] * pieces + live[some]
            flat[back_at] = self.ranked(sym.take(back_at), new[some]) << 5 | back[some]
        kept = kept.reshape(longest, pieces).T
        return sym.reshape(longest, pieces).T[kept], kept.sum(1)

    def merged_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge() for pieces of any length, which lie end to end."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = np.array([len(w) for w in words], np.int64)
        last = np.zeros(len(raw), np.int64)
        last[np.cumsum(n) - 1] = 1
        sym, word = self.bytes[raw, last], np.repeat(np.arange(len(words)), n)
        sym, word = sym[sym >= 0], word[sym >= 0]
        done_sym, done_word = [], []
        while len(sym):
            key = np.full(len(sym), -1, np.int64)
            same = word[1:] == word[:-1]
            key[:-1][same] = (sym[:-1] * self.size + sym[1:])[same]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], NONE)
            starts = np.flatnonzero(np.append(True, ~same))
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            over = low == NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            pick = (rank == low) & ~over
            where = np.arange(len(sym))
            if self.single:  # of places that overlap, as in aaa, every other one
                run = where - np.maximum.accumulate(np.where(pick, -1, where))
                pick &= run % 2 == 1
            else:
                first = np.minimum.reduceat(np.where(pick, where, NONE), starts)
                pick &= where == np.repeat(first, np.diff(np.append(starts, len(sym))))
            sym = np.where(pick, self.news[at], sym)
            keep = ~over
            keep[1:] &= ~pick[:-1]
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces, end to end, and how many each has."""
        fixed = [i for i, w in enumerate(words) if w[:2] == b"\0 "] if b"\0 " in b"".join(words) else []
        plain = [b"" if w[:2] == b"\0 " else w for w in words] if fixed else words
        ids, n = self.merge(plain) if any(plain) else (np.zeros(0, np.int32), np.zeros(len(words), np.int64))
        if fixed:
            at = (np.cumsum(n) - n)[fixed]
            ids = np.insert(ids, at, [self.added[words[i][2:]] for i in fixed]).astype(np.int32)
            n[fixed] += 1
        return ids, n

    def remember(self, words: list[bytes], texts: bool) -> None:
        strings, found = self.strings, []
        for i in range(0, len(words), 50_000):
            ids, n = self.learn(words[i : i + 50_000])
            found.append((ids, n))
            if texts:
                listed, start = ids.tolist(), 0
                for length in n.tolist():
                    self.decoded.append(b" ".join([strings[i] for i in listed[start : start + length]]))
                    start += length
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in found)])
        self.lengths = np.concatenate([self.lengths, *(n for _, n in found)])
        self.held += sum(map(len, words))

    def encode(self, texts: list[bytes], decoded: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, where each text's start; the texts' pieces, and where each text's start. decoded: whether decoded_words() may be asked."""
        if len(self.words) > CACHE or self.held > CACHE_BYTES:
            self.reset()
        known = len(self.words)
        at, starts = self.numbers(texts)
        if len(self.words) > known:
            self.remember(list(islice(reversed(self.words), len(self.words) - known))[::-1], decoded)
        n = self.lengths.take(at)
        total = np.zeros(len(at) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        begin = np.cumsum(self.lengths) - self.lengths
        at_ids = np.repeat(begin.take(at) - total[:-1], n)
        at_ids += np.arange(len(at_ids))
        return self.ids.take(at_ids), total[starts], at, starts

    def decode(self, ids: np.ndarray) -> bytes:
        """As the library does without a decoder: the tokens' strings, a space between."""
        return b" ".join([self.strings[i] for i in ids.tolist()])

    def decoded_words(self, pieces: np.ndarray) -> bytes:
        """decode() of the ids of these pieces of the cache."""
        return b" ".join([d for d in map(self.decoded.__getitem__, pieces.tolist()) if d])


@lru_cache(4)
def loaded(path: str, decoded: bool = True) -> Bpe:
    """One of each file for a worker: its cache serves all tasks of the worker. decoded: as in encode(); such coders and others share no cache, as only theirs has all strings."""
    return Bpe(path)


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for each row of docs."""
    path = path or default_path()

    def run(batches):
        import pyarrow as pa

        bpe = Bpe(path)
        for batch, texts in arrow_parts(batches):
            ids, starts, *_ = bpe.encode(texts)
            yield arrow_rows({"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, decoded string) of rows of (doc_id, ids)."""
    path = path or default_path()

    def run(batches):
        bpe = Bpe(path)
        for batch in batches:
            rows = batch.column("ids").to_pylist()
            yield arrow_rows({"doc_id": batch.column("doc_id"), "decoded": [bpe.decode(np.array(r or [], np.int64)).decode() for r in rows]})

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type(encoded)}, decoded string")


def bpe_digests(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]): encoding and decoding in one pass, so that ids need not leave the worker."""
    path = path or default_path()

    def run(batches):
        import pyarrow as pa

        bpe = loaded(path)
        for batch, texts in arrow_parts(batches):
            ids, starts, pieces, piece_starts = bpe.encode(texts)
            raw = ids.astype("<u4")
            out = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": np.diff(starts),
                "ids_sha256": [hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(starts, starts[1:], strict=False)],
                "decoded_sha256": [hashlib.sha256(bpe.decoded_words(pieces[a:b])).hexdigest() for a, b in zip(piece_starts, piece_starts[1:], strict=False)],
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
            yield arrow_rows(out)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
