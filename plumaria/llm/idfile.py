r"""Token-id files with an adaptive context-mixing range coder.

A segment is one binary value: a header (doc_ids and their numbers of ids), then blocks of `BLOCK` ids. Each block is coded on its own, from a fresh
state, and carries a CRC-32 of its ids, so that any block can be read or found damaged alone. Segments are rows of a Parquet table, so
that every store Spark writes to can hold them.

A block starts with its distinct ids; what follows are places in that list. Each place is predicted by the order-2 and order-1 contexts (what followed there
last, with a confidence) and by order-0 counts. Adaptive probabilities of the three are mixed in the logistic domain with weights that
learn, in integers only, and the mix gives the share of the range that says the prediction holds. The rest of the range is dealt out by order-0 counts, brought
up to date at the steps of `FRESH`. A carryless 64-bit range coder takes one decision an id. Blocks are lanes of numpy arrays: encoder and decoder
take one step for all blocks at a time. What the encoder can know before its steps (guesses, shares, whether a guess holds) it finds in passes over many steps.

Defined cases: a null or empty text has the end id alone; texts of any length are whole, and a segment has whole documents; rows are in ascending doc_id order, nulls
first, and rows that repeat a doc_id each keep their ids; an empty table gives no segment.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumaria.llm.bpe import default_path, loaded
from plumaria.llm.common import arrow_parts, arrow_rows, shared_dir, written

BLOCK, RATE, PAIRS = 4096, 24, 4096
#: Steps before which the order-0 shares are computed anew from the counts so far.
FRESH = frozenset([0, 64, 192, 448, 960, 1984])
U = np.uint64


class Numbers(dict):
    """Numbers of one type as arrays without a dimension, made when first asked for: of a Python number numpy makes one at each call, for about what a step's lanes cost."""

    def __init__(self, kind: type):
        self.kind = kind

    def __missing__(self, number: float) -> np.ndarray:
        self[number] = made = np.array(number, self.kind)
        return made


U16, I32, U32, I64, U64, REAL = map(Numbers, (np.uint16, np.int32, np.uint32, np.int64, np.uint64, np.float64))
MASK32 = 0xFFFFFFFF
STRETCH = np.array([int(round(256 * np.log((p + 0.5) / (4096.5 - p)))) for p in range(4097)], np.int32)
LEVELS = STRETCH.astype(np.int16)
#: In 65,536ths; a miss keeps a sixteenth, so that each place, of 16 of 65,536 at least, keeps a share.
SQUASH = np.array([min(61440, max(32, int(round(65536 / (1 + np.exp(-x / 256)))))) for x in range(-2048, 2048)], np.int32)


class Coder:
    """Low end and range of each lane; the range is 2 ** 32 at least before each decision of 16 bits. All types of a step are alike, as numpy is slow where it has to convert within one."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)

    def only(self, n: int) -> None:
        """From now on the first n lanes alone; their arrays are views, so that those of the others stay as they are."""
        self.l, self.r = self.low[:n], self.range[:n]
        self.t, self.need = np.empty(n, U), np.empty(n, bool)

    def narrow(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range, a 65,536th of what it was, becomes that of the decision. Lanes that need a word of 32 bits shift by it: which these are, and their low ends before."""
        span = self.r
        span *= size
        at = np.less_equal(span, U64[MASK32], out=self.need).nonzero()[0]
        low, left = self.l.take(at), span.take(at)
        # Where the high words of both ends differ, the range is cut at the border between them.
        ends = low + left
        ends ^= low
        far = (ends > U64[MASK32]).nonzero()[0]
        if len(far):
            left[far] = U64[0] - low.take(far) & U64[MASK32]
        left <<= U64[32]
        span[at] = left
        self.l[at] = low << U64[32]
        return at, low


class Writer(Coder):
    """Codes decisions; words() has those of each lane."""

    def __init__(self, lanes: int):
        super().__init__(lanes)
        self.out: list[tuple[np.ndarray, np.ndarray]] = []

    def code(self, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Decisions of the first lanes, a row for each step."""
        self.only(starts.shape[1])
        low, span, t, said = self.l, self.r, self.t, []
        for start, size in zip(starts, sizes, strict=True):
            span >>= U64[16]
            low += np.multiply(span, start, out=t)
            said.append(self.narrow(size))
        at, was = (np.concatenate(x) for x in zip(*said, strict=True))
        self.out.append((at, (was >> U64[32]).astype(np.uint32)))

    def words(self) -> list[np.ndarray]:
        every = np.arange(len(self.low))
        self.out += [(every, (self.low >> U64[32]).astype(np.uint32)), (every, (self.low & U64[MASK32]).astype(np.uint32))]
        lanes, said = (np.concatenate(x) for x in zip(*self.out, strict=True))
        order = np.argsort(lanes.astype(np.uint16) if len(every) < 1 << 16 else lanes, kind="stable")
        return np.split(said[order], np.cumsum(np.bincount(lanes, minlength=len(every)))[:-1])


class Reader(Coder):
    """Where the code of each lane is above its low end, and the words that follow."""

    def __init__(self, words: list[np.ndarray]):
        super().__init__(len(words))
        pad = np.zeros(4, np.uint32)
        self.words = np.concatenate([x for w in words for x in (w, pad)])
        self.at = np.cumsum([0, *(len(w) + 4 for w in words)])[:-1]
        self.above = (self.words[self.at].astype(U) << U64[32]) | self.words[self.at + 1]
        self.at += 2

    def only(self, n: int) -> None:
        super().only(n)
        self.d, self.a, self.x, self.where, self.most = self.above[:n], self.at[:n], np.empty(n, U), np.empty(n, np.int32), np.full(n, 65535, np.int32)

    def target(self) -> np.ndarray:
        """Where in 0 .. 65535 the code of each lane is; the next call writes into the same array."""
        self.r >>= U64[16]
        self.where[:] = np.floor_divide(self.d, self.r, out=self.x)  # 65,536 at most, as the range was 2 ** 32 at least
        return np.minimum(self.where, self.most, out=self.where)

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        x, t = self.x, self.t
        x[:] = start
        np.multiply(self.r, x, out=t)
        self.l += t
        self.d -= t
        x[:] = size
        at, _ = self.narrow(x)
        d, a = self.d.take(at), self.a.take(at)
        d <<= U64[32]
        d |= self.words.take(a, mode="clip").astype(U)
        self.d[at] = d
        a += I64[1]
        self.a[at] = a


class Shares:
    """The shares of order 0 of all lanes. Tables by place lie end to end, a lane's and then an entry more, which stands for "none" and for the end of the range."""

    def __init__(self, lengths: np.ndarray, kinds: np.ndarray, slots: bool):
        self.lengths, self.kinds = lengths, kinds
        self.at = np.cumsum(kinds + 1) - kinds - 1
        self.ends, size = self.at + kinds, int((kinds + 1).sum())
        self.counts = np.ones(size, np.int32)
        self.counts[self.ends] = 0
        self.cum, self.level = np.zeros(size, np.uint32), np.zeros(size + 1, np.int16)
        #: What the shares of the lanes before sum up to; sums are taken modulo 2 ** 32.
        self.before = np.repeat(np.arange(len(kinds)).astype(np.uint32) << U32[16], kinds + 1)
        self.slots, self.number = None, (np.arange(size) - np.repeat(self.at, kinds + 1)).astype(np.int16) if slots else None

    def learn(self, places: np.ndarray) -> None:
        """places: of the tables, as often as they came."""
        self.counts += RATE * np.bincount(places.ravel(), minlength=len(self.counts)).astype(np.int32)

    def renew(self, t: int) -> None:
        scale = ((65536 - 16 * self.kinds) << 15) // (self.kinds + RATE * np.minimum(t, self.lengths))
        share = np.repeat(scale.astype(np.int32), self.kinds + 1)
        share *= self.counts  # below 2 ** 31, as all counts of a lane times its scale are
        share >>= I32[15]
        share += I32[16]
        share[self.ends] = 0
        share[self.ends - 1] += 65536 - np.add.reduceat(share, self.at)
        self.level[1:] = LEVELS.take(share >> I32[4])  # of place k at k + 1: a guess is kept plus 1
        np.cumsum(share, dtype=np.uint32, out=self.cum)
        self.cum -= share.view(np.uint32)
        self.cum -= self.before
        self.cum[self.ends] = 65536
        if self.number is not None:  # the place at each 16th of the range: no share is less, so the one sought is it or the next
            first = self.cum + U32[15] >> U32[4]
            width = np.diff(first.astype(np.int64), append=0)
            width[self.ends] = 0
            self.slots = np.repeat(self.number, width)


class Mixer:
    """Adaptive probabilities, 16 a lane for order 1 and, after these, 8 a lane for order 2, and the weights of the three orders."""

    def __init__(self, lanes: int):
        self.sure, self.weights = np.full(lanes * 24, 32768, np.int32), np.full((3, lanes), 22000, np.int32)
        self.lanes = lanes

    def only(self, n: int) -> None:
        every = np.arange(n)
        self.w, self.m, self.at_v, self.at_dot = self.weights[:, :n].copy(), np.empty((3, n), np.int32), np.empty((2, n), np.int64), np.empty(n, np.int64)
        self.v, self.new, self.error = np.empty((2, n), np.int32), np.empty((2, n), np.int32), np.empty(n, np.int32)
        self.at_16, self.at_8 = every * 16, self.lanes * 16 + every * 8

    def close(self) -> None:
        self.weights[:, : self.w.shape[1]] = self.w

    def mix(self, at: np.ndarray, s: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The share of the guesses. at: which of the probabilities hold; s: the third row has the level of order 0, the others are filled in."""
        v = self.sure.take(at, out=self.v, mode="clip")
        self.at_v[:] = np.right_shift(v, I32[4], out=self.new)
        STRETCH.take(self.at_v, out=s[:2], mode="clip")
        dot, m, level = np.multiply(self.w, s, out=self.m)
        dot += m
        dot += level
        dot >>= I32[16]
        dot += I32[2048]
        self.at_dot[:] = dot
        return SQUASH.take(self.at_dot, out=out, mode="clip")

    def learn(self, at: np.ndarray, s: np.ndarray, top: np.ndarray, p: np.ndarray) -> None:
        """top: 65535 where the guess held, else 0."""
        error = np.subtract(top, p, out=self.error)
        error *= I32[3]
        error >>= I32[3]
        m = np.multiply(s, error, out=self.m)
        m >>= I32[12]
        self.w += m
        new = np.subtract(top, self.v, out=self.new)
        new >>= I32[5]
        new += self.v
        self.sure[at.ravel()] = new.ravel()


def foreseen(rows: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of rows (lane by lane) the guess plus 1, or 0, and in bits what is known of it: 0 to 3 which probability of order 1 holds, 4 to 6 which of order 2, 7 whether the guess is right.

    The encoder knows what comes, so what followed in each context is found by sorting a lane's places by context, not step by step.
    """
    lanes, steps = rows.shape
    keys, marks = np.empty((lanes, steps), np.uint16), np.empty((lanes, steps), np.uint8)
    for low in range(0, lanes, 8):
        part = rows[low : low + 8]
        none = kinds[low : low + 8, None].astype(np.uint16)
        one = np.concatenate([none, part[:, :-1]], 1)
        two = (np.concatenate([none, one[:, :-1]], 1) * np.uint16(2053) + one) & np.uint16(PAIRS - 1)
        said, size = part.ravel(), part.size
        first, found = np.arange(0, size, steps), []
        for context in (one, two):
            order = np.argsort(context, 1, kind="stable")
            order += first[:, None]
            order = order.ravel()
            c, s = context.ravel()[order], said[order]
            same, again = np.empty(size, bool), np.empty(size, bool)
            np.equal(c[1:], c[:-1], out=same[1:])
            same[first] = False
            np.equal(s[1:], s[:-1], out=again[1:])
            again &= same
            # How often it came again in a row, up to 6: a byte more for each of so many that lie together.
            once = again.view(np.uint8)
            run, together = once.copy(), once
            for _ in range(5):
                together = np.append(np.uint8(0), together[:-1] & once[1:])
                run += together
            # What followed last plus 1, times 8, plus how often in a row: up to 7.
            e = (s << np.uint16(3)) + run + np.uint16(9)
            entry = np.zeros(size, np.uint16)
            entry[order[1:]] = e[:-1] * same[1:]
            found.append((entry >> np.uint16(3), (entry & np.uint16(7)).astype(np.uint8)))
        (guess_1, trust_1), (guess_2, trust_2) = found
        key = guess_1 * (guess_2 == 0)
        key += guess_2
        keys[low : low + 8] = key.reshape(part.shape)
        mark = trust_2 << np.uint8(3)
        mark += trust_1
        mark <<= np.uint8(1)
        mark += (guess_1 == key).view(np.uint8)
        mark += (key == said + np.uint16(1)).view(np.uint8) << np.uint8(7)
        marks[low : low + 8] = mark.reshape(part.shape)
    return keys, marks


def spells(lengths: np.ndarray):
    """(first step, end, lanes) of stretches of steps that have the same lanes and shares: all FRESH are multiples of 64."""
    steps = int(lengths.max())
    cuts = np.unique(np.concatenate([np.arange(0, steps, 64), lengths[lengths > 0]])).tolist()
    for t, end in zip(cuts, cuts[1:], strict=False):
        yield t, end, int((lengths > t).sum())


def encode(rows: np.ndarray, lengths: np.ndarray, kinds: np.ndarray) -> list[np.ndarray]:
    """The words of each lane. rows: a lane's places in each; row i has lengths[i] of kinds[i] kinds."""
    lanes = len(lengths)
    keys, marks = foreseen(rows, kinds)
    coder, shares, mixer, since = Writer(lanes), Shares(lengths, kinds, False), Mixer(lanes), 0
    for t, end, n in spells(lengths):
        at_k = shares.at[:n, None]
        if t in FRESH:
            if t:
                shares.learn(at_k + rows[:n, since:t])
                since = t
            shares.renew(t)
        mixer.only(n)
        places = at_k + rows[:n, t:end]
        key, mark = keys[:n, t:end], marks[:n, t:end].T.copy()
        opens, closes = shares.cum.take(places).T, shares.cum.take(places + 1).T
        s, at = np.empty((end - t, 3, n), np.int32), np.empty((end - t, 2, n), np.int64)
        s[:, 2] = shares.level.take(at_k + key).T
        np.add(mixer.at_16, mark & 15, out=at[:, 0])
        np.add(mixer.at_8, mark >> 4 & 7, out=at[:, 1])
        hit = mark > 127
        top = hit * np.int32(65535)
        # Without a guess what is left is the least share, so that q stays below 65,536 and products in 32 bits.
        most, shared = np.where(key.T > 0, np.int32(65536), np.int32(16)), np.empty((end - t, n), np.int32)
        for i in range(end - t):
            p = mixer.mix(at[i], s[i], shared[i])
            np.minimum(p, most[i], out=p)
            mixer.learn(at[i], s[i], top[i], p)
        mixer.close()
        p, q = shared.view(np.uint32), (65536 - shared).view(np.uint32)
        start = opens * q >> 16
        size = (closes * q >> 16) - start
        coder.code(np.where(hit, 0, start + p).astype(U), np.where(hit, p, size).astype(U))
    return coder.words()


def decode(words: list[np.ndarray], lengths: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The places that encode() had, a row for each step."""
    lanes, every = len(lengths), np.arange(len(lengths))
    out = np.zeros((int(lengths.max()), lanes), np.uint16)
    coder, shares, mixer, since, before = Reader(words), Shares(lengths, kinds, True), Mixer(lanes), 0, 0
    cum, level = shares.cum, shares.level
    # What followed in each context of order 1 and, after these, of order 2: the place plus 1, times 8, plus a confidence of 1 to 7. Steps take both orders at once, as rows.
    followed = np.empty(len(cum) + lanes * PAIRS, np.uint16)  # empty, then filled: numpy asks for large pages for it then
    followed[:] = 0
    for t, end, n in spells(lengths):
        if n != before:
            before, at_k, at_pairs, at_slots = n, shares.at[:n], len(cum) + every[:n] * PAIRS, every[:n] * 4096
            above, none = at_k + 1, kinds[:n].astype(np.uint16)
            followed_at, sure_at, both_at, i, at_key, wide = *(np.empty((2, n), np.int64) for _ in range(3)), *(np.empty(n, np.int64) for _ in range(3))
            s, top, p, q, held, some, hit, miss = np.empty((3, n), np.int32), *(np.empty(n, np.int32) for _ in range(7))
            e, guess, trust, new, key, other = *(np.empty((2, n), np.uint16) for _ in range(4)), *(np.empty(n, np.uint16) for _ in range(2))
            levels, slot, both, y, scale = np.empty(n, np.int16), np.empty(n, np.int16), np.empty((2, n), np.uint32), np.empty(n), np.empty(n)
            flat_at, flat_new, (guess_1, guess_2), trust_1, found, (opens, closes) = followed_at.ravel(), new.ravel(), guess, trust[0], both_at[0], both
            one, six, eight, least = np.full(n, 1, np.uint16), np.full((2, n), 6, np.uint16), np.full((2, n), 8, np.uint16), np.full(n, 16, np.int32)
            np.add(at_k, out[t - 1, :n] if t else none, out=followed_at[0])
            coder.only(n)
            mixer.only(n)
            sure_of = np.stack([mixer.at_16 + 1, mixer.at_8])
            p_bits, q_bits, some_bits, miss_bits = (x.view(np.uint32) for x in (p, q, some, miss))
        if t in FRESH:
            if t:
                shares.learn(at_k + out[since:t, :n])
                since = t
            shares.renew(t)
            slots = shares.slots
        for step in range(t, end):
            # Of 16 bits the lowest twelve are those of the number that PAIRS is a divisor for.
            np.multiply(out[step - 2, :n] if step > 1 else none, U16[2053], out=key)
            key += out[step - 1, :n] if step else none
            key &= U16[PAIRS - 1]
            wide[:] = key
            np.add(at_pairs, wide, out=followed_at[1])
            followed.take(followed_at, out=e, mode="clip")
            np.right_shift(e, U16[3], out=guess)
            np.bitwise_and(e, U16[7], out=trust)
            # The guess of order 2, or where that is 0 the one of order 1; masks here and below, as numpy is slow where it has to choose.
            np.minimum(guess_2, one, out=key)
            key -= U16[1]
            key &= guess_1
            key |= guess_2
            at_key[:] = key
            at_key += at_k
            # Twice the confidence of order 1, and 1 more, which is in sure_of, unless its guess is another.
            np.bitwise_xor(guess_1, key, out=other)
            trust_1 += trust_1
            trust_1 -= np.minimum(other, one, out=other)
            sure_at[:] = trust.view(np.int16)
            sure_at += sure_of
            s[2] = level.take(at_key, out=levels, mode="clip")
            mixer.mix(sure_at, s, held)
            # Without a guess no share is held, and what is left is the least one, so that q stays below 65,536 and products in 32 bits.
            some[:] = key
            some <<= I32[16]
            np.minimum(held, some, out=held)
            np.maximum(held, least, out=p)
            np.subtract(I32[65536], p, out=q)
            x = coder.target()
            np.subtract(x, held, out=hit)
            hit >>= I32[31]  # all bits of a hit, else none
            np.invert(hit, out=miss)
            x -= p
            x &= miss
            # The place whose range has the last y with (y * q >> 16) <= x is that of the 16th y is in or the next; lanes with a hit find the first place.
            # The 16th is (65536 x + 65535) / 16 q, rounded down: never nearer than 2 ** -21 to the next whole number, and 2 ** 16 at most.
            y[:] = x
            y *= REAL[4096]
            y += REAL[65535 / 16]
            scale[:] = q
            y /= scale
            i[:] = y
            i += at_slots
            i[:] = slots.take(i, out=slot, mode="clip")
            i += above
            cum.take(i, out=opens, mode="clip")
            opens *= q_bits
            opens >>= U32[16]
            np.subtract(x, opens.view(np.int32), out=some)
            some >>= I32[31]
            wide[:] = some
            np.add(i, wide, out=found)
            np.add(found, I64[1], out=both_at[1])
            cum.take(both_at, out=both, mode="clip")
            both *= q_bits
            both >>= U32[16]
            closes -= opens
            opens += p_bits
            opens &= miss_bits
            closes &= miss_bits
            np.bitwise_and(p, hit, out=some)
            closes |= some_bits
            coder.take(opens, closes)
            at_key -= I64[1]
            at_key -= found
            wide[:] = hit
            at_key &= wide
            found += at_key
            said = out[step, :n]
            said[:] = np.subtract(found, at_k, out=wide)
            # What was coded teaches every order.
            mixer.learn(sure_at, s, np.bitwise_and(hit, I32[65535], out=top), p)
            # The place plus 1, times 8, plus 1; where it was guessed, one more than the confidence was, up to 7.
            np.left_shift(said, U16[3], out=key)
            key += U16[8]
            np.minimum(np.bitwise_xor(e, key, out=new), eight, out=new)
            new &= U16[7]
            np.minimum(new, six, out=new)
            key += U16[1]
            new += key
            followed[flat_at] = flat_new
            followed_at[0] = found
        mixer.close()
    return out


def coded(places: np.ndarray | None, lengths: np.ndarray, kinds: np.ndarray, words: list[np.ndarray] | None = None):
    """Encodes places (BLOCK x lanes; column i has lengths[i] of kinds[i] kinds) to words, or decodes words to places. Lengths never rise from lane to lane."""
    return decode(words, lengths, kinds) if places is None else encode(np.ascontiguousarray(places.T, np.uint16), lengths, kinds)


def places_in(block: np.ndarray, scratch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a block, rising, and the place of each of its ids among them. scratch: room for a number for each id; ids beyond it are searched for."""
    if len(scratch) <= 1 << 16 and block.max() < len(scratch):
        seen = np.zeros(-(-len(scratch) // 8) * 8, bool)
        seen[block] = True
        some = np.flatnonzero(seen.view(np.uint64))  # few of the eights have one
        at = np.flatnonzero(seen.reshape(-1, 8)[some])
        distinct = (some[at >> 3] << 3) + (at & 7)
    else:
        ids = np.sort(block, kind="stable")
        distinct = ids[np.append(True, ids[1:] != ids[:-1])].astype(np.int64)
        if distinct[-1] >= len(scratch):
            return distinct, np.searchsorted(distinct, block)
    scratch[distinct] = np.arange(len(distinct))
    return distinct, scratch[block]


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of documents, their ids end to end."""
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    kinds, places = [], np.zeros((len(blocks), BLOCK), np.uint16)
    scratch = np.empty(min(int(ids.max(initial=0)) + 1, 1 << 20), np.int32)
    for i, block in enumerate(blocks):
        distinct, at = places_in(block, scratch)
        kinds.append(distinct)
        places[i, : len(block)] = at
    lengths = np.array([len(b) for b in blocks], np.int64)
    words = coded(places.T, lengths, np.array([len(k) for k in kinds], np.int64))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = struct.pack("<5sqqq", b"PLID3", len(doc_ids), len(ids), len(blocks)) + known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + counts.astype("<i8").tobytes()
    parts = [head]
    for block, distinct, coded_words in zip(blocks, kinds, words, strict=True):
        small = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)  # gaps seldom repeat in runs
        listed = small.compress(np.diff(distinct, prepend=0).astype("<u4").tobytes())
        listed += small.flush()
        parts += [struct.pack("<IIIII", len(block), len(distinct), len(listed), len(coded_words), zlib.crc32(block.astype("<u4").tobytes())), listed, coded_words.astype("<u4").tobytes()]
    return b"".join(parts)


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, counts and ids of a segment. Raises ValueError where a checksum does not hold."""
    magic, docs, total, n = struct.unpack_from("<5sqqq", data)
    if magic != b"PLID3":
        raise ValueError("not a segment of token ids")
    at = struct.calcsize("<5sqqq")
    known = np.frombuffer(data, np.uint8, docs, at)
    doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(data, "<i8", docs, at + docs), known, strict=True)]
    counts = np.frombuffer(data, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    lengths, kinds, words, sums = [], [], [], []
    for _ in range(n):
        length, distinct, listed, size, crc = struct.unpack_from("<IIIII", data, at)
        at += 20
        kinds.append(np.cumsum(np.frombuffer(zlib.decompress(data[at : at + listed]), "<u4").astype(np.int64)))
        words.append(np.frombuffer(data, "<u4", size, at + listed))
        at += listed + 4 * size
        lengths.append(length)
        sums.append(crc)
    places = coded(None, np.array(lengths), np.array([len(k) for k in kinds]), words)
    out = [k[at[:m]] for k, m, at in zip(kinds, lengths, np.ascontiguousarray(places.T), strict=True)]
    for i, (block, crc) in enumerate(zip(out, sums, strict=True)):
        if zlib.crc32(block.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
    return doc_ids, counts, np.concatenate(out)


def parts_of(total: int, segment_ids: int, cores: int) -> int:
    """So many parts that each is a segment of five sixths of segment_ids, as a step of the coder costs about the same for few blocks as for many; of few ids so many that all cores have some, an eighth of a segment at least."""
    return max(-(-total * 6 // (segment_ids * 5)), min(cores, -(-total * 8 // segment_ids)), 1)


def write_ids(docs: DataFrame, path: str | None = None, end_id: int = 1, segment_ids: int = 8_000_000, folder: str | None = None) -> str:
    """Writes segments (part, seq, before, n_ids, data) in ascending doc_id order and returns their folder; before: ids of the part's earlier segments."""
    import uuid

    spark, path = docs.sparkSession, path or default_path()
    folder = folder or f"{shared_dir(spark)}/plumaria-ids-{uuid.uuid4().hex}"

    def encode(batches):
        import pyarrow as pa

        coder = loaded(path, decoded=False)
        for batch, texts in arrow_parts(batches):
            ids, starts, *_ = coder.encode(texts, decoded=False)
            small, n = max(int(ids.max(initial=0)), end_id) < 1 << 16, np.diff(starts) + 1
            raw, end = (ids.astype("<u2"), struct.pack("<H", end_id)) if small else (ids.astype("<u4"), struct.pack("<I", end_id))
            yield arrow_rows({"doc_id": batch.column("doc_id"), "ids": pa.array([raw[a:b].tobytes() + end for a, b in zip(starts, starts[1:], strict=False)], pa.binary()), "small": [small] * batch.num_rows, "n": n.astype(np.int64)})

    # Written first: sorting by range reads its input twice, and encoding is the dear part.
    ids = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids binary, small boolean, n long"), "encoded")
    parts = parts_of(ids.agg(F.sum("n")).first()[0] or 0, segment_ids, spark.sparkContext.defaultParallelism)

    def segments(batches):
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []

        def flush():
            nonlocal seq, before, held
            data = np.concatenate([x for _, x in held])
            row = arrow_rows({"part": [part], "seq": [seq], "before": [before], "n_ids": [len(data)], "data": [pack([d for d, _ in held], np.array([len(x) for _, x in held]), data.astype(np.int64))]})
            seq, before, held = seq + 1, before + len(data), []
            return row

        size = 0
        for batch in batches:
            for doc_id, raw, small in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), batch.column("small").to_pylist(), strict=True):
                x = np.frombuffer(raw, "<u2" if small else "<u4")
                if held and size + len(x) > segment_ids:
                    yield flush()
                    size = 0
                held.append((doc_id, x))
                size += len(x)
        if held:
            yield flush()

    # The sample that sets the ranges goes to the driver, so of the ids it has only the beginning, which sorts alike.
    ids.drop("n").repartitionByRange(parts, "doc_id", F.substring("ids", 1, 64)).sortWithinPartitions("doc_id", "ids").mapInArrow(segments, "part long, seq long, before long, n_ids long, data binary").write.option("compression", "none").parquet(folder)
    return folder


def read_ids(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the folder's segments; start: ids of all documents before it."""
    rows = spark.read.parquet(folder)
    # A row for each part, so the running sum is over as many rows as tasks wrote.
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    placed = rows.join(F.broadcast(parts), "part").select((F.col("first") + F.col("before")).alias("first"), "data")

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for first, data in zip(batch.column("first").to_pylist(), batch.column("data"), strict=True):
                doc_ids, counts, ids = unpack(data.as_py())
                ends = np.cumsum(counts)
                raw = ids.astype("<u4")
                yield arrow_rows({"doc_id": pa.array(doc_ids, pa.int64()), "start": first + ends - counts, "n_tokens": counts.astype(np.int64), "ids_crc32": np.array([zlib.crc32(raw[e - c : e].tobytes()) for c, e in zip(counts, ends, strict=True)], np.int64)})

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
