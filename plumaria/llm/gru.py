r"""Language-model scoring with a gated recurrent network.

1. Each scan task writes, in one pass, its texts as ids in chunk dictionaries and the dictionaries with their training counts. Counts are summed by
   word over the corpus and joined back to the dictionaries, so no table of words is collected or broadcast.
2. Symbols: the most frequent training words each have one; their number grows with the fourth root of the training tokens (1,440 up to 1e8 tokens, some 4,000 at 30 GB), which
   is also the bound of what is broadcast. Rarer words share bands, one for each doubling of their count however large that gets, within which a word has its add-half share. Output is
   factored: a softmax over classes (runs of frequency ranks, and the bands), then over the words of the class.
3. A GRU is trained by truncated backpropagation in numpy: lanes of concatenated training texts, windows of `STEPS` tokens, state carried from
   window to window and reset after each end token. Training texts are dealt by a hash into shards of about `SHARD` tokens and sorted by it, so neither shards nor their order depend on how the table lies.
   After a short common start on a hash sample, each of `ROUNDS` rounds trains every shard on its part of the round from the common model; models are averaged by tokens,
   `FAN` at a time, so the driver never holds more than `FAN` of them. All training texts are learnt from once.
4. Scoring carries the state through a whole text, whatever its length; texts lie in lanes by falling length.

Words are runs outside ``[\x20\x09-\x0D]`` with A-Z in lower case; each text ends with one end token. Held out: crc32 of the id's decimal text mod 5 is 1.

Defined cases: a null or empty text is its end token; a null doc_id counts as training (crc32 of the empty text); repeated rows each give their row; without training
texts the model is as initialised; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumaria.llm.common import WordIds, arrow_parts, arrow_rows, id_type, written

HIDDEN, CLASS, STEPS, LANES, FAN = 16, 48, 16, 256, 32
SHARD, ROUNDS, AT_ONCE = 6_000_000, 2, 1_000_000
END = b""


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def band(count: np.ndarray) -> np.ndarray:
    """0 for counts of 0 and 1, then one for each doubling."""
    return np.log2(np.maximum(count, 1)).astype(np.int64)


def grown(train_tokens: int) -> int:
    """How many words have symbols of their own."""
    return CLASS * round(30 * max(1.0, (train_tokens / 1e8) ** 0.25))


class Model:
    """Parameters by name; words of class k are ids k * CLASS .. of the vocabulary; the bands are classes of their own."""

    def __init__(self, vocabulary: int, bands: int):
        rng = np.random.default_rng(11)
        self.vocabulary, self.bands = vocabulary, bands
        self.neural = -(-vocabulary // CLASS)
        self.classes = self.neural + bands
        self.symbol = np.int16 if vocabulary + bands < 1 << 15 else np.int32
        draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {"E": draw(vocabulary + bands, 3 * HIDDEN), "U": draw(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32), "C": draw(HIDDEN, self.classes), "c": np.zeros(self.classes, np.float32), "W": draw(self.neural * CLASS, HIDDEN), "w": np.zeros(self.neural * CLASS, np.float32)}
        self.p["w"][vocabulary:] = -30

    def start_from(self, words: np.ndarray, bands: np.ndarray) -> Model:
        """Biases that make the untrained model the add-half unigram one."""
        full = np.full(self.neural * CLASS, 1e-13)
        full[: len(words)] = words + 0.5
        self.p["w"] = np.log(full).astype(np.float32)
        self.p["c"] = np.log(np.concatenate([full.reshape(self.neural, CLASS).sum(1), bands])).astype(np.float32)
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def given(self, x):
        """What inputs x, a row for each step, give the units: steps x 3 HIDDEN x lanes, so that each unit's lanes lie together."""
        return np.ascontiguousarray((self.p["E"] + self.p["b"]).take(x, 0, mode="clip").transpose(0, 2, 1))

    def step(self, h, a, out):
        """Writes the states after h into out, a row for each unit. a: what the inputs give; the gates z, r and g take its place. Returns what h gives g."""
        n = HIDDEN
        u = self.p["U"].T @ h
        zr, g = a[: 2 * n], a[2 * n :]
        zr += u[: 2 * n]
        np.subtract(np.float32(0), zr, out=zr)  # np.negative in place is wrong on some arrays that are not contiguous (numpy 2.3.5)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        g += zr[n:] * u[2 * n :]
        np.tanh(g, out=g)
        np.subtract(h, g, out=out)
        out *= zr[:n]
        out += g
        return u[2 * n :]

    def classes_of(self, y):
        return np.where(y < self.vocabulary, y // CLASS, self.neural + y - self.vocabulary)

    def losses(self, h, y, grads=None):
        """log probabilities (natural) of symbols y after states h; with grads, adds their gradients and returns that of h too.

        Rows are put in class order, so that each class is a slice; logits have a column for each row, as numpy reduces along columns of short rows slowly.
        """
        p = self.p
        k = self.classes_of(y)
        order = np.argsort(k.astype(self.symbol), kind="stable")
        y, k = y[order], k[order]
        # The biases are weights of a last unit that is always 1, so that each product has them.
        one = np.empty((len(y), HIDDEN + 1), np.float32)
        one[:, :HIDDEN], one[:, HIDDEN] = h[order], 1
        columns = np.ascontiguousarray(one.T)
        cuts = np.searchsorted(k, np.arange(self.neural + 1)).tolist()
        s = np.concatenate([p["C"], p["c"][None]]).T @ columns
        s -= s.max(0)
        every = np.arange(len(y))
        own = s[k, every]
        q = np.exp(s, out=s)
        total = q.sum(0)
        got = own - np.log(total)
        dh = None
        if grads is not None:
            q /= total
            q[k, every] -= 1
            more = q @ one
            grads["C"] += more[:, :HIDDEN].T
            grads["c"] += more[:, HIDDEN]
            dh = q.T @ p["C"].T
            more = np.zeros((len(p["W"]), HIDDEN + 1), np.float32)
        weights, j, sums, own = np.concatenate([p["W"], p["w"][:, None]], 1), y - k * CLASS, np.ones(len(y), np.float32), np.zeros(len(y), np.float32)
        for c in range(self.neural):
            rows, at = slice(c * CLASS, (c + 1) * CLASS), slice(cuts[c], cuts[c + 1])
            m = at.stop - at.start
            if m:
                t = weights[rows] @ columns[:, at]
                t -= t.max(0)
                place = (j[at], every[:m])
                own[at] = t[place]
                v = np.exp(t, out=t)
                total = v.sum(0, out=sums[at])
                if grads is not None:
                    v /= total
                    v[place] -= 1
                    np.matmul(v, one[at], out=more[rows])
                    dh[at] += v.T @ p["W"][rows]
        got += own - np.log(sums)
        if grads is not None:
            grads["W"] += more[:, :HIDDEN]
            grads["w"] += more[:, HIDDEN]
        out = np.empty_like(got)
        out[order] = got
        if dh is not None:
            back = np.empty_like(dh)
            back[order] = dh
            dh = back
        return out, dh

    def train(self, stream: np.ndarray, start: int, lanes: int = LANES, rate: float = 0.05, squares=None):
        """One pass over a stream of symbols whose texts each end with `start`."""
        lanes = max(1, min(lanes, len(stream) // (2 * STEPS)))
        length = len(stream) // lanes
        cut = stream[: lanes * length].reshape(lanes, length)
        tail = stream[lanes * length :]
        squares = squares or {k: np.full_like(v, 1e-6) for k, v in self.p.items()}
        self._pass(cut, start, rate, squares)
        if len(tail):
            self._pass(tail[None, :], start, rate, squares)

    def _pass(self, cut, start, rate, squares):
        p, n, lanes = self.p, HIDDEN, len(cut)
        h, last = np.zeros((n, lanes), np.float32), np.full(lanes, start)
        for t0 in range(0, cut.shape[1], STEPS):
            y = cut[:, t0 : t0 + STEPS].T
            steps = len(y)
            x = np.concatenate([last[None], y[:-1]])
            keep, a = (x != start).astype(np.float32), self.given(x)
            before, states, un = (np.empty((steps, n, lanes), np.float32) for _ in range(3))
            for t in range(steps):
                np.multiply(h, keep[t], out=before[t])
                h = states[t]
                un[t] = self.step(before[t], a[t], h)
            last = y[-1]
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            _, dh = self.losses(states.transpose(0, 2, 1).reshape(-1, n), y.ravel(), grads)
            dh = np.ascontiguousarray(dh.reshape(steps, lanes, n).transpose(0, 2, 1))
            z, r, g = a[:, :n], a[:, n : 2 * n], a[:, 2 * n :]
            rest = 1 - z
            of_g, of_z, of_r = rest * (1 - g * g), (before - g) * z * rest, un * r * (1 - r)
            du, dg = np.empty_like(a), np.empty_like(un)
            back = np.zeros_like(h)
            for t in reversed(range(steps)):
                d = dh[t]
                d += back
                np.multiply(d, of_g[t], out=dg[t])
                np.multiply(d, of_z[t], out=du[t, :n])
                np.multiply(dg[t], of_r[t], out=du[t, n : 2 * n])
                np.multiply(dg[t], r[t], out=du[t, 2 * n :])
                d *= z[t]
                d += p["U"] @ du[t]
                d *= keep[t]
                back = d
            grads["U"] = np.matmul(before, du.transpose(0, 2, 1)).sum(0)
            du[:, 2 * n :] = dg
            grads["b"] = du.sum((0, 2))
            ids = x.ravel().astype(self.symbol)
            order = np.argsort(ids, kind="stable")
            symbols, size = np.unique(ids[order], return_counts=True)
            given = du.transpose(0, 2, 1).reshape(-1, 3 * n).take(order, 0)
            # Long runs of a symbol are summed one by one, which is faster than reduceat.
            long, ends = size > 32, np.cumsum(size)
            for i in np.flatnonzero(long).tolist():
                grads["E"][symbols[i]] = given[ends[i] - size[i] : ends[i]].sum(0)
            if not long.all():
                heads = np.cumsum(size[~long]) - size[~long]
                grads["E"][symbols[~long]] = np.add.reduceat(given[np.repeat(~long, size)], heads, axis=0)
            scale = np.float32(1 / y.size)
            for k, g in grads.items():
                g *= scale
                squares[k] += g * g
                p[k] -= rate * g / np.sqrt(squares[k])

    def score(self, texts: list[np.ndarray], start: int, lanes: int = 2048) -> np.ndarray:
        """Natural log probability of each text of symbols."""
        out = np.zeros(len(texts))
        order = np.argsort([-len(t) for t in texts], kind="stable")
        for i in range(0, len(order), lanes):
            at = order[i : i + lanes]
            lengths = np.array([len(texts[j]) for j in at])
            flat, first = np.concatenate([texts[j] for j in at]), np.cumsum(lengths) - lengths
            h, last, every = np.zeros((HIDDEN, len(at)), np.float32), np.full(len(at), start), np.arange(len(at))
            for t0 in range(0, lengths[0], STEPS):
                steps = np.arange(t0, min(t0 + STEPS, lengths[0]))
                lives = np.searchsorted(-lengths, -steps, side="left").tolist()
                y = flat.take(first[: lives[0]] + steps[:, None], mode="clip")  # of texts that are over something else, which is not looked at
                a = self.given(np.concatenate([last[None, : lives[0]], y[:-1]]))
                states, last = [], y[-1]
                for t, live in enumerate(lives):
                    before, h = np.ascontiguousarray(h[:, :live]), np.empty((HIDDEN, live), np.float32)
                    self.step(before, np.ascontiguousarray(a[t, :, :live]), h)
                    states.append(h.T)
                got = self.losses(np.concatenate(states), np.concatenate([y[t, :live] for t, live in enumerate(lives)]))[0]
                out[at[: lives[0]]] += np.bincount(np.concatenate([every[:live] for live in lives]), got, lives[0])
        return out


def lm_scores(docs: DataFrame, vocabulary: int | None = None, chunk_bytes: int = 24_000_000, warm: int = 400_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs; logarithms are to base 10. vocabulary: words with symbols of their own, by default as grown() has it."""
    kind = id_type(docs)

    def encode(batches):
        from pyspark import TaskContext

        part, seq, words, counts, size = TaskContext.get().partitionId(), 0, WordIds(), np.zeros(0, np.int64), 0
        words[END]
        shape = lambda n: {"chunk": np.full(n, (part << 24) + seq, np.int64)}

        def dictionary():
            n = len(words)
            total = np.zeros(n, np.int64)
            total[: len(counts)] = counts
            import pyarrow as pa

            return arrow_rows(shape(n) | {"doc_id": pa.nulls(n, pa.string()), "data": pa.nulls(n, pa.binary()), "word": pa.array(list(words), pa.binary()), "local": np.arange(n, dtype=np.int32), "n": total})

        for batch, texts in arrow_parts(batches):
            import pyarrow as pa

            ids, data = batch.column("doc_id").to_pylist(), []
            train = array("i")
            for doc_id, text in zip(ids, texts, strict=True):
                local = array("i", map(words.__getitem__, text.lower().split()))
                local.append(0)
                data.append(local.tobytes())
                if not held_out(doc_id):
                    train.extend(local)
            more = np.bincount(np.frombuffer(train, np.int32), minlength=len(words)) if train else np.zeros(len(words), np.int64)
            more[: len(counts)] += counts
            counts = more
            n = len(ids)
            yield arrow_rows(shape(n) | {"doc_id": pa.array([None if i is None else str(i) for i in ids], pa.string()), "data": pa.array(data, pa.binary()), "word": pa.nulls(n, pa.binary()), "local": pa.nulls(n, pa.int32()), "n": pa.nulls(n, pa.int64())})
            size += sum(map(len, texts))
            if size >= chunk_bytes:
                yield dictionary()
                seq, size, counts = seq + 1, 0, np.zeros(0, np.int64)
                words.clear()
                words[END]
        if size or len(words) > 1 or len(counts):
            yield dictionary()

    made = written(docs.select("doc_id", "text").mapInArrow(encode, "chunk long, doc_id string, data binary, word binary, local int, n long"), "lm-chunks")
    rows, entries = made.where("data is not null").select("chunk", "doc_id", "data"), made.where("word is not null").select("chunk", "word", "local", "n")
    counts = written(entries.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    train_tokens, distinct = int(total[0]), int(total[1])
    vocabulary = vocabulary or grown(train_tokens)
    frequent = counts.orderBy(F.desc("c"), "word").limit(vocabulary).collect()
    top = [(bytes(r["word"]), i) for i, r in enumerate(frequent)]
    if not top or all(w != END for w, _ in top):
        top = [*top[: vocabulary - 1], (END, len(top[: vocabulary - 1]))]
    size, start = len(top), dict(top)[END]
    log2 = F.floor(F.log2(F.greatest(F.col("c"), F.lit(1)).cast("double"))).cast("int")
    known = docs.sparkSession.createDataFrame(top, "word binary, symbol int")
    rare = counts.join(F.broadcast(known), "word", "left_anti").groupBy(log2.alias("band")).agg(F.sum(F.col("c") + 0.5).alias("mass")).collect()
    mass = np.full(1 + max([r["band"] for r in rare], default=0), 0.5)
    blank = Model(size, len(mass))
    symbol = blank.symbol
    for r in rare:
        mass[r["band"]] += r["mass"]
    listed = entries.join(counts, "word", "left").join(F.broadcast(known), "word", "left").groupBy("chunk").agg(F.collect_list(F.struct("local", F.coalesce("c", F.lit(0)).alias("c"), "symbol")).alias("words"))

    def symbols(batches):
        import pyarrow as pa

        cache: tuple = (None, None, None, None)
        for batch in batches:
            chunk, words = batch.column("chunk").to_numpy(), batch.column("words")
            out = {k: [] for k in ("n_tokens", "n_known", "base", "rare", "data")}
            for i, (raw, at) in enumerate(zip(batch.column("data"), chunk, strict=True)):
                if cache[0] != at:
                    flat = words[i].values
                    order = np.argsort(flat.field("local").to_numpy())
                    c, s = flat.field("c").to_numpy()[order], flat.field("symbol").to_numpy(zero_copy_only=False)[order]
                    new, b = np.isnan(s.astype(float)), np.minimum(band(c), len(mass) - 1)
                    s = np.where(new, size + b, np.nan_to_num(s.astype(float))).astype(symbol)
                    cache = (at, s, c > 0, np.stack([np.log10((c + 0.5) / (train_tokens + 0.5 * (distinct + 1))), np.where(new, np.log10((c + 0.5) / mass[b]), 0.0)]))
                local = np.frombuffer(raw.as_buffer(), np.int32)
                out["n_tokens"].append(len(local))
                out["n_known"].append(int(cache[2][local].sum()))
                base, rest = cache[3][:, local].sum(1)
                out["base"].append(base)
                out["rare"].append(rest)
                out["data"].append(cache[1][local].tobytes())
            yield arrow_rows({"doc_id": batch.column("doc_id"), "n_tokens": np.array(out["n_tokens"], np.int64), "n_known": np.array(out["n_known"], np.int64), "base": np.array(out["base"]), "rare": np.array(out["rare"]), "data": pa.array(out["data"], pa.binary())})

    def chunked(key, left, right):
        import pyarrow as pa

        if left.num_rows:
            words = right.column("words").combine_chunks() if right.num_rows else pa.array([[]], right.schema.field("words").type)
            for batch in left.to_batches():
                one = _View(batch, words)
                yield from symbols([one])

    coded = rows.groupBy("chunk").cogroup(listed.select(F.col("chunk").alias("of"), "words").groupBy("of")).applyInArrow(lambda key, left, right: pa_table(chunked(key, left, right)), "doc_id string, n_tokens long, n_known long, base double, rare double, data binary")
    coded = written(coded, "lm-symbols")
    counted = np.zeros(size)
    counted[: len(frequent)] = [r["c"] for r in frequent][:size]
    model = blank.start_from(counted, mass)
    learnt = coded.where(F.pmod(F.crc32(F.coalesce("doc_id", F.lit("")).cast("binary")), F.lit(5)) != 1).select(F.xxhash64("doc_id", "data").alias("h"), "n_tokens", "data")

    def fit(begin: np.ndarray):
        def run(batches):
            own, squares, shard, held, size, seen = None, None, None, [], 0, 0

            def train():
                nonlocal held, size, seen
                if held:
                    own.train(np.concatenate(held).astype(np.int64), start, squares=squares)
                held, seen, size = [], seen + size, 0

            def row():
                train()
                return arrow_rows({"shard": [shard], "tokens": [seen], "model": [np.concatenate([own.flat(), *(v.ravel() for v in squares.values())]).tobytes()]})

            for batch in batches:
                for at, data in zip(batch.column("shard").to_pylist(), batch.column("data"), strict=True):
                    if at != shard:
                        if own is not None:
                            yield row()
                        own, shard, seen = Model(model.vocabulary, model.bands).load(begin[: len(begin) // 2]), at, 0
                        squares = dict(zip(own.p, (v.copy() for v in Model(model.vocabulary, model.bands).load(begin[len(begin) // 2 :]).p.values()), strict=True))
                    held.append(np.frombuffer(data.as_buffer(), symbol).copy())
                    size += len(held[-1])
                    if size >= AT_ONCE:
                        train()
            if own is not None:
                yield row()

        return run

    def mean(key, group):
        import pyarrow as pa

        total, tokens = 0.0, 0
        for _, n, m in sorted(zip(group.column("shard").to_pylist(), group.column("tokens").to_pylist(), group.column("model").to_pylist(), strict=True)):
            total, tokens = total + np.frombuffer(m, np.float32).astype(float) * n, tokens + n
        return pa.table({"shard": [key[0].as_py()], "tokens": [tokens], "model": [(total / tokens).astype(np.float32).tobytes()]})

    schema = "shard long, tokens long, model binary"
    shards = max(1, round(train_tokens / SHARD))

    def trained(rows: DataFrame, n: int, begin: np.ndarray) -> np.ndarray:
        """The mean model of n shards of rows, each from begin on: parameters, then Adagrad's sums."""
        rows = rows.select(F.pmod("h", F.lit(n)).alias("shard"), "h", "data").repartition(n, "shard").sortWithinPartitions("shard", "h", "data")
        models = written(rows.mapInArrow(fit(begin), schema), "lm-models")
        while n > FAN:
            models, n = written(models.groupBy(F.floor(F.col("shard") / FAN).alias("of")).applyInArrow(mean, schema), "lm-models"), -(-n // FAN)
        got = models.orderBy("shard").collect()  # FAN at most
        if not got:
            return begin
        weight = np.array([r["tokens"] for r in got], float)
        return (np.stack([np.frombuffer(bytes(r["model"]), np.float32) for r in got]) * (weight / weight.sum())[:, None]).sum(0).astype(np.float32)

    state = np.concatenate([model.flat(), np.full(len(model.flat()), 1e-6, np.float32)])
    if train_tokens:
        share = max(1, train_tokens // warm)
        state = trained(learnt.where(F.pmod(F.shiftrightunsigned("h", 40), F.lit(share)) == 0), 1, state)  # a common start only: all texts are learnt from below
        state[len(state) // 2 :] = 1e-6  # so that what follows takes steps as large as the start's
        for r in range(ROUNDS):
            state = trained(learnt.where(F.pmod(F.shiftrightunsigned("h", 20), F.lit(ROUNDS)) == r), shards, state)
        model.load(state[: len(state) // 2])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            texts = [np.frombuffer(d.as_buffer(), symbol).astype(np.int64) for d in batch.column("data")]
            ids = batch.column("doc_id").to_pylist()
            got = shared.value.score(texts, start) / np.log(10) + batch.column("rare").to_numpy()
            yield arrow_rows({"doc_id": batch.column("doc_id"), "held_out": [held_out(i) for i in ids], "n_tokens": batch.column("n_tokens"), "n_known": batch.column("n_known"), "train_tokens": np.full(len(ids), train_tokens, np.int64), "base_score": batch.column("base"), "score": got})

    out = coded.mapInArrow(score, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def pa_table(batches):
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.string()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("rare", pa.float64()), ("data", pa.binary())])
    return pa.Table.from_batches(list(batches), schema)


class _View:
    """A batch whose every row has the same dictionary."""

    def __init__(self, batch, words):
        self.batch, self.words = batch, words

    def column(self, name):
        return _Same(self.words) if name == "words" else self.batch.column(name)


class _Same:
    def __init__(self, words):
        self.words = words

    def __getitem__(self, i):
        return self.words[0]
