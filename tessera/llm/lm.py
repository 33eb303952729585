"""Scores of whole documents by a gated recurrent language model, trained in numpy on the training documents.

Words are counted over the whole training corpus. The HEAD most frequent
ones are split into classes of equal size; every other word belongs to one of
TAILS classes by its last bytes. The network gives the probability of the
next token's class, and of the word within a head class; within a tail class
a word has its share of the corpus counts, and the words never seen are one
event, as in the base score, with the weight that Good and Turing give it:
that of the words seen once.

Training is truncated backpropagation. A bounded sample starts the network,
then every task goes once through all training documents of its partition
from there, and the tasks' weights are averaged by their tokens. Scoring
carries the state across windows from a document's first token to its end.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, raw, small_batches, stored, text_of
from .learn import Adam

HEAD, SIZE, TAILS, HIDDEN = 1024, 64, 32, 16
#: Words whose counts every worker holds; counts of rarer ones come by a join.
KNOWN = 1 << 18
#: Lanes and steps of a training window; longer texts train in segments of so many tokens, which keep their order and context token.
LANES, STEPS, SEGMENT = 1024, 12, 1024
SCORE_LANES, SCORE_STEPS = 1024, 16
#: Tokens a task holds at once when it trains or scores, unless a single text is longer: some 20 bytes each.
HELD = 1 << 21
#: The sample that starts the network: bytes of text and rounds.
WARM_BYTES, WARM_ROUNDS = 4 << 20, 2
RATE, ROW_RATE = 0.003, 0.15
#: The token that ends every text; no word is empty.
END = b""
#: Values in one row of averaged weights, and the first level's fan of the average.
BLOCK, FAN = 4096, 64


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, and the end."""
    return [*text.lower().split(), END]


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


@dataclass
class Vocabulary:
    """Ids of the KNOWN most frequent words, by rank; what all words' counts add up to."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    tail_total: np.ndarray  # counts of all words of a tail class
    tail_once: np.ndarray  # of them, words seen once
    size: int = field(default_factory=lambda: SIZE)

    def __post_init__(self):
        self.head = min(HEAD, len(self.words))
        self.head_classes = -(-self.head // self.size)
        self.classes = self.head_classes + TAILS
        self.id_of = {w: i for i, w in enumerate(self.words)}
        tail = np.array([tail_class(w) for w in self.words[self.head :]], dtype=np.int32)
        self.symbol = np.concatenate((np.arange(self.head, dtype=np.int32), self.head + tail))  # of known words
        self.tail_mass = self.tail_total + self.tail_once + 1.0
        self.log_unseen = np.log10((self.tail_once + 1.0) / self.tail_mass)

    @property
    def start(self) -> int:
        """The symbol before the first token."""
        return self.head + TAILS

    def ids(self, text: bytes) -> tuple[np.ndarray, list[bytes]]:
        """Id of every token, -1 for the others, which are listed."""
        t = tokens(text)
        ids = np.fromiter(map(self.id_of.get, t, repeat(-1)), dtype=np.int32, count=len(t))
        return ids, [t[i] for i in np.flatnonzero(ids < 0)]

    def symbols(self, ids: np.ndarray, rest: list[bytes]) -> np.ndarray:
        out = self.symbol[ids] if len(self.symbol) else np.zeros(len(ids), np.int32)
        if rest:
            out[ids < 0] = [self.head + tail_class(w) for w in rest]
        return out


def fresh(v: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights that give the corpus's unigram shares; the network starts there."""
    rng = np.random.default_rng(seed)
    h, n = HIDDEN, v.classes
    count = v.counts[: v.head].astype(np.float64)
    inner = np.full((v.head_classes, v.size), -1e4)
    mass = np.concatenate(([count[k * v.size : (k + 1) * v.size].sum() for k in range(v.head_classes)], v.tail_mass)) + 0.0
    for k in range(v.head_classes):
        own = count[k * v.size : (k + 1) * v.size]
        inner[k, : len(own)] = np.log(own / own.sum())
    p = {
        "in": 0.1 * rng.standard_normal((v.start + 1, 3 * h)),
        "rec": rng.standard_normal((h, 3 * h)) / np.sqrt(h),
        "cls": 0.1 * rng.standard_normal((h, n)),
        "cls_b": np.log(mass / mass.sum()),
        "word": 0.1 * rng.standard_normal((v.head_classes, h, v.size)),
        "word_b": inner,
    }
    return {k: x.astype(np.float32) for k, x in p.items()}


def _step(p: dict, x: np.ndarray, h: np.ndarray):
    """One gated step: x are input rows of the gates, h the state; gives (new state, reset and update gates, candidate, its recurrent part)."""
    k = HIDDEN
    g = h @ p["rec"]
    gate = np.tanh((x[:, : 2 * k] + g[:, : 2 * k]) * 0.5)
    gate += 1
    gate *= 0.5
    new = np.tanh(x[:, 2 * k :] + gate[:, :k] * g[:, 2 * k :])
    return new + gate[:, k:] * (h - new), gate, new, g[:, 2 * k :]


def _by_class(symbols: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, np.ndarray]]]:
    """Class of each symbol, and (class, places) of each head class that occurs."""
    heads = v.head_classes
    cls = np.where(symbols < v.head, symbols // v.size, symbols - v.head + heads)
    order = np.argsort(cls, kind="stable")
    ends = np.searchsorted(cls[order], np.arange(heads + 1))
    return cls, order, ((k, order[ends[k] : ends[k + 1]]) for k in range(heads) if ends[k + 1] > ends[k])


def _with_one(hs: np.ndarray) -> np.ndarray:
    """States with a column of ones, for the biases."""
    return np.concatenate((hs, np.ones((len(hs), 1), np.float32)), axis=1)


def _scores(hs: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Unnormalised log probabilities, kept where exp() holds them."""
    z = hs @ np.concatenate((weights, bias[None, :]))
    return np.minimum(z, 60, out=z)


def _log_share(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log of the chosen entry's share in each row's sum of exponentials; ``z`` is used up."""
    own = z[np.arange(len(z)), chosen]
    return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


def _softmax(z: np.ndarray) -> np.ndarray:
    np.exp(z, out=z)
    z *= (1 / (z @ np.ones(z.shape[1], z.dtype)))[:, None]
    return z


class Trainer:
    """Truncated backpropagation over lanes of segments."""

    def __init__(self, v: Vocabulary, p: dict[str, np.ndarray]):
        self.v, self.p = v, {k: x.copy() for k, x in p.items()}
        self.dense = {k: self.p[k] for k in ("rec", "cls", "cls_b")}
        self.adam = Adam(self.dense, RATE)
        self.seen_in = np.full((len(p["in"]), 1), 1e-4, np.float32)
        self.seen_word = np.full((len(p["word"]), 1, v.size), 1e-4, np.float32)
        self.tokens = 0

    def run(self, texts: list[np.ndarray]) -> None:
        """``texts``: symbols of whole documents, the end included."""
        segments = [(t[a - 1] if a else self.v.start, t[a : a + SEGMENT]) for t in texts for a in range(0, len(t), SEGMENT)]
        if not segments:
            return
        lanes = Lanes([s for _, s in segments], [c for c, _ in segments], LANES)
        h = np.zeros((len(lanes.length), HIDDEN), np.float32)
        for target, before, first, _ in lanes.windows(STEPS):
            h = self._window(target, before, ~first, h[: target.shape[1]])

    def _window(self, target: np.ndarray, before: np.ndarray, keep: np.ndarray, h: np.ndarray) -> np.ndarray:
        p, k = self.p, HIDDEN
        steps, lanes = target.shape
        x = p["in"][before]
        keep = keep[:, :, None].astype(np.float32)
        past = np.empty((steps, lanes, k), np.float32)
        gates, news, recs, states = (np.empty((steps, lanes, n), np.float32) for n in (2 * k, k, k, k))
        for t in range(steps):
            past[t] = h * keep[t]
            h, gates[t], news[t], recs[t] = _step(p, x[t], past[t])
            states[t] = h
        flat, goal = states.reshape(-1, k), target.reshape(-1)
        real = np.flatnonzero(goal >= 0)
        n = len(real)
        self.tokens += n
        hs, goal = flat[real], goal[real]
        cls, _, parts = _by_class(goal, self.v)
        ones = _with_one(hs)
        d = _softmax(_scores(ones, p["cls"], p["cls_b"]))
        d[np.arange(n), cls] -= 1
        g = ones.T @ d
        grad = {"cls": g[:-1] / n, "cls_b": g[-1] / n}
        back_h = d @ p["cls"].T
        for c, where in parts:
            own = ones[where]
            e = _softmax(_scores(own, p["word"][c], p["word_b"][c]))
            e[np.arange(len(where)), goal[where] - c * self.v.size] -= 1
            back_h[where] += e @ p["word"][c].T
            g = own[:, :-1].T @ e / n
            self.seen_word[c] += (g * g).mean(axis=0)
            p["word"][c] -= ROW_RATE * 0.3 * g / np.sqrt(self.seen_word[c])
        out = np.zeros((steps * lanes, k), np.float32)
        out[real] = back_h / n
        out = out.reshape(steps, lanes, k)
        dx, dg = np.empty((steps, lanes, 3 * k), np.float32), np.empty((steps, lanes, 3 * k), np.float32)
        carry = np.zeros((lanes, k), np.float32)
        rec_t = np.ascontiguousarray(p["rec"].T)
        for t in range(steps - 1, -1, -1):
            dh = out[t] + carry
            r, z, new = gates[t, :, :k], gates[t, :, k:], news[t]
            dn = dh * (1 - z) * (1 - new * new)
            dx[t, :, :k] = dn * recs[t] * r * (1 - r)
            dx[t, :, k : 2 * k] = dh * (past[t] - new) * z * (1 - z)
            dx[t, :, 2 * k :] = dn
            dg[t, :, : 2 * k] = dx[t, :, : 2 * k]
            dg[t, :, 2 * k :] = dn * r
            carry = (dh * z + dg[t] @ rec_t) * keep[t]
        grad["rec"] = past.reshape(-1, k).T @ dg.reshape(-1, 3 * k)
        self.adam.step(grad)
        rows, moved = before.reshape(-1), dx.reshape(-1, 3 * k)
        order = np.argsort(rows, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(rows[order]) != 0])
        which, total = rows[order][at], np.add.reduceat(moved[order], at, axis=0)
        self.seen_in[which] += (total * total).mean(axis=1, keepdims=True)
        p["in"][which] -= ROW_RATE * total / np.sqrt(self.seen_in[which])
        return h


def _lanes(lengths: list[int], most: int) -> list[list[int]]:
    """Sequences dealt to lanes of about the same length, longest lane first."""
    heap = [(0, i) for i in range(min(most, len(lengths)))]
    lanes: list[list[int]] = [[] for _ in heap]
    for k in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        size, i = heap[0]
        heapq.heapreplace(heap, (size + lengths[k], i))
        lanes[i].append(k)
    return sorted(lanes, key=lambda lane: -sum(lengths[k] for k in lane))


class Lanes:
    """Sequences of symbols dealt to lanes and read window by window; memory is in proportion to the symbols, however long one sequence is."""

    def __init__(self, texts: list[np.ndarray], before: list[int], most: int):
        """``before``: the symbol before each text."""
        lanes = _lanes([len(t) for t in texts], most)
        order = [k for lane in lanes for k in lane]
        size = np.array([len(texts[k]) for k in order], dtype=np.int64)
        at = np.cumsum(size) - size
        self.length = np.array([sum(len(texts[k]) for k in lane) for lane in lanes], dtype=np.int64)  # in descending order
        self.start = np.cumsum(self.length) - self.length
        self.target = np.concatenate([texts[k] for k in order]).astype(np.int32)
        self.before = np.r_[np.int32(0), self.target[:-1]]
        self.first = np.zeros(len(self.target), bool)
        real = size > 0
        self.first[at[real]] = True
        self.before[at[real]] = np.array([before[k] for k in order], dtype=np.int32)[real]
        self.owner = np.repeat(np.array(order, dtype=np.int32), size)

    def windows(self, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(target, before, first, owner), step by lane, of the lanes that go on; target is -1 beyond a lane's end."""
        for at in range(0, int(self.length[0]) if len(self.length) else 0, steps):
            live = int(np.searchsorted(-self.length, -at, side="left"))
            place = at + np.arange(min(steps, int(self.length[0]) - at))[:, None]
            on = place < self.length[None, :live]
            place = np.where(on, place + self.start[None, :live], 0)
            yield np.where(on, self.target[place], -1), self.before[place], self.first[place] & on, self.owner[place]


def log_probabilities(v: Vocabulary, p: dict[str, np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Of each text of symbols the sum of log10 probabilities of class, and of word within a head class, state carried from start to end."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    lanes = Lanes(texts, [v.start] * len(texts), SCORE_LANES)
    h = np.zeros((len(lanes.length), HIDDEN), np.float32)
    for target, before, first, owner in lanes.windows(SCORE_STEPS):
        size, live = target.shape
        h = h[:live].copy()
        states = np.empty((size, live, HIDDEN), np.float32)
        for t in range(size):
            if first[t].any():
                h[first[t]] = 0
            h = _step(p, p["in"][before[t]], h)[0]
            states[t] = h
        goal = target.reshape(-1)
        real = np.flatnonzero(goal >= 0)
        hs, goal = states.reshape(-1, HIDDEN)[real], goal[real]
        cls, _, parts = _by_class(goal, v)
        ones = _with_one(hs)
        logp = _log_share(_scores(ones, p["cls"], p["cls_b"]), cls).astype(np.float64)
        for c, where in parts:
            logp[where] += _log_share(_scores(ones[where], p["word"][c], p["word_b"][c]), goal[where] - c * v.size)
        out += np.bincount(owner.reshape(-1)[real], weights=logp, minlength=len(texts))
    return out / np.log(10)


def count_words(documents: DataFrame) -> DataFrame:
    """(w, k, c): how often each token occurs in all ``documents``, k its tail class. Counts are summed in each task before they are shuffled."""
    small_batches(documents.sparkSession)

    def count(batches):
        counts: Counter = Counter()

        def rows():
            w = list(counts)
            return pa.RecordBatch.from_arrays([pa.array(w, pa.binary()).cast(pa.string()), pa.array([tail_class(x) for x in w], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["w", "k", "c"])

        for b in batches:
            for t in raw(b.column(0)):
                counts.update(tokens(t))
            if len(counts) > 1_000_000:
                yield rows()
                counts.clear()
        if counts:
            yield rows()

    return documents.select(text_of(documents)).mapInArrow(count, "w string, k int, c long").groupBy("w", "k").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From all counts: the KNOWN most frequent words, and sums over all words."""
    top = counts.orderBy(F.desc("c"), "w").limit(KNOWN).toArrow()
    words = [x.encode() for x in top.column("w").to_pylist()]
    number = top.column("c").to_numpy()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    mass, once = np.zeros(TAILS), np.zeros(TAILS)
    for r in counts.groupBy("k").agg(F.sum("c").alias("c"), F.sum((F.col("c") == 1).cast("long")).alias("n1")).collect():
        mass[r.k], once[r.k] = r.c, r.n1
    for w, c in zip(words[:HEAD], number[:HEAD]):  # the head words are no part of a tail class
        mass[tail_class(w)] -= c
        once[tail_class(w)] -= c == 1
    return Vocabulary(words, number, int(total), int(distinct), mass, once)


def _sample(documents: DataFrame) -> list[bytes]:
    """Whole texts in the order of a hash of their ids, WARM_BYTES at most."""
    sizes = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_of(documents)), F.lit(0)).alias("n")).where("doc_id is not null")
    drawn, size = [], 0
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "n").limit(4000).collect():
        if size + r.n <= WARM_BYTES:
            drawn.append((r.doc_id,))
            size += r.n
    if not drawn:
        return []
    ids = documents.sparkSession.createDataFrame(drawn, "i long").distinct()
    rows = documents.join(F.broadcast(ids), documents["doc_id"].cast("long") == ids["i"]).select("i", text_of(documents)).orderBy(F.xxhash64("i"), "text")
    out, size = [], 0
    for r in rows.toLocalIterator():
        t = (r.text or "").encode()
        if size + len(t) > WARM_BYTES:
            break
        out.append(t)
        size += len(t)
    return out


def _average(parts: DataFrame) -> DataFrame:
    """Weighted means of blocks, in two levels, so that no task gets a block from every other one."""

    def mean(table: pa.Table) -> pa.Table:
        w = table.column("w").to_numpy()
        values = np.array(table.column("x").to_pylist(), dtype=np.float64)
        x = (values * w[:, None]).sum(axis=0) / w.sum()
        return pa.table({"i": table.column("i").slice(0, 1), "g": table.column("g").slice(0, 1), "w": [float(w.sum())], "x": pa.array([x.astype(np.float32)], pa.list_(pa.float32()))})

    schema = "i int, g int, w double, x array<float>"
    return parts.groupBy("i", "g").applyInArrow(mean, schema).withColumn("g", F.lit(0)).groupBy("i", "g").applyInArrow(mean, schema)


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Views of a list column's values, as symbols."""
    values, at = column.values.to_numpy(zero_copy_only=False).astype(np.int32), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def prepare(documents: DataFrame, training: Column, v: Vocabulary) -> DataFrame:
    """Of every row: its tokens' symbols, what known words add to the scores, and the other words.

    Workers know the KNOWN most frequent words. Other tokens go on as (word, number) with a key of the text, for a join with all counts.
    """
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(v)

    def run(batches):
        v = shared.value
        unit = v.total + 0.5 * (v.distinct + 1)
        base_of = np.log10((v.counts + 0.5) / unit)
        own_of = np.zeros(len(v.words))  # a known tail word's share of its class
        k = v.symbol[v.head :] - v.head
        own_of[v.head :] = np.log10(v.counts[v.head :] / v.tail_mass[k])
        names = ["doc_id", "training", "symbols", "n_known", "base_score", "score", "key", "words", "times"]
        types = [pa.int64(), pa.bool_(), pa.list_(pa.int16()), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
        for b in batches:
            rows = []
            for i, own, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2))):
                ids, rest = v.ids(t)
                known = ids[ids >= 0]
                c = Counter(rest)
                key = hashlib.blake2b(t, digest_size=16).hexdigest() if c else None
                rows.append((i, own, v.symbols(ids, rest).astype(np.int16), len(known), float(base_of[known].sum()), float(own_of[known].sum()), key, [w.decode() for w in c], list(c.values())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = "doc_id long, training boolean, symbols array<smallint>, n_known long, base_score double, score double, key string, words array<string>, times array<long>"
    own = F.coalesce(training, F.lit(False)).alias("training")
    return stored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), own, text_of(documents)).mapInArrow(run, schema), "lm-symbols")


def train(documents: DataFrame, prepared: DataFrame, v: Vocabulary) -> dict[str, np.ndarray]:
    """Weights after one pass over all rows of ``prepared``, which are those of ``documents``."""
    spark = documents.sparkSession
    start = Trainer(v, fresh(v))
    if v.head:
        warm = [v.symbols(*v.ids(t)) for t in _sample(documents)]
        for _ in range(WARM_ROUNDS):
            start.run(warm)
    names = sorted(start.p)
    shared = spark.sparkContext.broadcast((v, start.p))  # KNOWN words and weights of fixed size

    def fit(batches):
        from pyspark import TaskContext

        v, p = shared.value
        own, held, size = Trainer(v, p), [], 0
        for b in batches:
            for t in _lists(b.column(0)):
                held.append(t)
                size += len(t)
                if size >= HELD:
                    own.run(held)
                    held, size = [], 0
        own.run(held)
        if own.tokens:
            flat = np.concatenate([own.p[k].ravel() for k in names])
            cuts = [flat[a : a + BLOCK] for a in range(0, len(flat), BLOCK)]
            group = TaskContext.get().partitionId() % FAN
            n = len(cuts)
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([group] * n, pa.int32()), pa.array([float(own.tokens)] * n), pa.array(cuts, pa.list_(pa.float32()))], ["i", "g", "w", "x"])

    small_batches(spark)
    rows = _average(prepared.select("symbols").mapInArrow(fit, "i int, g int, w double, x array<float>")).collect()
    if not rows:
        return start.p
    flat = np.concatenate([np.array(r.x, np.float32) for r in sorted(rows, key=lambda r: r.i)])
    out, at = {}, 0
    for k in names:
        out[k] = flat[at : at + start.p[k].size].reshape(start.p[k].shape)
        at += start.p[k].size
    return out


def score(prepared: DataFrame, counts: DataFrame, v: Vocabulary, p: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every prepared row.

    The sums over words that workers don't know come back by the text's key,
    so equal texts share them and repeated rows stay.
    """
    spark = prepared.sparkSession
    shared = spark.sparkContext.broadcast((v, p))

    def run(batches):
        v, p = shared.value
        held, size = [], 0

        def flush():
            texts = [t for b in held for t in _lists(b.column(1))]
            logp, at = log_probabilities(v, p, texts), 0
            for b in held:
                n = b.num_rows
                own = b.column(4).to_numpy() + logp[at : at + n]
                tokens = np.array([len(t) for t in texts[at : at + n]], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens), b.column(2), b.column(3), pa.array(own), b.column(5)], ["doc_id", "n_tokens", "n_known", "base_score", "score", "key"])
                at += n

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += len(b.column(1).values)
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, key string"
    found = prepared.select("doc_id", "symbols", "n_known", "base_score", "score", "key").mapInArrow(run, schema)
    unit = v.total + 0.5 * (v.distinct + 1)
    mass = F.array(*[F.lit(float(x)) for x in v.tail_mass])
    once = F.array(*[F.lit(float(x)) for x in v.tail_once])
    one_of_each = prepared.where("key is not null").groupBy("key").agg(F.first("words").alias("words"), F.first("times").alias("times"))
    rare = one_of_each.select("key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("key", F.col("x.words").alias("w"), F.col("x.times").alias("n"))
    k = F.coalesce(F.col("k"), (F.crc32(F.expr("substring(cast(w as binary), greatest(octet_length(w) - 1, 1), 2)")) % TAILS).cast("int"))
    c = F.coalesce("c", F.lit(0))
    at = lambda a: F.element_at(a, k + 1)
    sums = (
        rare.join(counts.hint("shuffle_hash"), "w", "left").groupBy("key").agg(
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
            F.sum(F.col("n") * F.log10((c + 0.5) / unit)).alias("more_base"),
            F.sum(F.col("n") * F.log10(F.when(c > 0, c).otherwise(at(once) + 1.0) / at(mass))).alias("more"),
        )
    )
    add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    # texts of known words alone have no key; by their ids they spread over all tasks
    found = found.withColumn("key", F.coalesce("key", F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    return found.join(sums, "key", "left").select("doc_id", "n_tokens", add("n_known", "more_known"), add("base_score", "more_base"), add("score", "more"))


def fit_and_score(documents: DataFrame, training: Column) -> DataFrame:
    """Learn from the rows for which ``training`` (a condition) holds, score all: see ``score``, plus train_tokens.

    Null texts are empty: their only token is the end. Repeated rows are
    learned and scored as often as they come; without training rows every word is unknown. An empty table gives none.
    """
    own = documents.where(training)
    counts = cut(count_words(own))
    v = vocabulary(counts)
    prepared = prepare(documents, training, v)
    return score(prepared, counts, v, train(own, prepared.where("training"), v)).withColumn("train_tokens", F.lit(v.total).cast("long"))
