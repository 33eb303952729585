import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import lm


def docs(n):
    r = random.Random(1)
    out = []
    for i in range(n):
        stem = r.choice(["al", "be"])  # a text keeps to one of two languages
        out.append((i, " ".join(stem + r.choice("abcdefgh") + str(r.randint(0, 3)) for _ in range(r.randint(1, 60))) + f" rare{r.randint(0, 400)}"))
    return out


def model(texts):
    c = Counter(w for t in texts for w in lm.tokens(t))
    top = sorted(c.items(), key=lambda x: (-x[1], x[0]))
    mass, once = np.zeros(lm.TAILS), np.zeros(lm.TAILS)
    for w, n in top[lm.HEAD :]:
        mass[lm.tail_class(w)] += n
        once[lm.tail_class(w)] += n == 1
    return lm.Vocabulary([w for w, _ in top[: lm.KNOWN]], np.array([n for _, n in top[: lm.KNOWN]]), sum(c.values()), len(c), mass, once)


def test_gradients(monkeypatch):
    """The update of one window lowers its loss, and the recurrent gradient agrees with finite differences."""
    texts = [t.encode() for _, t in docs(12)]
    v = model(texts)
    rng = np.random.default_rng(0)
    p = {k: x.astype(np.float64) for k, x in lm.fresh(v).items()}
    target = rng.integers(0, v.head, (5, 3)).astype(np.int32)
    before = rng.integers(0, v.head, (5, 3)).astype(np.int32)
    keep = np.ones((5, 3), bool)
    keep[2, 1] = False
    taken = {}
    log_softmax = lambda z: z - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)) - z.max(1, keepdims=True)
    monkeypatch.setattr(lm.Adam, "step", lambda self, g: taken.update(g))
    monkeypatch.setattr(lm, "ROW_RATE", 0.0)

    def loss(p):
        h, total = np.zeros((3, lm.HIDDEN)), 0.0
        for t in range(5):
            h = lm._step(p, p["in"][before[t]], h * keep[t][:, None])[0]
            z = log_softmax(h @ p["cls"] + p["cls_b"])
            for i, s in enumerate(target[t]):
                k = s // v.size
                total -= z[i, k] + log_softmax(h[i : i + 1] @ p["word"][k] + p["word_b"][k])[0, s - k * v.size]
        return total / 15

    lm.Trainer(v, {k: x.astype(np.float32) for k, x in p.items()})._window(target, before, keep, np.zeros((3, lm.HIDDEN), np.float32))
    for name in ("rec", "cls", "cls_b"):
        for at in [tuple(rng.integers(0, n) for n in p[name].shape) for _ in range(6)]:
            up, down = ({k: x.copy() for k, x in p.items()} for _ in range(2))
            up[name][at] += 1e-4
            down[name][at] -= 1e-4
            assert math.isclose((loss(up) - loss(down)) / 2e-4, taken[name][at], rel_tol=2e-2, abs_tol=2e-4)


def test_state_is_carried_over_windows_and_probabilities_add_up(monkeypatch):
    texts = [t.encode() for _, t in docs(30)]
    v = model(texts)
    p = lm.fresh(v)
    s = [v.symbols(*v.ids(t)) for t in [*texts, b"", b" ".join(texts)]]
    whole = lm.log_probabilities(v, p, s)
    monkeypatch.setattr(lm, "SCORE_STEPS", 3)
    monkeypatch.setattr(lm, "SCORE_LANES", 4)
    assert np.allclose(whole, lm.log_probabilities(v, p, s), atol=1e-3)
    every = [np.array([k], np.int32) for k in range(v.head + lm.TAILS)]  # each first token there is
    assert math.isclose((10 ** lm.log_probabilities(v, p, every)).sum(), 1, rel_tol=1e-4)


def test_scores_against_brute_force(spark, monkeypatch):
    for name, value in (("HEAD", 16), ("SIZE", 4), ("KNOWN", 40)):  # tail classes and the join are at work
        monkeypatch.setattr(lm, name, value)
    rows = [*docs(300), (9, None), (9, None), (None, "  "), (1000, "unseen WORDS here"), (1000, "unseen WORDS here")]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    out = lm.fit_and_score(df, fold != 1)
    got = sorted(out.collect(), key=lambda x: (x.doc_id or -1, x.n_tokens))
    trains = [(t or "") for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1]
    c = Counter(w for t in trains for w in lm.tokens(t.encode()))
    n, unit = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    want = []
    for i, t in rows:
        w = lm.tokens((t or "").encode())
        want.append((i or -1, len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.5) / unit) for x in w)))
    want.sort(key=lambda x: x[:2])
    assert [((x.doc_id or -1), x.n_tokens, x.n_known) for x in got] == [x[:3] for x in want]
    assert all(math.isclose(x.base_score, y[3], rel_tol=1e-9) and x.train_tokens == n for x, y in zip(got, want))
    held = [x for x in got if zlib.crc32(str(x.doc_id).encode()) % 5 == 1]
    assert sum(x.score for x in held) > sum(x.base_score for x in held) and all(x.score < 0 for x in got)
    assert lm.fit_and_score(df.limit(0), F.lit(True)).count() == 0
    unknown = lm.fit_and_score(df.where("doc_id < 20"), F.lit(False)).collect()
    assert len(unknown) == 22 and all(x.n_known == 0 and math.isfinite(x.score) for x in unknown)


def test_one_very_long_text_costs_its_own_tokens():
    """A text of a million words beside short ones: memory is in proportion to the tokens, not to lanes times the longest."""
    texts = [t.encode() for _, t in docs(200)]
    v = model(texts)
    p = lm.fresh(v)
    s = [v.symbols(*v.ids(t)) for t in texts] * 5
    long = np.resize(np.concatenate(s), 1_000_000)
    tracemalloc.start()
    short = lm.log_probabilities(v, p, s)
    both = lm.log_probabilities(v, p, [*s, long])
    lm.Trainer(v, p).run([*s, long])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(short, both[:-1], atol=1e-3) and both[-1] < 0 and peak < 150 << 20


def test_score_by_plain_loops(spark, monkeypatch):
    """``score`` again, a token at a time: gates, class, word in its class, share in a tail class, the event of an unseen word."""
    for name, value in (("HEAD", 16), ("SIZE", 4), ("KNOWN", 40)):
        monkeypatch.setattr(lm, name, value)
    kept = {}
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: kept.setdefault("p", train(*a)))
    rows = [*docs(120), (500, "unseen WORDS here"), (501, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.score for x in lm.fit_and_score(df, F.col("doc_id") % 4 != 1).collect()}
    p, v = {k: x.astype(np.float64) for k, x in kept["p"].items()}, model([(t or "").encode() for i, t in rows if i % 4 != 1])
    counts = Counter(w for i, t in rows if i % 4 != 1 for w in lm.tokens((t or "").encode()))
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    k = lm.HIDDEN
    for i, t in rows:
        h, before, total = np.zeros(k), v.start, 0.0
        for w in lm.tokens((t or "").encode()):
            x, g = p["in"][before], h @ p["rec"]
            r, z = sigmoid(x[:k] + g[:k]), sigmoid(x[k : 2 * k] + g[k : 2 * k])
            n = np.tanh(x[2 * k :] + r * g[2 * k :])
            h = z * h + (1 - z) * n
            cls = np.exp(h @ p["cls"] + p["cls_b"])
            rank = v.id_of.get(w, v.head)
            if rank < v.head:
                c = rank // 4
                word = np.exp(h @ p["word"][c] + p["word_b"][c])
                total += math.log10(cls[c] / cls.sum()) + math.log10(word[rank % 4] / word.sum())
                before = rank
            else:
                c = lm.tail_class(w)
                total += math.log10(cls[v.head_classes + c] / cls.sum()) + math.log10((counts[w] or v.tail_once[c] + 1) / v.tail_mass[c])
                before = v.head + c
        assert math.isclose(got[i], total, rel_tol=1e-4, abs_tol=1e-3)
