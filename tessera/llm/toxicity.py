"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, map_rows, raw, small_batches, stored, temporary, text_of
from .decontaminate import words
from .learn import Adam, labelled, labelled_sample, platt, release, sigmoid

#: Words hash into so many buckets; those in most training texts have a row of their own, all others share row 0.
BUCKETS, ROWS = 1 << 22, 1 << 15
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
#: Padding on either side, so that every width fits and neighbours in a batch don't mix.
PAD = max(WIDTHS) - 1
EPOCHS, BATCH, RATE, ROW_RATE = 6, 16, 0.002, 0.5
#: Updates at least, so that a small sample is gone through more often.
STEPS = 600
#: Passes over all training rows after the start, bytes of text in a lane of such a pass, and the first level's fan of the average.
PASSES, LANE_BYTES, FAN = 2, 8 << 20, 32
#: Rows of each label that a language's own threshold needs, and the steps of a logit that calibration tells apart.
LEAST, STEP = 5, 64
THRESHOLD = 0.7
#: Words whose gathered rows are held at once.
PIECE = 1 << 16


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


class Rows(dict):
    """word -> row, filled on demand and emptied when large."""

    def __init__(self, row_of: dict[int, int]):
        super().__init__()
        self.row_of = row_of

    def __missing__(self, word: bytes) -> int:
        row = self.row_of.get(bucket(word), 0)
        if len(word) <= 64:  # so that an entry takes 200 bytes at most
            if len(self) >= 150_000:
                self.clear()
            self[word] = row
        return row

    def of(self, text: bytes) -> np.ndarray:
        w = words(text)
        return np.fromiter(map(self.__getitem__, w), dtype=np.int32, count=len(w))


@dataclass
class Model:
    row_of: dict[int, int]
    table: np.ndarray  # of each row, its share in each filter at each offset of each width
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    a: float = 1.0
    b: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def features(self, texts: list[np.ndarray]) -> np.ndarray:
        """Max-pooled filter outputs over the whole of each text of rows; texts are cut into overlapping pieces, so any length fits."""
        pieces, owner = [], []
        pad = np.zeros(PAD, dtype=np.int32)
        for k, ids in enumerate(texts):
            ids = np.concatenate((pad, ids, pad))
            for at in range(0, max(1, len(ids) - PAD), PIECE):
                pieces.append(ids[at : at + PIECE + PAD])
                owner.append(k)
        best = np.empty((len(pieces), len(WIDTHS) * FILTERS), dtype=np.float32)
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end]) <= PIECE):
                size += len(pieces[end])
                end += 1
            ends = np.cumsum([len(p) for p in pieces[at:end]])
            starts = np.r_[0, ends[:-1]]
            g = self.table.take(np.concatenate([*pieces[at:end], pad]), axis=0)
            col = 0
            for i, w in enumerate(WIDTHS):
                z = g[:size, col : col + FILTERS].copy()
                for j in range(1, w):
                    z += g[j : size + j, col + j * FILTERS : col + (j + 1) * FILTERS]
                    z[ends - j] = -1e30  # such a window would reach into the next piece
                best[at:end, i * FILTERS : (i + 1) * FILTERS] = np.maximum.reduceat(z, starts, axis=0)
                col += w * FILTERS
            at = end
        owner = np.array(owner)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        return np.maximum(np.maximum.reduceat(best, first, axis=0) + self.bias, 0)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.features(texts) @ self.out + self.out_bias if texts else np.zeros(0)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.a * self.logits(texts) + self.b)


class Learner:
    """Weights while they learn: rows of the embeddings, which few texts touch, by steps scaled to their own gradients, all others by Adam."""

    def __init__(self, p: dict[str, np.ndarray], emb: np.ndarray, seen: np.ndarray):
        self.p, self.emb, self.seen = ({k: v.copy() for k, v in p.items()}, emb.copy(), seen.copy())
        self.adam, self.times = Adam(self.p, RATE), np.zeros(len(emb), np.float32)  # batches that moved a row

    def epoch(self, ids: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> None:
        order = rng.permutation(len(ids))
        for at in range(0, len(order), BATCH):
            self._batch([ids[k] for k in order[at : at + BATCH]], y[order[at : at + BATCH]])

    def _batch(self, ids: list[np.ndarray], y: np.ndarray) -> None:
        p, emb, seen = self.p, self.emb, self.seen
        g = {k: np.zeros_like(v) for k, v in p.items()}
        touched, moved = [], []
        for own, label in zip(ids, y):
            x = np.concatenate((np.zeros(PAD, np.int32), own, np.zeros(PAD, np.int32)))
            e = emb[x]
            parts = []
            for w in WIDTHS:
                u = np.concatenate([e[j : len(x) - w + 1 + j] for j in range(w)], axis=1)
                z = u @ p[f"w{w}"]
                parts.append((w, u, z.argmax(axis=0), z.max(axis=0)))
            m = np.concatenate([z for *_, z in parts]) + p["bias"]
            feature = np.maximum(m, 0)
            error = float(sigmoid(feature @ p["out"] + p["out_bias"][0])) - label
            g["out"] += error * feature
            g["out_bias"] += error
            back = error * p["out"] * (m > 0)
            g["bias"] += back
            for i, (w, u, top, _) in enumerate(parts):
                d = back[i * FILTERS : (i + 1) * FILTERS]
                g[f"w{w}"] += u[top].T * d
                for j in range(w):
                    touched.append(x[top + j])
                    moved.append(p[f"w{w}"][j * DIM : (j + 1) * DIM].T * d[:, None])
        self.adam.step({k: v / BATCH + 1e-4 * p[k] for k, v in g.items()})
        where, back_to = np.unique(np.concatenate(touched), return_inverse=True)
        total = np.zeros((len(where), DIM), np.float32)
        np.add.at(total, back_to, np.concatenate(moved) / BATCH)
        seen[where] += (total**2).mean(axis=1, keepdims=True)
        emb[where] -= ROW_RATE * total / np.sqrt(seen[where])
        emb[0] = 0
        self.times[where] += 1

    def model(self, row_of: dict[int, int]) -> Model:
        table = np.concatenate([self.emb @ self.p[f"w{w}"][j * DIM : (j + 1) * DIM] for w in WIDTHS for j in range(w)], axis=1)
        return Model(row_of, np.ascontiguousarray(table), self.p["bias"], self.p["out"], float(self.p["out_bias"][0]))


def _fresh(rows: int, share: float, rng: np.random.Generator) -> Learner:
    """All weights at random; row 0, of the words without an own one, stays zero."""
    emb = (0.05 * rng.standard_normal((rows, DIM))).astype(np.float32)
    emb[0] = 0
    p = {f"w{w}": (0.3 * rng.standard_normal((w * DIM, FILTERS))).astype(np.float32) for w in WIDTHS}
    p |= {"bias": np.zeros(len(WIDTHS) * FILTERS, np.float32), "out": (0.1 * rng.standard_normal(len(WIDTHS) * FILTERS)).astype(np.float32), "out_bias": np.array([np.log((share + 1e-3) / (1 - share + 1e-3))], np.float32)}
    return Learner(p, emb, np.full((rows, 1), 1e-2, np.float32))


def _vocabulary(texts: DataFrame) -> dict[int, int]:
    """The buckets that most of all texts hold, of two texts at least, with their rows."""

    def count(batches):
        held = np.zeros(BUCKETS, np.int32)
        for b in batches:
            for t in raw(b.column(0)):
                held[list({bucket(w) for w in words(t)})] += 1
        found = np.flatnonzero(held)
        for at in range(0, len(found), PIECE):
            own = found[at : at + PIECE]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(held[own], pa.int64())], ["bucket", "n"])

    counts = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1")
    return {r.bucket: i + 1 for i, r in enumerate(counts.orderBy(F.desc("n"), "bucket").limit(ROWS - 1).collect())}


def _pass(rows: DataFrame, lanes: int, row_of: dict[int, int], start: Learner, seed: int) -> Learner:
    """One pass over all of ``rows``, each lane from ``start``: weights averaged by rows, those of a word by the batches that moved it.

    A lane's rows and order follow from the data alone, so the result doesn't depend on the cluster.
    """
    spark = rows.sparkSession
    names = sorted(start.p)
    shared = spark.sparkContext.broadcast((row_of, start.p, start.emb, start.seen))  # at most ROWS rows

    def learn(table: pa.Table) -> pa.Table:
        lane, (row_of, p, emb, seen) = table.column("lane")[0].as_py(), shared.value
        own, ids_of = Learner(p, emb, seen), Rows(row_of)
        data = sorted(zip(table.column("doc_id").to_pylist(), raw(table.column("text")), table.column("y").to_pylist()))
        own.epoch([ids_of.of(t) for _, t, _ in data], np.array([y for *_, y in data], np.float32), np.random.default_rng((seed, lane)))
        n = float(len(data))
        flat = [n * np.concatenate([own.p[k].ravel() for k in names]), (own.times[:, None] * (own.emb - emb)).ravel(), (own.seen - seen).ravel(), own.times]
        return pa.table({"lane": pa.array([lane], pa.int32()), "n": [n], "x": [np.concatenate(flat).astype(np.float32).tobytes()]})

    def total(table: pa.Table) -> tuple[int, float, np.ndarray]:
        found = sorted(zip(table.column("lane").to_pylist(), table.column("n").to_pylist(), table.column("x").to_pylist()), key=lambda r: r[0])
        x = np.zeros(len(found[0][2]) // 4)
        for *_, b in found:
            x += np.frombuffer(b, np.float32)
        return found[0][0], sum(n for _, n, _ in found), x

    def add(table: pa.Table) -> pa.Table:
        lane, n, x = total(table)
        return pa.table({"lane": pa.array([lane], pa.int32()), "n": [n], "x": [x.astype(np.float32).tobytes()]})

    small_batches(spark)
    schema = "lane int, n double, x binary"
    dealt = rows.select("doc_id", "text", "y", F.pmod(F.xxhash64("doc_id", "text"), F.lit(lanes)).cast("int").alias("lane"))
    parts = dealt.groupBy("lane").applyInArrow(learn, schema)
    parts = parts.groupBy((F.col("lane") % FAN).alias("g")).applyInArrow(add, schema)
    found = sorted(((r.lane, r.n, bytes(r.x)) for r in parts.toLocalIterator()), key=lambda r: r[0])
    n = sum(n for _, n, _ in found)
    x = sum(np.frombuffer(b, np.float32).astype(np.float64) for *_, b in found)
    out, at = Learner(start.p, start.emb, start.seen), 0
    for k in names:
        out.p[k][...] = (x[at : at + out.p[k].size] / n).reshape(out.p[k].shape)
        at += out.p[k].size
    moved, seen, times = np.split(x[at:], [out.emb.size, out.emb.size + out.seen.size])
    share = np.maximum(times, 1)[:, None]
    out.emb += (moved.reshape(out.emb.shape) / share).astype(np.float32)
    out.seen += (seen.reshape(out.seen.shape) / lanes).astype(np.float32)
    return out


def _calibrate(model: Model, rest: DataFrame) -> None:
    """The scores' calibration and each language's threshold from all rows of ``rest``, counted by label and logit in steps of 1 / STEP."""
    shared = rest.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        rows = Rows(m.row_of)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            z = np.clip(np.rint(STEP * m.logits([rows.of(t) for t in raw(b.column(0))])), -64 * STEP, 64 * STEP)
            return pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(z.astype(np.int32))], ["lang", "y", "z"])

        return run

    counts = cut(map_rows(rest, [F.col("text"), F.col("lang"), F.col("y")], make, "lang string, y int, z int").groupBy("lang", "y", "z").agg(F.count("*").alias("n")))
    # of languages with too few rows for a threshold of their own, and of nulls, only the sums are needed
    enough = counts.where("lang is not null").groupBy("lang").agg(F.sum(F.col("y") * F.col("n")).alias("bad"), F.sum((1 - F.col("y")) * F.col("n")).alias("good")).where(f"bad >= {LEAST} and good >= {LEAST}")
    named = counts.join(enough.select("lang", F.col("lang").alias("own")), "lang", "left")
    found = named.groupBy("own", "y", "z").agg(F.sum("n").alias("n")).collect()
    if not found:
        return
    found.sort(key=lambda r: (r.own or "", r.own is None, r.y, r.z))
    logits, y, n = (np.array(c, np.float64) for c in zip(*((r.z / STEP, r.y, r.n) for r in found)))
    model.a, model.b = platt(logits, y, n)
    model.thresholds = _thresholds(sigmoid(model.a * logits + model.b), y, [r.own for r in found], n)


def _thresholds(scores: np.ndarray, y: np.ndarray, langs: list[str | None], n: np.ndarray) -> dict[str, float]:
    """Of each language, the cut that errs least on its calibration rows, the one nearest to the default among equals; rows count ``n`` times."""
    out, order = {}, np.argsort(scores, kind="stable")
    own_rows: dict[str, list[int]] = {}
    for k in order.tolist():
        if langs[k] is not None:
            own_rows.setdefault(langs[k], []).append(k)
    for lang, own in sorted(own_rows.items()):
        s, bad, good = scores[own], np.r_[0, np.cumsum((n * y)[own])], np.r_[0, np.cumsum((n * (1 - y))[own])]
        if bad[-1] < LEAST or good[-1] < LEAST:
            continue
        cuts = np.unique(np.r_[THRESHOLD, (s[1:] + s[:-1]) / 2])
        under = np.searchsorted(s, cuts, side="left")
        wrong = bad[under] + good[-1] - good[under]
        out[lang] = float(min(zip(wrong, np.abs(cuts - THRESHOLD), cuts))[2])
    return out


def fit(documents: DataFrame, labels: DataFrame, allowed: Column, seed: int = 7) -> Model:
    """Learn from every labelled row that ``allowed`` admits; without any, every score is one half.

    The words with a row of their own are those of most texts, the weights come from four fifths of the rows, the score's
    calibration and each language's threshold from the others. Training starts on the driver, on a bounded sample; where that
    isn't all, PASSES passes over all rows follow, in lanes whose weights are averaged.
    """
    spark = documents.sparkSession
    with temporary(spark):
        rows = stored(labelled(documents, labels, "toxic", allowed), "toxicity-rows")
        is_rest = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(5)) == 4
        learn, rest = rows.where(~is_rest), rows.where(is_rest)
        n, size, share, every = *learn.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.avg("y")).first(), rows.count()
        if not every:
            n = len(WIDTHS) * FILTERS
            return Model({}, np.zeros((1, sum(WIDTHS) * FILTERS), np.float32), np.zeros(n, np.float32), np.zeros(n, np.float32), 0.0)
        rng = np.random.default_rng(seed)
        row_of = _vocabulary(learn)
        learner, ids_of = _fresh(len(row_of) + 1, 0.5 if share is None else float(share), rng), Rows(row_of)
        texts, y, _ = labelled_sample(learn, rows, "y", ~is_rest)
        ids = [ids_of.of(t) for t in texts]
        del texts
        for _ in range(max(EPOCHS, STEPS * BATCH // max(1, len(ids)))):
            learner.epoch(ids, y, rng)
        if len(ids) < n:
            for k in range(PASSES):
                learner = _pass(learn, max(1, round(size / LANE_BYTES)), row_of, learner, seed + k)
        model = learner.model(row_of)
        _calibrate(model, rest)
    del ids, learner
    release()
    return model


def score(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every row, by default doc_id, with score (0 to 1) and toxic, the decision at the language's threshold.

    The score sees only the text; null and empty texts score as no words do.
    Rows stay as they are, repeated ones too; an empty table gives none.
    """
    spark = documents.sparkSession
    keep = ["doc_id"] if keep is None else keep
    shared = spark.sparkContext.broadcast(model)  # at most ROWS rows
    lang = documents["lang"].cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    kept = [documents[c] for c in keep]
    fields = documents.select(*kept).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double", "toxic boolean"])

    def make():
        m = shared.value
        rows = Rows(m.row_of)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            s = m.scores([rows.of(t) for t in raw(b.column(len(keep)))])
            cut = np.array([m.thresholds.get(x, THRESHOLD) for x in b.column(len(keep) + 1).to_pylist()])
            return pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s), pa.array(s >= cut)], [*keep, "score", "toxic"])

        return run

    return map_rows(documents, [*kept, text_of(documents).alias("_text"), lang.alias("_lang")], make, schema)


def reject(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents`` that score under their language's threshold, with all columns, whatever their names.

    Odd rows as in ``score``; an empty table stays empty.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most ROWS rows
    text, lang = free_name(documents, "text"), free_name(documents, "lang")
    spoken = documents["lang"].cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    n = len(documents.columns)

    def make():
        m = shared.value
        rows = Rows(m.row_of)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            s = m.scores([rows.of(t) for t in raw(b.column(n))])
            cut = np.array([m.thresholds.get(x, THRESHOLD) for x in b.column(n + 1).to_pylist()])
            return pa.RecordBatch.from_arrays(b.columns[:n], b.schema.names[:n]).filter(pa.array(s < cut))

        return run

    return map_rows(documents, [*[F.col(f"`{c}`") for c in documents.columns], text_of(documents).alias(text), spoken.alias(lang)], make, documents.schema)
