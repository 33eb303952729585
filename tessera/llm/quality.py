"""Quality: a byte-level convolutional network over overlapping chunks of the whole document, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import map_rows, raw, text_of
from .learn import Adam, labelled_sample, platt, release, sigmoid

#: A filter sees WIDTH bytes, every STRIDE bytes; HALF windows make half a chunk, and chunks overlap by half.
WIDTH, STRIDE, FILTERS, HALF = 8, 4, 16, 64
EPOCHS, BATCH, RATE = 6, 16, 0.01
#: Windows held at once, a multiple of HALF.
PIECE = HALF * 1024


@dataclass
class Model:
    filters: np.ndarray  # offset, byte, filter
    bias: np.ndarray
    out: np.ndarray  # for the mean and the maximum over chunks
    out_bias: float
    a: float = 1.0
    b: float = 0.0

    def halves(self, data: np.ndarray) -> np.ndarray:
        """Maximum of each filter in every half chunk of ``data`` (uint8, padded)."""
        n = (len(data) - WIDTH) // STRIDE + 1
        found = []
        for at in range(0, n, PIECE):
            m = min(PIECE, n - at)
            begin = at * STRIDE
            z = self.filters[0].take(data[begin : begin + STRIDE * m : STRIDE], axis=0)
            for j in range(1, WIDTH):
                z += self.filters[j].take(data[begin + j : begin + j + STRIDE * (m - 1) + 1 : STRIDE], axis=0)
            found.append(np.maximum.reduceat(z, np.arange(0, m, HALF), axis=0))
        return np.concatenate(found)

    def logit(self, text: bytes) -> float:
        h = self.halves(padded(text))
        chunk = np.maximum(np.maximum(h[:-1], h[1:]) if len(h) > 1 else h, -self.bias) + self.bias
        return float(chunk.mean(axis=0) @ self.out[:FILTERS] + chunk.max(axis=0) @ self.out[FILTERS:] + self.out_bias)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.a * np.array([self.logit(t) for t in texts]) + self.b)


def padded(text: bytes) -> np.ndarray:
    """Bytes with zeros after them until the last one is seen by a filter."""
    n = max(len(text), WIDTH)
    return np.frombuffer(text + bytes(n - len(text) + (WIDTH - n) % STRIDE), dtype=np.uint8)


def train(texts: list[bytes], y: np.ndarray, seed: int = 11) -> Model:
    """Gradients run through the maxima to the winning windows; four fifths fit the network, the rest calibrates its score."""
    rng = np.random.default_rng(seed)
    fit = np.arange(len(texts)) % 5 != 4
    share = float(y[fit].mean()) if fit.any() else 0.5
    p = {
        "filters": (0.2 * rng.standard_normal((WIDTH, 256, FILTERS))).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": (0.1 * rng.standard_normal(2 * FILTERS)).astype(np.float32),
        "out_bias": np.array([np.log((share + 1e-3) / (1 - share + 1e-3))], np.float32),
    }
    data = [padded(t) for t in texts]
    adam, order, each = Adam(p, RATE), np.flatnonzero(fit), np.arange(FILTERS)
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            g = {k: np.zeros_like(v) for k, v in p.items()}
            for k in order[at : at + BATCH]:
                x = data[k]
                n = (len(x) - WIDTH) // STRIDE + 1
                z = p["filters"][0].take(x[: STRIDE * n : STRIDE], axis=0)
                for j in range(1, WIDTH):
                    z += p["filters"][j].take(x[j : j + STRIDE * (n - 1) + 1 : STRIDE], axis=0)
                h = -(-n // HALF)
                z = np.concatenate((z, np.full((h * HALF - n, FILTERS), -1e30, np.float32))).reshape(h, HALF, FILTERS)
                win = z.argmax(axis=1)
                best = np.take_along_axis(z, win[:, None], axis=1)[:, 0]
                where = win + HALF * np.arange(h)[:, None]
                if h > 1:
                    right = best[1:] > best[:-1]
                    where, best = np.where(right, where[1:], where[:-1]), np.maximum(best[1:], best[:-1])
                chunk = np.maximum(best + p["bias"], 0)
                top = chunk.argmax(axis=0)
                f = np.concatenate((chunk.mean(axis=0), chunk[top, each]))
                error = float(sigmoid(f @ p["out"] + p["out_bias"][0])) - y[k]
                g["out"] += error * f
                g["out_bias"] += error
                back = np.repeat(error * p["out"][None, :FILTERS] / len(chunk), len(chunk), axis=0)
                back[top, each] += error * p["out"][FILTERS:]
                back *= chunk > 0
                g["bias"] += back.sum(axis=0)
                for j in range(WIDTH):
                    np.add.at(g["filters"][j], (x[where * STRIDE + j], each[None, :]), back)
            adam.step({k: v / BATCH + 1e-4 * p[k] for k, v in g.items()})
    model = Model(p["filters"], p["bias"], p["out"], float(p["out_bias"][0]))
    rest = np.flatnonzero(~fit)
    if len(rest):
        model.a, model.b = platt(np.array([model.logit(texts[k]) for k in rest]), y[rest])
    return model


def fit(documents: DataFrame, labels: DataFrame, allowed: Column) -> Model:
    """Train on a bounded sample of the labelled rows that ``allowed`` admits; without any, every score is one half."""
    texts, y, _ = labelled_sample(documents, labels, "quality", allowed)
    if not texts:
        return Model(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), 0.0)
    model = train(texts, y)
    del texts
    release()
    return model


def score(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every row, by default doc_id, with score (0 to 1, higher: better).

    Every byte of the text is seen; null and empty texts score as no bytes
    do. Rows stay as they are, repeated ones too; an empty table gives none.
    """
    keep = ["doc_id"] if keep is None else keep
    shared = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size
    kept = [documents[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*kept).schema), "score double"])

    def make():
        m = shared.value

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(m.score(raw(b.column(len(keep)))))], [*keep, "score"])

        return run

    return map_rows(documents, [*kept, text_of(documents).alias("_text")], make, schema)
