"""What the trained classifiers share: their bounded sample, optimisers and calibration."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A classifier learns from at most so many labelled rows and bytes of text, taken in the order of a hash of the id.
SAMPLE_ROWS = 6000
SAMPLE_BYTES = 32 << 20


#: Labels (a long and an int each) that are broadcast to the documents; more are joined by a shuffle.
SMALL_LABELS = 1_000_000


def labelled(documents: DataFrame, labels: DataFrame, label: str, allowed: Column) -> DataFrame:
    """(doc_id, text, lang, y) of every document with a label that ``allowed``, a condition on the labels, admits.

    Rows whose id or label is null are left out, a null text is empty; of labels repeated for an id the largest counts.
    """
    known = cut(
        labels.where(allowed & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    lang = documents["lang"].cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), F.coalesce(documents["text"].cast("string"), F.lit("")).alias("text"), lang.alias("lang"))
    return docs.join(F.broadcast(known) if known.count() <= SMALL_LABELS else known, "doc_id").select("doc_id", "text", "lang", "y")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray, list[str]]:
    """Whole texts, 0/1 labels and languages of a bounded sample of labelled rows.

    ``allowed`` is a condition on doc_id of the labels. Rows whose id or label
    is null are left out, texts that no longer fit are passed over; of labels repeated for an id the largest counts. The
    ids are drawn from the labels alone, so that documents are read once and
    only the drawn rows' texts move.
    """
    drawn = (
        labels.where(allowed & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    lang = documents["lang"].cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"), lang.alias("lang"))
    joined = docs.join(F.broadcast(drawn), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.octet_length("text"), "text")
    texts, y, langs, size = [], [], [], 0
    for r in joined.select("text", "y", "lang").toLocalIterator():
        if len(texts) >= rows:
            break
        t = (r.text or "").encode()
        if size + len(t) > most:
            continue
        texts.append(t)
        y.append(r.y)
        langs.append(r.lang or "")
        size += len(t)
    return texts, np.array(y, dtype=np.float32), langs


def release() -> None:
    """Hand memory that training has freed back to the system; where the C library can't, it stays."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


class Adam:
    """Adam over a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= (scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(self.p[k].dtype)


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, dtype=np.float64)))


def platt(logits: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * logit + b) is calibrated; Platt's smoothed targets keep a finite when the classes separate. Rows count ``n`` times."""
    n = np.ones(len(y)) if n is None else n
    n1, n0 = float((n * y).sum()), float((n * (1 - y)).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([1.0, 0.0])
    x = np.stack([logits.astype(np.float64), np.ones(len(y))], axis=1)
    for _ in range(60):
        p = sigmoid(x @ w)
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (n * (p - target)) + 1e-3 * (w - [1.0, 0.0]))
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
    return max(float(w[0]), 1e-3), float(w[1])
