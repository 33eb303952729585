"""Nearest neighbours by shifted space-filling curves.

Vectors are turned by random rotations, each curve takes DIMS of the turned
coordinates, squeezes them into the unit cube, shifts them, and orders them by
their Hilbert index. A curve is cut into blocks of about the same number of
vectors; a query meets the block that holds its key and the neighbouring ones,
on every curve, and what it meets is ranked by the exact inner product. How
far a query reaches is measured: on the sample, so far that RECALL of the true
neighbours are met. Vectors with structure need a small part of each curve;
isotropic ones, whose neighbours no order keeps together, a constant share of all vectors.
Maximum inner products become nearest neighbours by one more coordinate, which
brings every vector to the length of the longest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

CURVES, DIMS, BITS = 16, 4, 12
#: Vectors that the rotations' scale, the blocks' bounds and the reach are fitted on, in the order of a hash of their ids, and those of them that ask.
SAMPLE, ASK = 20_000, 400
#: Share of the sample's true neighbours that the reach must meet.
RECALL = 0.95
#: A curve has at least LEAST blocks, as far as they hold FEW vectors, and blocks of about FULL vectors beyond, split by id
#: where the sample gives no more bounds.
LEAST, FEW, FULL = 128, 32, 4096


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer cells (n x dims), by Skilling's transform: undo excess work from the top bit, then Gray-encode."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for i in range(dims):
            on = (x[i] >> np.uint64(b)) & np.uint64(1) == 1
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    fix = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, 0, -1):
        fix ^= np.where((x[-1] >> np.uint64(b)) & np.uint64(1) == 1, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= fix
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key


@dataclass
class Index:
    """What is fitted: of fixed size but for the blocks' bounds, one for about FULL vectors of a curve."""

    longest: float
    axes: np.ndarray  # curve, coordinate, dim
    middle: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    bounds: np.ndarray  # curve, inner bound
    reach: int  # neighbouring blocks on either side
    split: int  # parts of a block

    def lift(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """One more coordinate; queries are scaled to the longest length, candidates filled up to it."""
        square = (vectors * vectors).sum(axis=1)
        if query:
            return np.c_[vectors * (self.longest / np.sqrt(square))[:, None], np.zeros(len(vectors))]
        return np.c_[vectors, np.sqrt(np.maximum(self.longest**2 - square, 0))]

    def keys(self, lifted: np.ndarray) -> np.ndarray:
        """curve x vector"""
        out = []
        for axes, middle, scale, shift in zip(self.axes, self.middle, self.scale, self.shift):
            inside = 0.5 + 0.5 * np.tanh(0.8 * (lifted @ axes - middle) / scale)
            out.append(hilbert(((inside + shift) * ((1 << BITS) / 2 - 1)).astype(np.uint64), BITS))
        return np.array(out)

    def blocks(self, curve: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last block that may hold each key: several where many vectors share one key."""
        return np.searchsorted(self.bounds[curve], keys, side="left"), np.searchsorted(self.bounds[curve], keys, side="right")


def fit(vectors: DataFrame, k: int = 20, curves: int = CURVES, recall: float = RECALL, seed: int = 3) -> Index | None:
    """An index for ``vectors`` (vec_id, v: cleaned), None if there are none."""
    n, longest = vectors.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))).first()
    if not n:
        return None
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    x = np.array(sample.column("v").to_pylist(), dtype=np.float64)
    rng = np.random.default_rng(seed)
    width = x.shape[1] + 1
    dims = min(DIMS, width)
    turned = [np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(-(-curves // (width // dims)))]
    axes = np.array([t[:, j * dims : (j + 1) * dims] for t in turned for j in range(width // dims)][:curves])
    index = Index(float(longest), axes, np.zeros((curves, dims)), np.ones((curves, dims)), rng.random((curves, dims)), np.zeros((curves, 0), np.uint64), 0, 1)
    lifted = index.lift(x, False)
    at = np.einsum("nw,cwd->cnd", lifted, axes)
    index.middle, index.scale = at.mean(axis=1), at.std(axis=1) + 1e-12
    blocks = max(min(LEAST, n // FEW), -(-n // FULL), 1)
    blocks, index.split = min(blocks, len(x)), -(-blocks // len(x))
    keys = index.keys(lifted)
    index.reach = max(1, int(np.ceil(_share(index, x, keys, k, recall) * blocks)))
    ordered = np.sort(keys, axis=1)
    index.bounds = ordered[:, [len(x) * j // blocks for j in range(1, blocks)]]
    return index


def _share(index: Index, x: np.ndarray, keys: np.ndarray, k: int, recall: float) -> float:
    """The share of a curve, on either side, within which ``recall`` of the neighbours of some of the sample ``x`` lie on one curve at least."""
    n = len(x)
    ask = np.arange(min(n, ASK))  # the sample is in the order of a hash
    score = x[ask] @ x.T
    score[ask, ask] = -np.inf
    k = min(k, n - 1)
    if k < 1:
        return 1.0
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    least = np.ones(near.shape)
    for curve, own in enumerate(index.keys(index.lift(x[ask], True))):
        ordered = np.sort(keys[curve])
        place = np.searchsorted(ordered, own) / n
        least = np.minimum(least, np.abs(np.searchsorted(ordered, keys[curve])[near] / n - place[:, None]))
    return float(np.quantile(least, recall))


def clean(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of rows that take part: id known, vector neither null nor zero, no null or non-finite component, of the usual length."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"
    )
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == sizes.n) if sizes else rows


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _dealt(rows: DataFrame, index: Index, query: bool) -> DataFrame:
    """Rows of (curve, block, query, vec_id, v): a candidate once on a curve, a query in all blocks it meets."""
    shared = rows.sparkSession.sparkContext.broadcast(index)
    element = rows.schema["v"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        last = index.bounds.shape[1]
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            for curve, keys in enumerate(index.keys(index.lift(_matrix(b.column(1)), query))):
                lo, hi = index.blocks(curve, keys)
                if query:
                    lo, hi = np.maximum(lo - index.reach, 0) * index.split, np.minimum(hi + index.reach, last) * index.split + index.split - 1
                    n = hi - lo + 1
                    row = np.repeat(np.arange(len(n)), n)
                    block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]
                else:  # vectors that share a key which fills blocks are spread over these by id, as those of a block over its parts
                    lo, hi = lo * index.split, hi * index.split + index.split - 1
                    row, block = np.arange(len(keys)), lo + (ids * 2654435761 >> 7) % (hi - lo + 1)
                take = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array([curve] * len(row), pa.int32()), pa.array(block, pa.int32()), pa.array([query] * len(row)), take.column(0), take.column(1)], ["curve", "block", "query", "vec_id", "v"])

    return rows.select("vec_id", "v").mapInArrow(deal, f"curve int, block int, query boolean, vec_id long, v {element}")


def rank_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k nearest candidates of each query, itself left out; ties to the smaller id.

    The product of matrices chooses; scores are then summed in one fixed order, so that equal vectors score equally.
    """
    out_q, out_c, out_s = [], [], []
    for at in range(0, len(q), 256):
        rough = q[at : at + 256] @ c.T
        rough[qid[at : at + 256, None] == cid[None, :]] = -np.inf
        kth = np.partition(rough, len(cid) - k, axis=1)[:, len(cid) - k] if len(cid) > k else np.full(len(rough), -np.inf)
        size = np.abs(kth, where=np.isfinite(kth), out=np.ones(len(kth)))
        for i, r in enumerate(rough):
            near = np.flatnonzero((r >= kth[i] - 1e-9 * (1 + size[i])) & (r > -np.inf))
            s = (c[near] * q[at + i]).sum(axis=1)
            best = np.lexsort((cid[near], -s))[:k]
            out_q += [qid[at + i]] * len(best)
            out_c += cid[near[best]].tolist()
            out_s += s[best].tolist()
    return out_q, out_c, out_s


def _met(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): of rows of (curve, block, query, vec_id, v) the ``k`` best candidates of each query in each block.

    A task holds the candidates of one block and a batch of its queries at a time.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            curve, block, ask = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            ids, v = b.column(3).to_numpy(), _matrix(b.column(4))
            starts = np.flatnonzero(np.r_[True, (curve[1:] != curve[:-1]) | (block[1:] != block[:-1]) | (ask[1:] != ask[:-1])])
            for lo, hi in zip(starts, np.r_[starts[1:], b.num_rows]):
                if at != (curve[lo], block[lo]):
                    at, held = (curve[lo], block[lo]), []
                if not ask[lo]:
                    held.append((ids[lo:hi], v[lo:hi]))
                elif held:
                    if len(held) > 1:
                        held = [tuple(np.concatenate(x) for x in zip(*held))]
                    found = rank_block(ids[lo:hi], v[lo:hi], *held[0], k)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return rows.repartition("curve", "block").sortWithinPartitions("curve", "block", "query").mapInArrow(answer, "query_id long, vec_id long, score double")


def search(embeddings: DataFrame, queries: DataFrame, k: int = 20, curves: int = CURVES, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each row of ``queries`` among all rows of ``embeddings``.

    Both hold vec_id and embedding. Rows that can't take part (see ``clean``)
    neither ask nor answer. A query's own id is no candidate; queries that repeat an id and
    vector are one, rows that repeat an id compete with the better score.
    Of equal vectors the k + 1 smallest ids suffice for every answer, the
    others aren't dealt. Fewer than k candidates give all of them; no query, no rows.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    rows = cut(clean(embeddings))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    same = Window.partitionBy("v").orderBy("vec_id")
    some = cut(rows.distinct().withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("vec_id", "v"))
    index = fit(some, k, curves, recall)
    if index is None:
        return empty
    width = index.axes.shape[1] - 1
    asked = clean(queries).where(F.size("v") == width).distinct()
    meet = _dealt(some, index, False).unionByName(_dealt(asked, index, True))

    near = _met(meet, k)
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
