"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie joined with itself.

``near_duplicates`` links fingerprints that differ in few bits. ``similar_documents``
takes wide fingerprints for candidates only and links by the exact Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, map_rows, raw, small_batches, stored, text_of

#: _LANES[b] has bit i of byte b in its byte i, so that up to 255 bytes add up without a carry.
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).view(np.uint64).ravel()
#: Pairs of trie nodes expanded at once, and leaf pairs compared at once.
FRONTIER = 1 << 18
#: Node pairs of so few leaf pairs are compared directly.
LEAVES = 16
#: Rows of whole subtrees that a task joins at once, unless one subtree has more.
HELD = 1 << 20
#: Fingerprints of a document whose similarity is verified, and the blocks of each that must agree once. A pair at a similarity of 0.8
#: differs in 0.151 of the bits, agrees in a block with a probability of 0.12 and so in one of them all with 0.98, at 0.85 with 0.998.
PRINTS, BLOCKS = 6, 5
#: Bits in which a pair may differ besides (a pair at 0.8 differs in 7.7 of the 51 others on average, with a deviation of 2.6), and in all
#: of its fingerprints together (58 of 384, with a deviation of 7; unlike pairs differ in 192).
APART, ALL_APART = 14, 92
#: In a subtree whose documents have more near ones than this, most are first compared with a few leaders alone.
HOT, LEADERS = 32, 64


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the uint64 ``hashes`` have each bit (lowest first)."""
    out = np.zeros(64, dtype=np.int64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    cuts = np.arange(0, len(hashes), 255)
    for k in range(8):
        out[8 * k : 8 * k + 8] = np.add.reduceat(_LANES[octets[:, k]], cuts).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: bytes, width: int = 3) -> int:
    """64 majority bits of the XXH64 (seed 42) of every ``width``-word shingle, repeats counted; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    return majority(shingle_hashes(words, width))


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``width``-word shingle, of the whole where there are no more words."""
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: -width]]
    shingles = map(joined.__getitem__, map(slice, starts, [e - 1 for e in ends[width - 1 :]]))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64, count=len(starts))


def majority(hashes: np.ndarray) -> int:
    return int(np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").view(np.uint64)[0])


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th independent hash of hashed shingles (SplitMix64)."""
    z = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(x, width) for x in raw(b.column(1))], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

        return run

    return map_rows(documents, [documents["doc_id"].cast("long").alias("doc_id"), text_of(documents)], make, "doc_id long, fp long")


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, bits) of budget + 1 blocks that cover 64 bits."""
    at = [round(64 * i / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _rotated(values: np.ndarray, by: int) -> np.ndarray:
    return values if by == 0 else (values << np.uint64(by)) | (values >> np.uint64(64 - by))


def trie_self_join(keys: np.ndarray, equal: int, budget: int, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of sorted distinct uint64 ``keys`` that share the top ``equal`` bits and differ in at most ``budget`` others.

    A node of the trie is a range of ``keys`` with a common prefix. Pairs of
    nodes, a node with itself included, go down one bit at a time, carry the
    differing bits so far, and end when these exceed the budget or a side is empty.
    Pairs of nodes that are wholly of one and the same ``group`` end as well.
    """
    if len(keys) < 2:
        return
    if group is not None:
        change = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1
        run_end = change[np.searchsorted(change, np.arange(len(group)), side="right")]
    top = keys >> np.uint64(64 - equal)
    starts = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    many = ends - starts > 1
    s, e = starts[many], ends[many]
    stack = [(equal, s, e, s, e, np.zeros(len(s), dtype=np.int8))]
    while stack:
        bit, al, ah, bl, bh, err = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(bit, *(x[half:] for x in (al, ah, bl, bh, err))), (bit, *(x[:half] for x in (al, ah, bl, bh, err)))]
            continue
        small = (ah - al) * (bh - bl) <= LEAVES
        if bit == 64:
            small[:] = True
        if small.any():
            yield from _leaves(keys, al[small], ah[small], bl[small], bh[small], budget)
            al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        mask, low = np.uint64(1) << np.uint64(63 - bit), (np.uint64(1) << np.uint64(63 - bit)) - np.uint64(1)

        def middle(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            first_one = (keys[lo] & ~low) | mask
            return np.clip(np.searchsorted(keys, first_one), lo, hi)

        am, bm, same = middle(al, ah), middle(bl, bh), al == bl
        parts = [
            (al, am, bl, bm, err),
            (am, ah, bm, bh, err),
            (al, am, bm, bh, err + 1),
            *([tuple(x[~same] for x in (am, ah, bl, bm, err + 1))] if not same.all() else []),
        ]
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*parts))
        keep = (err <= budget) & (ah > al) & (bh > bl) & ~((al == bl) & (ah - al == 1))
        if group is not None and keep.any():
            al, ah, bl, bh, err = (x[keep] for x in (al, ah, bl, bh, err))
            keep = ~((run_end[al] >= ah) & (run_end[bl] >= bh) & (group[al] == group[bl]))
        if keep.any():
            stack.append((bit + 1, *(x[keep] for x in (al, ah, bl, bh, err))))


def _leaves(keys, al, ah, bl, bh, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    wide = bh - bl
    n = (ah - al) * wide
    pair = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i, j = al[pair] + k // wide[pair], bl[pair] + k % wide[pair]
    near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
    yield i[near], j[near]


def whole_groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows that are sorted by the first ``by`` of them, about HELD at once, cut between groups."""
    held, size, most = [], 0, HELD
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        size += b.num_rows
        if size >= most:
            whole = [np.concatenate(x) for x in zip(*held)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in whole[:by]], axis=0))
            last = int(new[-1]) + 1 if len(new) else 0
            if last:
                yield [c[:last] for c in whole]
            held = [[c[last:] for c in whole]]
            size -= last
            most = max(HELD, 2 * size)
    if size:
        yield [np.concatenate(x) for x in zip(*held)]


def links(nodes: DataFrame, budget: int = 2) -> DataFrame:
    """Links (u, v) between the ids of distinct fingerprints, rows (fp, id), that differ in at most ``budget`` bits.

    Of budget + 2 blocks of bits two at least are equal in both, so each
    fingerprint goes once to the subtree of each two blocks, and a pair is given
    by the first two in which it agrees. For two bits a subtree shares half of
    all bits, so it stays small; a task joins its subtrees one after the other. A fingerprint has a bounded number of
    neighbours (2,080 for two bits), so links grow as the fingerprints do.
    """
    blocks = _blocks(budget + 1)
    deals = list(combinations(range(len(blocks)), 2))
    small_batches(nodes.sparkSession)
    part = lambda k: f"(shiftrightunsigned(fp, {64 - sum(blocks[k])}) & {(1 << blocks[k][1]) - 1}L)"
    parts = F.array(*[F.struct(F.lit(k).alias("deal"), F.expr(f"shiftleft({part(i)}, {blocks[j][1]}) | {part(j)}").alias("value")) for k, (i, j) in enumerate(deals)])
    dealt = nodes.select("fp", "id", F.explode(parts).alias("b")).select("b.deal", "b.value", "fp", "id").repartition("deal", "value").sortWithinPartitions("deal", "value")

    def bits(fp: np.ndarray, k: int) -> np.ndarray:
        first, n = blocks[k]
        return (fp >> np.uint64(64 - first - n)) & np.uint64((1 << n) - 1)

    def join(batches):
        for deal, _, fps, node in whole_groups(batches, 2):
            fps = fps.view(np.uint64)
            for k, chosen in enumerate(deals):
                own = np.flatnonzero(deal == k)
                if len(own) < 2:
                    continue
                fp = fps[own]
                keys = np.zeros(len(fp), dtype=np.uint64)
                for m in (*chosen, *(m for m in range(len(blocks)) if m not in chosen)):
                    keys = (keys << np.uint64(blocks[m][1])) | bits(fp, m)
                order = np.argsort(keys)
                keys, ids, fp = keys[order], node[own][order], fp[order]
                for i, j in trie_self_join(keys, sum(blocks[m][1] for m in chosen), budget):
                    differ = fp[i] ^ fp[j]
                    for a, b in deals[:k]:
                        new = (bits(differ, a) != 0) | (bits(differ, b) != 0)
                        i, j, differ = i[new], j[new], differ[new]
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["u", "v"])

    return dealt.mapInArrow(join, "u long, v long")


def near_duplicates(documents: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``documents``.

    component_id is the smallest doc_id reached over links of at most
    ``budget`` differing bits. Null and empty texts have fingerprint zero,
    linked like any other. Repeated rows each give a row; rows that share a
    doc_id count as one document. A null doc_id joins the component of
    its fingerprint without lending an id, null where there is no other.
    """
    docs = cut(fingerprints(documents, width))
    nodes = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("id")))
    roots = components(links(nodes.where("id is not null"), budget))
    # the class of each fingerprint, then of each row; a hot fingerprint is split by adaptive execution
    classes = nodes.join(roots, nodes["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return docs.join(classes, "fp").select("doc_id", "fp", "component_id")


def _described(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, row, key, p0, p1, ...) of every row: a hash of the row, one of its words, and PRINTS fingerprints of its set of shingles, null without words."""
    names = [f"p{k}" for k in range(PRINTS)]

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            key, fps = [], []
            for x in raw(b.column(2)):
                words = x.lower().split()
                key.append(xxhash.xxh64_intdigest(b" ".join(words), 42))
                own = np.unique(shingle_hashes(words, width)) if words else np.array([], dtype=np.uint64)
                fps.append([majority(mixed(own, k)) for k in range(PRINTS)] if words else None)
            none = np.array([f is None for f in fps])
            prints = np.array([f or [0] * PRINTS for f in fps], dtype=np.uint64).view(np.int64).reshape(-1, PRINTS)
            cols = [b.column(0), b.column(1), pa.array(np.array(key, dtype=np.uint64).view(np.int64)), *(pa.array(prints[:, k], mask=none) for k in range(PRINTS))]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "key", *names])

        return run

    return map_rows(documents, [documents["doc_id"].cast("long").alias("doc_id"), _row(documents).alias("row"), text_of(documents)], make, "doc_id long, row long, key long, " + ", ".join(f"{n} long" for n in names))


def _row(documents: DataFrame) -> Column:
    return F.xxhash64(documents["doc_id"].cast("long"), documents["text"].cast("string"))


def _candidates(nodes: DataFrame) -> DataFrame:
    """Rows (t, key, fp, other) from nodes (key, p0, p1, ...): pairs (key, other), and the members of hot subtrees t with a null other."""
    blocks = _blocks(BLOCKS - 1)
    small_batches(nodes.sparkSession)
    value = lambda k, a, n: f"shiftrightunsigned(p{k}, {64 - a - n}) & {(1 << n) - 1}L"
    parts = F.array(*[F.struct(F.lit(k * BLOCKS + i).alias("deal"), F.expr(value(k, a, n)).alias("value"), F.col(f"p{k}").alias("fp")) for k in range(PRINTS) for i, (a, n) in enumerate(blocks)])
    dealt = nodes.where("p0 is not null").select("key", F.explode(parts).alias("b")).select("b.deal", "b.value", "b.fp", "key").repartition("deal", "value").sortWithinPartitions("deal", "value")

    def join(batches):
        for deal, _, fp, node in whole_groups(batches, 2):
            for k in np.unique(deal):
                own = deal == k
                yield from _near(fp[own].view(np.uint64), node[own], int(k))

    return dealt.mapInArrow(join, "t long, key long, fp long, other long")


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(u), pa.int64())
    return pa.RecordBatch.from_arrays([none, pa.array(np.minimum(u, v)), none, pa.array(np.maximum(u, v))], ["t", "key", "fp", "other"])


def _near(fp: np.ndarray, node: np.ndarray, deal: int) -> Iterator[pa.RecordBatch]:
    """Near pairs of the deal's subtrees; of hot ones the pairs with LEADERS leaders and all members."""
    first, equal = _blocks(BLOCKS - 1)[deal % BLOCKS]
    keys = _rotated(fp, first)
    order = np.argsort(keys)
    keys, fp, node = keys[order], fp[order], node[order]
    top = keys >> np.uint64(64 - equal)
    starts = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    hot = np.zeros(len(keys), dtype=bool)
    for a, b in zip(starts, ends):
        if b - a <= HOT:
            continue
        some = keys[np.linspace(a, b - 1, 16).astype(np.int64)]
        if max(int((np.bitwise_count(keys[a:b] ^ x) <= APART).sum()) for x in some) <= HOT:
            continue
        hot[a:b] = True
        rest = np.lexsort((node[a:b],)) + a  # the smallest hash leads, in every subtree alike
        for _ in range(LEADERS):
            near = np.bitwise_count(keys[rest] ^ keys[rest[0]]) <= APART
            led = rest[near][1:]
            if len(led):
                yield _pairs(np.repeat(node[rest[0]], len(led)), node[led])
            rest = rest[~near]
            if not len(rest):
                break
    if hot.any():
        t = (np.int64(deal) << np.int64(32)) | top[hot].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(node[hot]), pa.array(fp[hot].view(np.int64)), pa.nulls(int(hot.sum()), pa.int64())], ["t", "key", "fp", "other"])
    keys, node = keys[~hot], node[~hot]
    for i, j in _expanded(keys, equal, None):
        yield _pairs(node[i], node[j])


def _expanded(keys: np.ndarray, equal: int, group: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of sorted ``keys``, equal ones among them, by the trie; of different groups only, if these are given."""
    if len(keys) < 2:
        return
    single, at, n = np.unique(keys, return_index=True, return_counts=True)
    end, own = at + n, None
    same = np.flatnonzero(n > 1)
    if group is not None:
        least, most = np.minimum.reduceat(group, at), np.maximum.reduceat(group, at)
        same = same[least[same] != most[same]]
        own = np.where(least == most, least, -1 - np.arange(len(at)))  # a value of several groups is like no other
    for a, b in chain([(same, same)], trie_self_join(single, equal, APART, own)):
        if len(a):
            for i, j in _leaves(keys, at[a], end[a], at[b], end[b], APART):
                if group is not None:
                    other = group[i] != group[j]
                    i, j = i[other], j[other]
                if len(i):
                    yield i, j


def _across(hot: DataFrame) -> DataFrame:
    """Near pairs (u, v) of the hot subtrees' members (t, key, fp, root) that differ in the root."""

    def join(batches):
        for t, key, fp, root in whole_groups(batches, 1):
            _, root = np.unique(root, return_inverse=True)
            for deal in np.unique(t >> 32):
                own = np.flatnonzero(t >> 32 == deal)
                first, equal = _blocks(BLOCKS - 1)[int(deal) % BLOCKS]
                keys = _rotated(fp[own].view(np.uint64), first)
                order = np.argsort(keys)
                keys, node, group = keys[order], key[own][order], root[own][order]
                for i, j in _expanded(keys, equal, group):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["u", "v"])

    small_batches(hot.sparkSession)
    return hot.select("t", "key", "fp", "root").repartition("t").sortWithinPartitions("t").mapInArrow(join, "u long, v long")


def similar_pairs(pairs: DataFrame, documents: DataFrame, described: DataFrame, prints: DataFrame, width: int, percent: int) -> DataFrame:
    """Of distinct ``pairs`` (u, v) of keys those whose shingle sets have an exact Jaccard similarity of ``percent`` or more.

    Pairs whose fingerprints differ in too many bits are left out first; one text of each key that remains is fetched.
    """
    small_batches(pairs.sparkSession)
    names = [f"p{k}" for k in range(PRINTS)]
    of = lambda k: prints.select(F.col("key").alias(k), *[F.col(n).alias(k + n) for n in names])
    apart = F.expr(" + ".join(f"bit_count(u{n} ^ v{n})" for n in names))
    likely = cut(pairs.join(of("u"), "u").join(of("v"), "v").where(apart <= ALL_APART).select("u", "v"))
    needed = likely.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    rows = described.join(needed, "key").groupBy("key").agg(F.min(F.struct("row", "doc_id")).alias("r")).select("key", "r.row", "r.doc_id")
    own = documents.select(_row(documents).alias("row"), documents["doc_id"].cast("long").alias("own_id"), text_of(documents))
    texts = cut(own.join(rows, "row").where(F.col("own_id").eqNullSafe(F.col("doc_id"))).groupBy("key").agg(F.min("text").alias("text")))
    side = lambda k, s: texts.select(F.col("key").alias(k), F.col("text").alias(s))
    joined = likely.join(side("u", "a"), "u").join(side("v", "b"), "v")

    def run(batches):
        @lru_cache(64)
        def of(text: bytes) -> np.ndarray:
            return np.unique(shingle_hashes(text.lower().split(), width))

        for b in batches:
            keep = []
            for x, y in zip(raw(b.column(2)), raw(b.column(3))):
                x, y = of(x), of(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * 100 >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return cut(joined.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"))


def similar_documents(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, component_id) of every row of ``documents``, linked by exact Jaccard similarity of ``width``-word shingle sets.

    Of PRINTS fingerprints of the set each has BLOCKS blocks of bits; documents that agree in
    one and differ in at most APART bits of that fingerprint are candidates, and are verified. Where
    many share a block most are compared with leaders first, and then across the components found so far, so a
    group of near copies takes no square of pairs. Equal words are one class, no words among them;
    ids are handled as in ``near_duplicates``. Other columns aren't read; an empty table has no rows.
    """
    docs = stored(_described(documents, width), "simhash-prints")
    names = [f"p{k}" for k in range(PRINTS)]
    nodes = cut(docs.groupBy("key").agg(F.min("doc_id").alias("id"), *[F.min(n).alias(n) for n in names]))
    verified = lambda pairs: similar_pairs(pairs, documents, docs, nodes, width, percent)
    found = cut(_candidates(nodes))
    pairs = verified(found.where("t is null").select(F.col("key").alias("u"), F.col("other").alias("v")).distinct())
    roots = cut(components(pairs).withColumnRenamed("node", "key"))
    hot = found.where("t is not null").join(roots, "key", "left").select("t", "key", "fp", F.coalesce("root", "key").alias("root"))
    mixed = hot.groupBy("t").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("t")
    across = cut(_across(hot.join(mixed, "t")).distinct())
    if not across.isEmpty():
        pairs = pairs.unionByName(verified(across))
        roots = cut(components(pairs).withColumnRenamed("node", "key"))
    # a class is named by its smallest id, whichever of its members has one
    classes = nodes.join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"), "id")
    named = classes.join(classes.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("key", "component_id")
    return docs.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")
