"""Benchmark decontamination with an FM-index of each training shard.

A shard is about a million words of whole documents; every word of it is
indexed, once, whatever the benchmark. The windows of the benchmark, block by
block, are searched backwards through the ranks of a wavelet matrix,
occurrences are located from sampled suffix positions, and overlapping ones are
merged into the spans to remove.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, small_batches

#: ASCII that is not 0-9, A-Z, a-z becomes a space and A-Z lower case, so that split() gives the words.
_TABLE = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
WINDOW = 8
#: Words of the documents indexed together, unless one text has more, and bytes of benchmark texts searched together.
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 16 << 20
#: Every so many suffix positions of a document are kept.
SAMPLE = 8


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Numbers(dict):
    """word -> number from one on, given when first asked for."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + 1
        return number


class Bits:
    """How many ones stand before a place: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate((packed, np.zeros(8 - len(packed) % 8, np.uint8))).view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]))
        self.total = int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, below = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Ranks of symbols in an integer sequence: one bit of the symbols a level, zeros before ones in the next."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1 == 1
            self.ones.append(Bits(bit))
            self.zeros.append(len(sequence) - self.ones[-1].total)
            sequence = np.concatenate((sequence[~bit], sequence[bit]))

    def rank(self, symbols: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the position beside it."""
        at, start = upto.astype(np.int64), np.zeros(len(upto), dtype=np.int64)
        for k in range(self.bits):
            bit = (symbols >> (self.bits - 1 - k)) & 1 == 1
            ones, zeros = self.ones[k], self.zeros[k]
            a, s = ones.rank(at), ones.rank(start)
            at, start = np.where(bit, zeros + a, at - a), np.where(bit, zeros + s, start - s)
        return at - start


class FMIndex:
    """Index of ``text``: documents of symbols from one on, a 0 after each. Suffixes compare up to their document's end, then by position."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        ends = np.flatnonzero(text == 0)
        starts = np.concatenate(([0], ends[:-1] + 1))
        order = self._suffixes(text, np.repeat(ends, ends - starts + 1) - np.arange(len(text)), symbols)
        self.last = text[order - 1].astype(np.int32)  # for position 0 the last symbol, a 0
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1))))
        self.tree = WaveletMatrix(self.last, max(1, int(symbols).bit_length()))
        kept = np.zeros(len(text), dtype=bool)
        kept[::sample] = kept[starts] = True
        self.sampled = kept[order]
        self.position = order[self.sampled]
        self.number = np.cumsum(self.sampled) - 1

    @staticmethod
    def _suffixes(text: np.ndarray, left: np.ndarray, symbols: int) -> np.ndarray:
        """Positions in the order of their suffixes: sorted by the first symbols at once, then only ties, by twice as many symbols each time."""
        wide = int(symbols).bit_length()
        h = max(1, min(8, 62 // max(1, wide)))
        key = text.astype(np.int64)
        for j in range(1, h):
            key <<= wide
            key[: len(text) - j] |= np.where(left[: len(text) - j] >= j, text[j:], 0)
        order = np.argsort(key, kind="stable")
        slot, new = np.arange(len(text)), np.r_[True, np.diff(key[order]) != 0]
        rank = np.empty(len(text), dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, slot, 0))
        tied = slot[~(new & np.r_[new[1:], True])]
        while len(tied := tied[left[order[tied]] >= h]):
            at = order[tied]
            first, second = rank[at], rank[at + h]
            again = np.lexsort((second, first))  # keeps equal ones in the order of their positions
            at, first, second = at[again], first[again], second[again]
            order[tied] = at
            new = np.r_[True, (np.diff(first) != 0) | (np.diff(second) != 0)]
            rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
            tied = tied[~(new & np.r_[new[1:], True])]
            h *= 2
        return order

    def find(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search. ``patterns`` hold symbols, right-aligned; gives (pattern, lo, hi) of those that occur."""
        which = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), len(self.last), dtype=np.int64)
        done = []
        for step in range(patterns.shape[1]):
            ended = lengths[which] == step
            if ended.any():
                done.append((which[ended], lo[ended], hi[ended]))
                which, lo, hi = which[~ended], lo[~ended], hi[~ended]
            c = patterns[which, patterns.shape[1] - 1 - step]
            lo, hi = self.counts[c] + self.tree.rank(c, lo), self.counts[c] + self.tree.rank(c, hi)
            found = lo < hi
            which, lo, hi = which[found], lo[found], hi[found]
        done.append((which, lo, hi))
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one. Run starts are sampled, so no walk leaves its run."""
        out, steps, at, todo = np.empty(len(rows), dtype=np.int64), 0, rows, np.arange(len(rows))
        while len(todo):
            here = self.sampled[at]
            out[todo[here]] = self.position[self.number[at[here]]] + steps
            todo, at, steps = todo[~here], at[~here], steps + 1
            c = self.last[at]
            at = self.counts[c] + self.tree.rank(c, at)
        return out


def windows_of(items: list[tuple[str, bytes]]) -> dict:
    """The distinct windows of (item id, text) pairs: the block's words, windows of their numbers from one on, right-aligned, and the items of each window."""
    number = Numbers()
    seen: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        s = [number[w] for w in words(text)]
        for i in range(max(1, len(s) - WINDOW + 1) if s else 0):
            seen.setdefault(tuple(s[i : i + WINDOW]), set()).add(item)
    patterns = np.zeros((len(seen), WINDOW), dtype=np.int32)
    for k, w in enumerate(seen):
        patterns[k, WINDOW - len(w) :] = w
    return {"words": list(number), "patterns": patterns, "items": [sorted(x) for x in seen.values()]}


class Shard:
    """Whole texts, indexed together."""

    def __init__(self, texts: list[bytes]):
        self.number = Numbers()
        own = [np.fromiter(map(self.number.__getitem__, w), dtype=np.int64, count=len(w)) for w in map(words, texts)]
        self.n = np.array([len(x) for x in own], dtype=np.int64)
        self.first = np.cumsum(self.n + 1) - (self.n + 1)  # where each text begins
        gap = np.zeros(1, dtype=np.int64)
        self.text = np.concatenate([y for x in own for y in (x, gap)]) if own else gap[:0]
        self.index = FMIndex(self.text, len(self.number)) if self.number else None
        self.hit = np.zeros(len(self.text), dtype=bool)
        self.items: list[set[str]] = [set() for _ in texts]

    def search(self, block: dict) -> None:
        """Find the block's windows; mark the words that they cover and the texts' items."""
        if self.index is None or not len(block["patterns"]):
            return
        own = np.array([0, *map(self.number.get, block["words"], [-1] * len(block["words"]))], dtype=np.int64)
        patterns = own[block["patterns"]]
        possible = np.flatnonzero((patterns >= 0).all(axis=1))
        patterns = patterns[possible]
        lengths = (patterns > 0).sum(axis=1)
        which, lo, hi = self.index.find(patterns, lengths)
        count = hi - lo
        rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        at, which = self.index.locate(rows), np.repeat(which, count)
        cover = np.bincount(at, minlength=len(self.text) + 1) - np.bincount(at + lengths[which], minlength=len(self.text) + 1)
        self.hit |= np.cumsum(cover[: len(self.text)]) > 0
        doc = np.searchsorted(self.first, at, side="right") - 1
        for d, p in np.unique(np.stack((doc, possible[which])), axis=1).T:
            self.items[d].update(block["items"][p])

    def spans(self) -> list[list[tuple[int, int]]]:
        """Of each text the merged [begin, end) word spans that windows cover; no span leaves its text, as the gap after it is never covered."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.n]
        edge = np.diff(np.concatenate(([0], self.hit.astype(np.int8), [0])))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        docs = np.searchsorted(self.first, begins, side="right") - 1
        for d, a, b in zip(docs.tolist(), (begins - self.first[docs]).tolist(), (ends - self.first[docs]).tolist()):
            out[d].append((a, b))
        return out


def search_shard(texts: list[bytes], blocks: Iterator[dict]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Of each text: its number of words, merged [begin, end) word spans covered by windows, and the sorted items found."""
    shard = Shard(texts)
    for block in blocks:
        shard.search(block)
    return shard.n, shard.spans(), [sorted(x) for x in shard.items]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark, the stated query set, in blocks of bounded bytes, one after the other."""
    block, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).distinct()
    for r in rows.toLocalIterator():
        t = r.t.encode()
        if block and size + len(t) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r.i, t))
        size += len(t)
    if block:
        yield block


def _read(shared: list) -> Iterator[dict]:
    """The blocks' windows, each loaded when its turn comes; of several, one is held at a time."""
    for b in shared:
        yield b.value
        if len(shared) > 1:
            b.__dict__.pop("_value", None)


def _by_shard(df: DataFrame, benchmark: DataFrame, text_at: int, make, schema) -> DataFrame:
    """``make(batch, n, spans, items)`` of every batch of ``df``, whose texts are searched shard by shard."""
    spark = df.sparkSession
    small_batches(spark)
    shared = [spark.sparkContext.broadcast(windows_of(items)) for items in _blocks(benchmark)]  # at most BLOCK_BYTES of text each

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            n, spans, items = search_shard([x for b in held for x in raw(b.column(text_at))], _read(shared))
            at = 0
            for b in held:
                own = slice(at, at + b.num_rows)
                yield make(b, n[own], spans[own], items[own])
                at += b.num_rows

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column(text_at).nbytes // 6
            if size >= SHARD_WORDS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return df.mapInArrow(run, schema)


_SPANS, _ITEMS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Columns of ``documents`` plus n_words, leak_spans (merged [begin, end) word spans), leak_items (sorted item ids).

    Words are runs of ASCII letters and digits and of all other non-ASCII
    characters, lower-cased in ASCII. A window is eight words of an item, or
    the whole of a shorter one. Null and empty texts have no words; null items
    or ids take no part; an empty benchmark finds nothing; items that share an
    id are one; every row of documents gives one row. Columns of documents
    that have the names of the three new ones are left out.
    """
    given = documents.drop("n_words", "leak_spans", "leak_items")
    names = given.columns
    shape = given.withColumns({"n_words": F.lit(0).cast("long"), "leak_spans": F.array().cast("array<struct<begin:bigint,end:bigint>>"), "leak_items": F.array().cast("array<string>")})

    def make(b, n, spans, items):
        found = [pa.array(n), pa.array([[{"begin": x, "end": y} for x, y in s] for s in spans], _SPANS), pa.array(items, _ITEMS)]
        return pa.RecordBatch.from_arrays([*b.columns, *found], [*names, "n_words", "leak_spans", "leak_items"])

    return _by_shard(given, benchmark, names.index("text"), make, shape.schema)


def decontaminate(documents: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    """``documents`` without the rows that hold windows of ``least_items`` items or more; from the others' texts the spans found are cut out.

    Words, windows and odd rows as in ``find_leaks``; all columns stay, whatever
    their names. A span goes from the first character of its first word to the
    last of its last word; n_chars, where there is such a column, follows a text that was cut.
    """
    names, text_at = documents.columns, documents.columns.index("text")
    count_at = names.index("n_chars") if "n_chars" in names else -1

    def make(b, n, spans, items):
        kept = [k for k, x in enumerate(items) if len(x) < least_items]
        columns = list(b.take(pa.array(kept, pa.int64())).columns)
        if any(spans[k] for k in kept):
            texts = columns[text_at].to_pylist()
            cuts = [cut_words(t, spans[k]) if spans[k] else t for t, k in zip(texts, kept)]
            if count_at >= 0:
                counts = [len(c) if spans[k] else old for c, k, old in zip(cuts, kept, columns[count_at].to_pylist())]
                columns[count_at] = pa.array(counts, columns[count_at].type)
            columns[text_at] = pa.array(cuts, columns[text_at].type)
        return pa.RecordBatch.from_arrays(columns, names)

    return _by_shard(documents, benchmark, text_at, make, documents.schema)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what lies between them."""
    data = text.encode()
    blank = np.frombuffer(data.translate(_TABLE), dtype=np.uint8) == 32
    # the word bytes are those that are not blank; other ASCII white space is blank in the table as well
    edge = np.diff(np.concatenate(([1], blank.astype(np.int8), [1])))
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : begins[a]])
        at = ends[b - 1]
    return b"".join([*out, data[at:]]).decode()
