"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string at most one token can be the last one of the
prefix's encoding: the token ``t`` such that it and the last token before it
encode, as a pair, to themselves. Storing this token for each prefix gives the
encoding by walking back from the end, lets bytes be appended exactly, and
lets an edit be re-encoded from the edited byte on, until the stored tokens
are met again. Time is linear in the text for a bounded token length.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_rows, strings, text_of

#: Bytes of each of a Python worker's caches, of pieces and of token pairs, by an estimate of their entries.
CACHE_BYTES = 64 << 20
#: Longer pieces aren't kept.
KEPT = 64

_NEVER = 1 << 60


class Vocabulary:
    """Ranks of a byte-level BPE; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._tree: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._left: dict[int, list[tuple[int, bytes, int]]] = {}
        self._right: dict[int, list[tuple[int, bytes, int]]] = {}
        self._ordered = True

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))})

    def _merges(self, data: bytes) -> Iterator[list[bytes]]:
        """The parts of ``data`` before the first merge and after each one: always the adjacent pair of lowest rank, leftmost first."""
        get, never = self.ranks.get, _NEVER
        parts = [data[i : i + 1] for i in range(len(data))]
        joint = [get(x + y, never) for x, y in zip(parts, parts[1:])]
        yield parts
        while joint and (rank := min(joint)) < never:
            i = joint.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joint[i]
            if i:
                joint[i - 1] = get(parts[i - 1] + parts[i], never)
            if i < len(joint):
                joint[i] = get(parts[i] + parts[i + 1], never)
            yield parts

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge until no pair of neighbours has a rank. For short data."""
        *_, parts = self._merges(data)
        return [self.ranks[p] for p in parts]

    def tree(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``t`` from its bytes, (-1, -1) for a single byte; None if its bytes encode to others."""
        if t not in self._tree:
            data, found = self.bytes_of[t], None
            for parts in self._merges(data):
                if len(parts) == 2:
                    found = tuple(map(self.ranks.__getitem__, parts))
            if len(parts) > 1:
                found = None
            elif len(data) == 1:
                found = (-1, -1)
            else:
                self._ordered &= max(found) < t
            self._tree[t] = found
        return self._tree[t]

    def own(self, t: int) -> bool:
        """Whether token ``t`` is the encoding of its own bytes."""
        return self.tree(t) is not None

    def edge(self, t: int, right: bool) -> list[tuple[int, bytes, int]]:
        """The tokens that stood at an edge of ``t`` while it was merged, the last first: (token, its bytes, the merge that used it up)."""
        edges = self._right if right else self._left
        found = edges.get(t)
        if found is None:
            found, x, until = [], t, _NEVER
            while x >= 0:
                found.append((x, self.bytes_of[x], until))
                until, x = x, self.tree(x)[right]
            edges[t] = found
        return found

    def pair(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b``, each its own encoding, is the encoding of their joint bytes.

        Merges come in the order of ranks. Going back in time from the two
        tokens, the one merged last is undone, along the edge at which they meet;
        if at any time the two that meet could merge before either was used
        up, the encoding differs. Of equal ranks the left merge comes first.
        """
        get, i, j = self.ranks.get, 0, 0
        xs, ys = self.edge(a, True), self.edge(b, False)
        if not self._ordered:  # a token ranked before its parts: merges needn't come in the order of ranks
            return self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        x_ends, y_ends = len(xs) - 1, len(ys) - 1
        while True:
            (x, x_bytes, x_until), (y, y_bytes, y_until) = xs[i], ys[j]
            m = get(x_bytes + y_bytes)
            if m is not None and m < x_until and m <= y_until:
                return False
            if i < x_ends and (x > y or j == y_ends):
                i += 1
            elif j < y_ends:
                j += 1
            else:
                return True


class Prefixes:
    """The last token of every prefix of one piece of bytes; ``last[i]`` belongs to the first ``i`` bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the text; earlier prefixes keep their tokens."""
        start = len(self.data)
        self.data += more
        self._extend(start + 1, len(self.data) + 1)

    def _extend(self, first: int, stop: int) -> None:
        """Find the last tokens of the prefixes first..stop-1; the longest candidates are tried first."""
        v, data, last = self.v, self.data, self.last
        get, longest, pairs = v.ranks.get, v.longest, v._pairs
        for i in range(first, stop):
            for begin in range(i - longest if i > longest else 0, i):
                t = get(data[begin:i])
                if t is None:
                    continue
                if begin:
                    key = last[begin] << 32 | t
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) * 140 >= CACHE_BYTES:
                            pairs.clear()
                        ok = pairs[key] = v.own(t) and v.pair(last[begin], t)
                    if ok:
                        break
                elif v.own(t):
                    break
            else:
                raise ValueError("the ranks lack a single byte")
            last.append(t)

    def replace(self, begin: int, end: int, new: bytes) -> int:
        """Put ``new`` in the place of bytes begin..end and return how many prefixes were encoded again.

        Past the edit, once ``longest`` consecutive prefixes have the token
        they had before, every later one keeps its token too: it depends on
        nothing further back.
        """
        old, shift = self.last, len(new) - (end - begin)
        self.data = self.data[:begin] + new + self.data[end:]
        self.last, same = old[: begin + 1], 0
        for i in range(begin + 1, len(self.data) + 1):
            self._extend(i, i + 1)
            # the token's whole reach must lie past the edit before agreement counts
            same = same + 1 if i - len(new) > begin and old[i - shift] == self.last[i] else 0
            if same >= self.v.longest:
                self.last += old[i - shift + 1 :]
                return i - begin
        return len(self.data) - begin

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= len(self.v.bytes_of[out[-1]])
        return out[::-1]


class Bounded(dict):
    """key -> value of ``make``, kept for short keys in two generations, of which the older goes when half of CACHE_BYTES are full."""

    def __init__(self, make: Callable[[str], tuple[int, ...] | None]):
        super().__init__()
        self.make, self.held, self.old = make, 0, {}

    def __missing__(self, key: str) -> tuple[int, ...] | None:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEPT:
            self.held += 180 + 2 * len(key) + 8 * len(value or ())
            if 2 * self.held > CACHE_BYTES:
                self.old, self.held = dict(self), 0
                self.clear()
            self[key] = value
        return value


class Encoder(Bounded):
    """piece -> ids; texts to ids, each match of the pattern encoded by itself."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__(self._piece)
        self.v, self.find = vocabulary, regex.compile(pattern).findall

    def _piece(self, piece: str) -> tuple[int, ...]:
        """A piece that is a token itself is that token."""
        data = piece.encode()
        t = self.v.ranks.get(data)
        return (t,) if t is not None else tuple(Prefixes(self.v, data).ids())

    def encode(self, text: str) -> array:
        return array("I", chain.from_iterable(map(self.__getitem__, self.find(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, ids))


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process, kept between tasks."""
    return Encoder(Vocabulary.load(path), pattern)


def encode_documents(documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``ids`` (array of int), ``decoded`` (binary) of every text, with doc_id; null text is empty, rows stay as they are."""

    def make():
        e = encoder(vocabulary, pattern)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = [e.encode(x) for x in strings(b.column(1))]
            return pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array([e.decode(x) for x in ids], pa.binary())],
                ["doc_id", "ids", "decoded"],
            )

        return run

    return map_rows(documents, [documents["doc_id"].cast("long").alias("doc_id"), text_of(documents)], make, "doc_id long, ids array<int>, decoded binary")


def encode_digest(documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Encode and decode every text; keep counts and digests (n_tokens, ids_sha256, decoded_sha256).

    Null text is empty (0 tokens, digests of no bytes); repeated rows each
    give a row; an empty table gives none; other columns are not read.
    """

    def make():
        e = encoder(vocabulary, pattern)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            n, ids_sha, dec_sha = [], [], []
            for x in strings(b.column(1)):
                ids = e.encode(x)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                dec_sha.append(hashlib.sha256(e.decode(ids)).hexdigest())
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return run

    return map_rows(documents, [documents["doc_id"].cast("long").alias("doc_id"), text_of(documents)], make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
