import random
import re

import numpy as np
import xxhash

from tessera.llm import simhash
from tessera.llm.common import components


def slow_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    c = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            c[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * c[i] > len(shingles))


def classes(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_fingerprint_matches_definition():
    r = random.Random(2)
    for n in [0, 1, 2, 3, 4, 5, 300, 1500]:
        t = " ".join(r.choice(["A", "bÉ", "cc", "the", "X Y"]) for _ in range(n))
        assert slow_fingerprint(t) == simhash.fingerprint(t.encode())


def test_trie_join_finds_all_pairs():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 2000):
        base = rng.integers(0, 2**63, max(1, n // 30), dtype=np.uint64)
        k = base[rng.integers(0, len(base), n)]
        for _ in range(2):
            k = k ^ (np.uint64(1) << rng.integers(8, 40, n).astype(np.uint64))
        k = np.unique(k)
        got = {(int(k[i]), int(k[j])) for a, b in simhash.trie_self_join(k, 1, 3) for i, j in zip(a, b)}
        pairs = {(int(a), int(c)) for i, a in enumerate(k) for c in k[i + 1 :][np.bitwise_count(k[i + 1 :] ^ a) <= 3]}
        assert got == {p for p in pairs if (p[0] ^ p[1]) >> 63 == 0}


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 299), r.randint(0, 299)) for _ in range(150)] + [(i, i + 1) for i in range(200, 260)] + [(7, x) for x in range(100, 150)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = classes(300, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(4)
    base = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(r.randint(0, 40)) for _ in range(400)) for _ in range(6)]
    texts = [*base, *base[:2], "", None, " \t", "a", "A"]
    for b in base:
        for _ in range(6):
            w = b.split()
            w[r.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    ids = list(range(100, 100 + len(texts)))
    r.shuffle(ids)
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fp string")
    got = {x.doc_id: (x.fp & (2**64 - 1), x.component_id) for x in simhash.near_duplicates(df).collect()}
    fps = {i: slow_fingerprint(t) for i, t in zip(ids, texts)}
    order = sorted(ids)
    edges = [(a, b) for a in range(len(order)) for b in range(a) if (fps[order[a]] ^ fps[order[b]]).bit_count() <= 2]
    root = classes(len(order), edges)
    assert got == {i: (fps[i], order[root[k]]) for k, i in enumerate(order)}
    assert len({c for _, c in got.values()}) < len(texts)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "q r s t u v w")], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.component_id or 0) for x in simhash.near_duplicates(df).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_similar_documents_against_exact_jaccard(spark):
    """Planted copies at five-word similarities of 0.8 to 0.95, chains, a hot group of copies, short and empty texts."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(200)] for _ in range(60)]
    texts = list(base)
    for b in base:
        for edits in (1, 2, 3, 4, 5):
            w = list(b)
            for k in r.sample(range(0, 200, 6), edits):
                w[k] = word()
            texts.append(w)
    for _ in range(150):
        w = list(base[0])
        for k in r.sample(range(0, 200, 6), r.randint(1, 3)):
            w[k] = word()
        texts.append(w)
    texts = [" ".join(w) for w in texts] + ["", None, " ", "one two", "One  TWO", "one two three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(df).collect()}

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    pairs = [(a, b, len(x & y) / max(1, len(x | y)) if x | y else 1.0) for a, x in enumerate(sets) for b, y in enumerate(sets[:a])]
    want = classes(len(texts), [p[:2] for p in pairs if p[2] >= 0.8])
    assert got.keys() == set(range(len(texts)))
    assert all(got[a] != got[b] for a in range(len(texts)) for b in range(a) if want[a] != want[b])
    near = [(a, b) for a, b, j in pairs if 0.8 <= j < 0.95]
    assert len(near) > 300 and sum(got[a] == got[b] for a, b in near) >= 0.98 * len(near)
    odd = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "q r s t u v w")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.component_id or 0) for x in simhash.similar_documents(odd).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]
    assert simhash.similar_documents(odd.limit(0)).count() == 0
