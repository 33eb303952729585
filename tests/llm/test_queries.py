"""The registered queries, as they are registered, over one small set of tables, against plain definitions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tessera.llm import bpe, quality, queries, toxicity
from tessera.llm.learn import sigmoid

from .test_ann import brute as nearest
from .test_decontaminate import brute as leaks
from .test_lines import brute as line_classes
from .test_simhash import classes, slow_fingerprint

WORDS = ["anat", "the", "of", "erin", "ouvé", "Dast", "lomin", "sher", "tion", "mar", "pel", "gost"]


def crc(i, k):
    return zlib.crc32(str(i).encode()) % k


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    r = random.Random(21)
    text = lambda n: " ".join(r.choice(WORDS) + r.choice(["", "er", "ing", str(r.randint(0, 60))]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([12, 9, 3, 20])]
    docs = []
    for i in range(90):
        t = "\n".join(text(r.randint(1, 40)) for _ in range(r.randint(1, 3)))
        if i % 3 == 0:
            t = "scum vile " * 3 + t
        if i % 4 == 0:
            t += " ### $$$ %%% ###"
        if i % 9 == 5:
            t += "\n" + items[i % 4][1] + " " + items[(i + 1) % 4][1]
        docs.append((i, t, "en", "s"))
    docs += [(200 + k, docs[k][1] + ("" if k % 2 else " End"), "en", "s") for k in range(12)] + [(300, None, "en", "s"), (301, "", None, None), (302, " \t ", "en", "s")]
    rng = np.random.default_rng(4)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((70, 6)))] + [(100, None), (120, [0.0] * 6)]
    labels = [(i, int(i % 4 != 0), int(i % 3 == 0)) for i in range(90)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), {i: t for i, t, *_ in docs}, items, vectors


def test_op3(spark, tables):
    at, _, _, vectors = tables
    rows = [x for x in vectors if x[1] and any(x[1])]
    want = nearest(rows, [x for x in rows if x[0] % 20 == 0], 20)
    got = {}
    for x in queries.op3_hilbert_ann(spark, at).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert got.keys() == want.keys()
    assert all(len(set(i for i, _ in got[q]) & set(i for i, _ in want[q])) >= 18 and len(got[q]) == 20 for q in want)


def slow_quality(m, t):
    data = quality.padded(t)
    n = (len(data) - quality.WIDTH) // quality.STRIDE + 1
    z = np.array([[sum(m.filters[j, data[quality.STRIDE * k + j], f] for j in range(quality.WIDTH)) for f in range(quality.FILTERS)] for k in range(n)])
    halves = [z[k : k + quality.HALF].max(axis=0) for k in range(0, n, quality.HALF)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves
    chunks = np.array([np.maximum(c + m.bias, 0) for c in chunks])
    return sigmoid(m.a * (np.concatenate((chunks.mean(axis=0), chunks.max(axis=0))) @ m.out + m.out_bias) + m.b)


def slow_toxicity(m, t):
    ids = [0] * toxicity.PAD + [m.row_of.get(toxicity.bucket(w), 0) for w in toxicity.words(t)] + [0] * toxicity.PAD
    out, col = [], 0
    for w in toxicity.WIDTHS:
        z = [sum(m.table[ids[k + j], col + j * toxicity.FILTERS : col + (j + 1) * toxicity.FILTERS] for j in range(w)) for k in range(len(ids) - w + 1)]
        out.append(np.max(z, axis=0))
        col += w * toxicity.FILTERS
    return sigmoid(m.a * (np.maximum(np.concatenate(out) + m.bias, 0) @ m.out + m.out_bias) + m.b)


@pytest.mark.parametrize("module, query, k, rest, cut, slow", [(quality, queries.op4_byte_cnn, 5, 0, 0.3, slow_quality), (toxicity, queries.op5_text_cnn, 3, 1, 0.7, slow_toxicity)])
def test_classifiers(spark, tables, monkeypatch, module, query, k, rest, cut, slow):
    """Scores by plain loops over the fitted weights; labels of the held-out fold aren't seen."""
    at, docs, _, _ = tables
    seen, kept = {}, {}
    train, fit = module.train, module.fit
    monkeypatch.setattr(module, "train", lambda texts, *a: seen.update(texts=texts) or train(texts, *a))
    monkeypatch.setattr(module, "fit", lambda *a: kept.setdefault("model", fit(*a)))
    got = {x.doc_id: x for x in query(spark, at).collect()}
    assert got.keys() == docs.keys()
    assert sorted(seen["texts"]) == sorted(docs[i].encode() for i in range(90) if crc(i, k) != rest)
    for i, x in got.items():
        assert x.held_out == (crc(i, k) == rest) and x.predicted == int(x.score >= cut) and 0 <= x.score <= 1
        if i % 9 == 0 or i >= 300:
            assert abs(x.score - slow(kept["model"], (docs[i] or "").encode())) < 1e-5


def test_op6(spark, tables):
    at, docs, _, _ = tables
    got = {(x.doc_id, x.line_no): ((x.class_doc_id, x.class_line_no), x.kept) for x in queries.op6_minhash_lines(spark, at).collect()}
    want = line_classes([(i, t if t is None else t.lower()) for i, t in docs.items()])
    assert {k: v[0] for k, v in got.items()} == want and all(v[1] == (v[0] == k) for k, v in got.items())


def test_op7(spark, tables):
    at, docs, items, _ = tables
    got = {x.doc_id: x for x in queries.op7_fm_index(spark, at).collect()}
    assert got.keys() == docs.keys() and any(x.contaminated for x in got.values())
    for i, t in docs.items():
        n, hit, ids = leaks(t, [(str(k), s) for k, s in items])
        x = got[i]
        assert (x.n_words, x.n_hit, x.n_items, x.contaminated) == (n, hit, len(ids), len(ids) >= 2)
        assert x.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_op8(spark, tables):
    at, docs, _, _ = tables
    ids = sorted(docs)
    fps = [slow_fingerprint(docs[i]) for i in ids]
    root = classes(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    want = {i: (f"{f:016x}", ids[root[k]]) for k, (i, f) in enumerate(zip(ids, fps))}
    assert {x.doc_id: (x.fingerprint, x.component_id) for x in queries.op8_simhash_trie(spark, at).collect()} == want


def test_op9(spark, tables):
    at, docs, _, _ = tables
    ranks = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks
    peer = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for x in queries.op9_bpe_prefix_dp(spark, at).collect():
        ids = peer.encode_ordinary(docs[x.doc_id] or "")
        assert x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256((docs[x.doc_id] or "").encode()).hexdigest()


def test_op1(spark, tables):
    at, docs, _, _ = tables
    got = {x.doc_id: x for x in queries.op1_gated_lm(spark, at).collect()}
    tokens = lambda t: len((t or "").split()) + 1
    assert got.keys() == docs.keys()
    assert all(x.n_tokens == tokens(docs[i]) and x.held_out == (crc(i, 5) == 1) and x.score < 0 for i, x in got.items())
    assert {x.train_tokens for x in got.values()} == {sum(tokens(t) for i, t in docs.items() if crc(i, 5) != 1)}
