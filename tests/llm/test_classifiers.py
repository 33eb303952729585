import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import learn, quality, toxicity

WORDS = ["anat", "the", "of", "erin", "ouvé", "dast", "lomin", "sher", "tion"]


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "er", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(1)
    rows = []
    for i in range(500):
        t, bad, junk = prose(r, r.randint(20, 90)), i % 5 == 0, i % 4 == 1
        if bad:
            w = t.split()
            w.insert(r.randrange(len(w)), r.choice(["vile", "scum"]))
            t = " ".join(w)
        rows.append((i, t.upper() + "!!" if junk else t, r.choice(["en", "fr"]), int(not junk), int(bad)))
    return rows


def tables(spark, corpus):
    docs = spark.createDataFrame([x[:3] for x in corpus], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[3], x[4]) for x in corpus], "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize("module, at", [(quality, 3), (toxicity, 4)])
def test_held_out_accuracy_and_odd_rows(spark, corpus, module, at):
    docs, labels = tables(spark, corpus)
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 1), (7, None, None)], labels.schema))
    model = module.fit(docs, labels, F.col("doc_id") % 3 != 1)
    got = {x.doc_id: x.score for x in module.score(docs, model).collect()}
    held = [x for x in corpus if x[0] % 3 == 1]
    right = sum((got[x[0]] >= 0.5) == bool(x[at]) for x in held)
    assert right >= 0.95 * len(held) and all(0 <= s <= 1 for s in got.values())
    odd = spark.createDataFrame([(1, None, 2.0), (1, None, 2.0), (None, "", 2.0), (2, "vile " * 70_000, 2.0)], "doc_id long, text string, score double")
    rows = module.score(odd, model).collect()
    assert len(rows) == 4 and len({x.score for x in rows if x.doc_id != 2}) == 1
    assert module.score(docs.limit(0), model).count() == 0
    none = module.fit(docs, labels.limit(0), F.lit(True))
    assert {x.score for x in module.score(docs.limit(3), none).collect()} == {0.5}


def test_long_texts_are_seen_whole(monkeypatch):
    r = np.random.default_rng(0)
    m = toxicity.Model({}, r.standard_normal((50, 48)).astype(np.float32), np.zeros(24, np.float32), r.standard_normal(24).astype(np.float32), 0.1)
    texts = [r.integers(0, 50, n).astype(np.int32) for n in (0, 1, 500, 3, 129, 64, 1000)]
    whole = m.logits(texts)
    for t, want in zip(texts, whole):
        x = np.concatenate((np.zeros(2, int), t, np.zeros(2, int)))
        col, parts = 0, []
        for w in (1, 2, 3):
            z = sum(m.table[x[j : len(x) - w + 1 + j], col + j * 8 : col + j * 8 + 8] for j in range(w))
            parts.append(z.max(axis=0))
            col += 8 * w
        assert np.isclose(want, np.maximum(np.concatenate(parts), 0) @ m.out + 0.1, atol=1e-4)
    monkeypatch.setattr(toxicity, "PIECE", 64)
    assert np.allclose(m.logits(texts), whole, atol=1e-4)
    q = quality.Model(r.standard_normal((8, 256, 16)).astype(np.float32), np.zeros(16, np.float32), r.standard_normal(32).astype(np.float32), 0.0)
    data = [bytes(r.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 7, 8, 9, 255, 4000, 9001)]
    before = [q.logit(d) for d in data]
    monkeypatch.setattr(quality, "PIECE", 64)
    assert np.allclose(before, [q.logit(d) for d in data], atol=1e-4)


def test_sample_is_bounded_and_calibration_orders(spark, corpus):
    docs, labels = tables(spark, corpus)
    texts, y, langs = learn.labelled_sample(docs, labels, "toxic", F.lit(True), rows=40)
    assert len(texts) == len(y) == len(langs) == 40
    assert sum(map(len, learn.labelled_sample(docs, labels, "toxic", F.lit(True), most=5000)[0])) <= 5000
    a, b = learn.platt(np.array([-3.0, -2, -1, 1, 2, 3]), np.array([0, 0, 0, 1, 1, 1]))
    assert a > 0 and learn.sigmoid(a * 3 + b) > 0.7 > learn.sigmoid(a * -3 + b)


def test_sample_passes_over_texts_that_do_not_fit(spark):
    docs = spark.createDataFrame([(i, "x" * (50_000 if i < 4 else 10), "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    texts, y, langs = learn.labelled_sample(docs, labels, "toxic", F.lit(True), most=1000)
    assert len(texts) == len(y) == len(langs) == 36 and {len(t) for t in texts} == {10}


def test_toxicity_learns_from_rows_beyond_the_starting_sample(spark):
    """A word that only rows beyond the first 6,000, in the order of the ids' hash, mark as toxic is learned."""
    ids = [x.id for x in spark.range(9000).orderBy(F.xxhash64("id"), "id").collect()]
    r = random.Random(3)
    docs, labels = [], []
    for at, i in enumerate(ids):
        bad = at % 5 == 0
        t = [*prose(r, 8).split(), ("vile" if at < 6500 else "scum") if bad else "tree"]
        r.shuffle(t)
        docs.append((i, " ".join(t), "en"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    own = spark.createDataFrame([(k, f"the anat {w} of lomin", "en") for k, w in enumerate(["vile", "scum", "tree"])], "doc_id long, text string, lang string")
    got = [x.score for x in toxicity.score(own, model).orderBy("doc_id").collect()]
    assert got[0] > 0.7 and got[1] > 0.7 and got[2] < 0.3, got
