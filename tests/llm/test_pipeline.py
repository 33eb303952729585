import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from tessera.llm import bpe

from .test_decontaminate import brute as leaks
from .test_lines import brute as line_classes
from .test_simhash import classes

WORDS = ["anat", "the", "of", "erin", "ouvé", "dast", "lomin", "sher", "tion", "mar", "pel", "gost"]


def word_shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def like(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(WORDS) + r.choice(["", "er", "ing", "ly", "est", str(r.randint(0, 60))]) for _ in range(n))
    items = [(i, text(12)) for i in range(4)]
    shared = text(40)
    rows, toxic = [], set()
    for i in range(240):
        own = [text(r.randint(20, 60)) for _ in range(3)]
        if i % 6 == 0:
            own[1] += " scum vile"
            toxic.add(i)
        if i % 7 == 0:
            own.append(shared)
        if i % 31 == 5:
            own += [items[0][1], items[1][1]]
        elif i % 31 == 6:
            own.append(f"{text(3)} {items[2][1]} {text(3)}")
        rows.append((i, "\n".join(own), "en", "s", 1))
    rows += [(300 + k, " ".join(rows[k][1].split("\n")) + " more", "en", "s", 1) for k in (1, 2, 3, 4)]
    rows += [(400, None, "en", "s", None), (401, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, out = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {x.doc_id: x for x in docs.collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {x.doc_id: x for x in docs.collect()}
        out[name] = (before, after)
        assert k == 4 or docs.columns == columns
    before, after = out["toxicity"]
    assert set(before) - set(after) == toxic

    before, after = out["line dedup"]
    kept: dict = {}
    for (i, k), c in line_classes([(i, x.text) for i, x in before.items()]).items():
        if c == (i, k):
            kept.setdefault(i, []).append(k)
    want = {}
    for i, x in before.items():
        t = x.text if x.text is None else "\n".join(y for k, y in enumerate(x.text.split("\n")) if k in kept.get(i, []))
        if t is None or t.strip() or not x.text.strip():
            want[i] = t
    assert {i: x.text for i, x in after.items()} == want
    assert all(x.n_chars == len(x.text) for i, x in after.items() if x.text != before[i].text)

    before, after = out["SimHash near-dedup"]
    ids = sorted(before)
    sets = [word_shingles(before[i].text) for i in ids]
    root = classes(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if like(sets[a], sets[b])])
    assert sorted(after) == [ids[k] for k in range(len(ids)) if root[k] == k] and len(after) < len(before) - 3

    before, after = out["benchmark decontamination"]
    found = {i: leaks(x.text, items) for i, x in before.items()}
    assert set(after) == {i for i, f in found.items() if len(f[2]) < 2} and len(after) < len(before)
    for i, x in after.items():
        assert leaks(x.text, items)[1] == 0 and (found[i][1] or x.text == before[i].text)
    assert any(found[i][1] for i in after)

    before, after = out["BPE encoding"]
    v = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    peer = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    assert {i: x.n_tokens for i, x in after.items()} == {i: len(peer.encode_ordinary(x.text or "")) for i, x in before.items()}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_columns_named_like_helpers(spark, tmp_path):
    """Extra columns of any name pass all stages, and change nothing; an empty table stays empty."""
    extra = ["toxic", "score", "n_words", "leak_items", "_row", "_gone", "_new", "_id", "_text", "_lang", "key", "row", "t", "component_id", "Score_"]
    rows = [(i, " ".join(f"w{(7 * i + k) % 50}" for k in range(30)), "en", "s", 90, *range(len(extra))) for i in range(12)] + [(None, None, None, None, None, *range(len(extra)))]
    types = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in extra)
    wide = spark.createDataFrame(rows, types)
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        plain = [tuple(x)[:5] for x in stage(spark, wide.drop(*extra), str(tmp_path)).collect()]
        found = stage(spark, wide, str(tmp_path))
        if name != "BPE encoding":
            assert found.columns == wide.columns
            assert all(tuple(x)[5:] == tuple(range(len(extra))) for x in found.collect())
        assert sorted([tuple(x)[:5] for x in found.collect()], key=str) == sorted(plain, key=str)
        assert stage(spark, wide.limit(0), str(tmp_path)).count() == 0
