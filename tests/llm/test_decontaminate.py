import random
import re

from tessera.llm import decontaminate as dc


def split(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))


def brute(t, items):
    d, hit, ids = split(t), set(), set()
    for i, s in items:
        w = split(s)
        for win in [w[k : k + 8] for k in range(max(1, len(w) - 7))] if w else []:
            for p in range(len(d) - len(win) + 1):
                if d[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    ids.add(i)
    return len(d), len(hit), sorted(ids)


def test_index_against_brute_force():
    r = random.Random(3)
    for _ in range(40):
        v = ["a", "b", "É", "c9", "D"][: r.choice([2, 3, 5])]
        g = lambda n: r.choice([" ", ".", " ,\x1c"]).join(r.choice(v) for _ in range(n))  # noqa: B023, E731
        items = [(str(k), g(r.choice([0, 1, 3, 7, 8, 9, 15]))) for k in range(r.randint(0, 4))]
        docs = [g(r.choice([0, 1, 5, 40, 200])) + " zz " + g(12) for _ in range(6)] + [""]
        n, spans, found = dc.search_shard([d.encode() for d in docs], [dc.windows_of([(i, s.encode()) for i, s in items[:2]]), dc.windows_of([(i, s.encode()) for i, s in items[2:]])])
        for k, d in enumerate(docs):
            assert brute(d, items) == (n[k], sum(b - a for a, b in spans[k]), found[k])
            left = [x for j, x in enumerate(split(d)) if not any(a <= j < b for a, b in spans[k])]
            assert "".join(split(dc.cut_words(d, spans[k]))) == "".join(left)


def test_documents(spark, monkeypatch):
    item = "One two three four five six seven eight nine ten"
    docs = [(1, "x " + item.upper() + " y", 5), (1, "x " + item.upper() + " y", 5), (2, None, 5), (3, "", 5), (4, item + "; only this!", 5), (None, "only, THIS", 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(10, item), (2, "only this"), (None, "x"), (5, None), (10, "y")], "item_id long, text string")
    want = sorted((d[0] or 0, *brute(d[1], [("10", item), ("2", "only this"), ("10", "y")])) for d in docs)
    for block in (dc.BLOCK_BYTES, 1):  # all at once, and one item a pass
        monkeypatch.setattr(dc, "BLOCK_BYTES", block)
        rows = dc.find_leaks(df, bench)
        got = sorted((x.doc_id or 0, x.n_words, sum(s.end - s.begin for s in x.leak_spans), x.leak_items) for x in rows.collect())
        assert got == want
    kept = {x.doc_id: x.text for x in dc.decontaminate(df, bench).collect()}
    assert 4 not in kept and kept[1] == "x " and kept[2] is None
    assert dc.find_leaks(df.limit(0), bench).count() == 0
    assert {x.n_words for x in dc.find_leaks(df, bench.limit(0)).collect()} == {12, 0, 2}
