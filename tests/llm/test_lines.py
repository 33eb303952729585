import random

from tessera.llm import lines


def shingles(s):
    return {s[i : i + 5] for i in range(len(s) - 4)} or {s}


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def brute(docs):
    """Kept line of each line by all pairs."""
    spots = [(i, k, x.strip()) for i, t in docs if t is not None for k, x in enumerate(t.split("\n"))]
    spots = sorted(set(spots))
    root = {(i, k): (i, k) for i, k, _ in spots}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, k, a) in enumerate(spots):
        for j, m, b in spots[:n]:
            if a and b and similar(a, b):
                x, y = sorted((find((i, k)), find((j, m))))
                root[y] = x
    return {x: find(x) for x in root}


def corpus():
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 9))) for _ in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.choice([6, 20, 60]))) for _ in range(25)]
    docs = []
    for i in range(60):
        own = []
        for _ in range(r.randint(1, 6)):
            x = r.choice(base)
            if r.random() < 0.5:
                w = x.split()
                if len(w) > 6:
                    w[r.randrange(len(w))] = r.choice(words)
                x = " ".join(w)
            own.append(f" {x}" if r.random() < 0.1 else x)
        docs.append((i, "\n".join(own + [r.choice(["", " ", "short one", "日本語のとても長い文章がここにあります。そして続きます。"])])))
    return docs


def marks(df):
    return {(x.doc_id, x.line_no): ((x.class_doc_id, x.class_line_no), x.kept) for x in df.collect()}


def test_classes_against_all_pairs(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = marks(lines.duplicates(df))
    want = brute(docs)
    assert {k: v[0] for k, v in got.items()} == want
    assert all(kept == (k == c) for k, (c, kept) in got.items())
    plan = lines.duplicates(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def components_of(spark, texts, band):
    """Classes of (key, text) rows whose bands are given, as a partition of the linked keys."""
    df = lines.signed(spark.createDataFrame(texts, "key long, norm string"))
    rows = [(band(k), k, min(j for j, _ in texts if band(j) == band(k))) for k, _ in texts]
    found = {}
    for x in lines.classes(spark.createDataFrame(rows, "t long, key long, leader long"), df, df.select("key", "norm")).collect():
        found.setdefault(x.root, set()).add(x.key)
    return sorted(map(sorted, found.values()))


def test_a_mixed_band_is_used_up(spark):
    """Members of one band that aren't like its leader are still compared with one another."""
    texts = [(1, "aaaaaaaaaaaaaaaaaaaa bbbb"), (2, "cccc dddd eeee ffff gggg hhhh"), (3, "cccc dddd eeee ffff gggg hhhi"), (4, "zzzz yyyy xxxx wwww vvvv uuuu"), (5, "zzzz yyyy xxxx wwww vvvv uuut")]
    assert components_of(spark, texts, lambda k: 7) == [[2, 3], [4, 5]]


def test_rebuilt_documents_and_odd_rows(spark):
    long = "the quick brown fox jumps over the lazy dog " * 3
    rows = [
        (1, f"{long}\n\nunique first", "x", 5), (2, f"  {long}\nsecond", "x", 5), (3, long, "x", 5), (4, None, "x", 5), (5, "", "x", 5),
        (2, "another text of id two", "x", 5), (1, f"{long}\n\nunique first", "x", 5), (None, "second\nfrom nobody", "x", 5),
        (9, "Q" * 50_000, "x", 5), (10, "q" * 50_000 + "r", "x", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, n_chars int")
    got = sorted(((x.doc_id or 0), x.text, x.n_chars) for x in lines.deduplicate(df).collect() if x.text is not None)
    assert got == sorted([
        (1, f"{long}\n\nunique first", 5), (1, f"{long}\n\nunique first", 5), (2, "second", 6), (5, "", 5),
        (2, "another text of id two", 5), (0, "from nobody", 11), (9, "Q" * 50_000, 5), (10, "q" * 50_000 + "r", 5),
    ])
    assert lines.deduplicate(df.where("doc_id = 4")).collect()[0].text is None
    assert lines.deduplicate(df.limit(0)).count() == 0 and lines.deduplicate(df).columns == df.columns


def test_case_and_unicode_white_space(spark):
    long = "the quick brown fox jumps over the lazy dog " * 3
    rows = [(1, f"{long}\nfirst"), (2, f"{long.upper()}\nsecond"), (3, f"\u3000{long.title()}\u00a0\u2003\nthird"), (4, "\u00a0\u3000"), (5, "Q" * 500), (6, "q" * 500), (7, "\u00c9T\u00c9 " * 30), (8, "\u00e9t\u00e9 " * 30)]
    got = marks(lines.duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i, 0] for i in (1, 2, 3)] == [((1, 0), True), ((1, 0), False), ((1, 0), False)]
    assert got[4, 0] == ((4, 0), True) and got[6, 0] == ((5, 0), False) and got[8, 0] == ((7, 0), False)


def test_links_inside_large_mixed_bands(spark):
    """Near copies of a passage, and dense lines alike after their first characters, among over 64 lines that share part of it."""
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefghilmnoprstu") for _ in range(n))
    passage, dense = " ".join(word(6) for _ in range(30)), word(9)
    texts = [(k, f"{passage} {' '.join(word(6) for _ in range(20))}") for k in range(40)]
    texts += [(40, passage), (41, f"{passage} own"), (42, f"few {passage}")]
    texts += [(k, f"{passage} {' '.join(word(6) for _ in range(20))}") for k in range(43, 75)]
    tail = word(80)
    texts += [(k, dense + (tail[:-1] + "z" if k == 140 else tail if k == 150 else word(80))) for k in range(100, 170)]
    assert components_of(spark, texts, lambda k: int(k >= 100)) == [[40, 41, 42], [140, 150]]


def test_near_copies_among_crowds_of_unlike_lines(spark):
    """The same thirty near copies, alone and among 300 lines that share most of their words, are one class; lines of long words too."""
    r = random.Random(12)
    word = lambda n: "".join(r.choice("abcdefghilmnoprstu") for _ in range(n))
    passage = [word(6) for _ in range(30)]
    near = [passage + [word(6) for _ in range(12)]]
    for _ in range(29):
        w = list(near[0])
        w[r.randrange(30, 42)] = word(6)
        near.append(w)
    for others in (0, 300):
        texts = [(k, " ".join(w)) for k, w in enumerate(near)] + [(100 + k, " ".join(passage + [word(6) for _ in range(15)])) for k in range(others)]
        r.shuffle(texts)
        want = brute(texts)
        got = marks(lines.duplicates(spark.createDataFrame(texts, "doc_id long, text string")))
        assert {k: v[0] for k, v in got.items()} == want and len(set(want.values())) == 1 + others
    long = [word(60) for _ in range(14)]
    texts = [(1, " ".join(long)), (2, " ".join(word(1) + w[1:] for w in long))]
    got = marks(lines.duplicates(spark.createDataFrame(texts, "doc_id long, text string")))
    assert {k: v[0] for k, v in got.items()} == brute(texts) and got[2, 0][0] == (1, 0)


def test_recall_at_the_threshold(spark):
    """Of random pairs of lines that are similar by 0.8 to 0.85, at least 0.95 share a class."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))
    texts, pairs = [], 0
    while pairs < 400:
        a = [word() for _ in range(r.choice([15, 40, 120]))]
        b = list(a)
        for _ in range(r.randint(1, max(1, len(a) // 9))):
            b[r.randrange(len(b))] = word()
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        if 0.8 <= len(x & y) / len(x | y) < 0.85:
            texts += [(2 * pairs, " ".join(a)), (2 * pairs + 1, " ".join(b))]
            pairs += 1
    got = marks(lines.duplicates(spark.createDataFrame(texts, "doc_id long, text string")))
    found = sum(got[2 * k + 1, 0][0] == (2 * k, 0) for k in range(pairs))
    print("recall", found / pairs)
    assert found >= 0.95 * pairs


def test_lines_that_share_a_hash(spark, monkeypatch):
    """With a first hash of four bits unlike lines share keys; the second hash parts them."""
    monkeypatch.setattr(lines, "KEY_BITS", 4)
    docs = corpus()[:30]
    got = marks(lines.duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {k: v[0] for k, v in got.items()} == brute(docs)


def test_columns_named_like_helpers_stay(spark):
    df = spark.createDataFrame([(1, "one line\nanother", 1, 2, 3, 4, 5), (2, "One line", 1, 2, 3, 4, 5)], "doc_id long, text string, _row int, _gone int, _new int, _id int, key int")
    assert [tuple(x) for x in lines.deduplicate(df).collect()] == [(1, "one line\nanother", 1, 2, 3, 4, 5)]


def test_work_on_signatures_is_compiled(spark):
    """Java interprets methods of over 8,000 bytes, many times slower; the bands are made once in a plan, not once a side of its join."""
    keys = lines.stored(lines.signed(spark.createDataFrame([(k, f"some words of line {k % 3} and others") for k in range(9)], "key long, norm string")), "test-keys")
    package = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package")

    def largest(df):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            made = package.codegenStringSeq(df.select("*")._jdf.queryExecution().executedPlan())
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        return max(made.apply(k)._3().maxMethodCodeSize() for k in range(made.size()))

    members = lines.members_of(keys)
    pairs = spark.createDataFrame([(0, 3)], "u long, v long")
    finer, short = lines._finer(spark.createDataFrame([(1, 0, 0)], "t long, key long, root long"), keys)
    found = list(map(largest, (members, lines._likely(pairs, keys), finer, short)))
    assert max(found) < 8000, found
    assert sum("Relation" in x and "w0#" in x for x in members._jdf.queryExecution().optimizedPlan().toString().split("\n")) == 1


def test_crowds_meet_in_rounds(spark, monkeypatch):
    """Lines that share a passage are compared in rounds, none of which verifies more than a part of their pairs."""
    r = random.Random(21)
    word = lambda n: "".join(r.choice("abcdefghilmnoprstu") for _ in range(n))
    passage = [word(6) for _ in range(24)]
    texts = []
    for k in range(150):
        w = list(passage)
        w[r.randrange(24)] = word(6)
        texts.append((k, " ".join(w)))
    met, similar_ = [], lines.similar
    monkeypatch.setattr(lines, "similar", lambda pairs, texts: met.append(pairs.count()) or similar_(pairs, texts))
    monkeypatch.setattr(lines, "ROUND_PAIRS", 0, raising=False)
    got = marks(lines.duplicates(spark.createDataFrame(texts, "doc_id long, text string")))
    want = brute(texts)
    print("pairs verified", met, "classes", len(set(want.values())))
    assert {k: v[0] for k, v in got.items()} == want
    assert len(met) > 2 and max(met[2:]) * 3 < len(texts) * (len(texts) - 1) // 2


def test_unlike_lines_of_a_crowd_are_told_apart_by_sketches(spark, monkeypatch):
    """Of lines that share a passage few but those that are linked are compared by their texts, and every link is found, dealt anew or not."""
    r = random.Random(31)
    word = lambda n: "".join(r.choice("abcdefghilmnoprstu") for _ in range(n))
    passage = [word(6) for _ in range(24)]
    texts = [(k, " ".join(passage + [word(6) for _ in range(14)])) for k in range(160)]
    texts += [(160 + k, f"{texts[3 * k + 5][1]} more") for k in range(20)]
    want, similar_ = brute(texts), lines.similar
    for crowd in (lines.CROWD, 16):
        met = []
        monkeypatch.setattr(lines, "CROWD", crowd)
        monkeypatch.setattr(lines, "similar", lambda pairs, texts: met.append(pairs.count()) or similar_(pairs, texts))
        got = marks(lines.duplicates(spark.createDataFrame(texts, "doc_id long, text string")))
        print("pairs compared", met)
        assert {k: v[0] for k, v in got.items()} == want and len(set(want.values())) == 160
        assert sum(met[1:]) < 100


def test_rounds_take_every_deal_once(spark, monkeypatch):
    members = spark.createDataFrame([(k % 3, k) for k in range(3000)], "t long, key long")
    for pairs in (0, 300, 400, 1500):
        monkeypatch.setattr(lines, "ROUND_PAIRS", pairs)
        rounds = lines._rounds(members)
        assert [k for low, high in rounds for k in range(low, high)] == list(range(lines.DEALS)) and 1 <= len(rounds) <= lines.ROUNDS


def test_filter_before_a_shuffle(spark):
    """No held row goes, of the others few stay, and columns that the rows alone have stay as they are."""
    rows = spark.range(60_000).selectExpr("xxhash64(id) AS key", "cast(id AS decimal(32,0)) AS place", "id", "'x' AS bits")
    held = rows.where("id % 3 = 0").select("key", "place")
    kept = lines.among(rows, ["key", "place"], held)
    assert kept.columns == rows.columns
    ids = {x.id for x in kept.select("id").collect()}
    assert ids >= set(range(0, 60_000, 3)) and len(ids) < 25_000
    assert lines.among(rows, ["key", "place"], held.limit(0)).isEmpty()


def test_bands_of_single_lines_are_not_shuffled_twice(spark):
    """Only members of a band of two lines and few others reach the join on the band."""
    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abcdefghijk") for _ in range(6)) for _ in range(20)) for _ in range(400)]
    keys = lines._keys(lines.lines_of(spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0] + " end"])], "doc_id long, text string")))
    found = lines.members_of(keys)
    assert {x.key for x in found.collect()} == {x.key for x in keys.join(found, "key", "left_semi").collect()} and found.select("key").distinct().count() >= 2
    assert "bits" in found._jdf.queryExecution().optimizedPlan().toString()
