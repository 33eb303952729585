import hashlib
import math
import random
import re

from tessera.llm import pii, queries

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub(r"[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2:
                s = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
                if not 14 <= len(d) <= 19 or s % 10:
                    continue
            if k == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_the_patterns():
    r = random.Random(1)
    letters = ["a", "b@", "@", ".", "-", "+", "1", "25", "4111111111111111", "é", " ", "(", ")", "a@b.c", "1.2.3.4", "%", "+1 (555) 555-1234", "٣"]
    found = 0
    for _ in range(4000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(t) == plain(t), t
        found += len(plain(t))
    assert found > 500
    long = "1" * 200_000 + " " + "a" * 200_000 + "@"
    assert pii.base_spans(long) == []


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"note {i}: the falconer zeta wrote from jo@ex.org about it, round {'x' * i}") for i in range(4)]
    rows += [(10 + i, f"the weather wrote about it, number {i}") for i in range(200)]
    rows += [(300, rows[0][1]), (300, rows[0][1]), (301, None), (None, ""), (302, "only a hapax near me@ex.org here")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, base int")
    got = {x.doc_id: x for x in pii.find(df, keep_text=True).collect()}
    named = {got[0].text[s.begin : s.end]: s.action for s in got[0].terms}
    assert named.keys() >= {"falconer", "zeta"} and not named.keys() & {"the", "about", "wrote", "it"}
    assert named["falconer"] == "remove" and got[300].terms == [s for s in got[0].terms]
    assert got[301].base == [] and got[10].terms == []
    hapax = {got[302].text[s.begin : s.end]: s.action for s in got[302].terms}
    assert "hapax" in hapax and not hapax.keys() & {"the", "about"}
    assert len(pii.find(df).collect()) == len(rows)
    clean = {x.doc_id: x.text for x in pii.sanitise(df).collect()}
    assert "jo@ex.org" not in clean[0] and "[EMAIL]" in clean[0] and "falconer" not in clean[0]
    assert clean[301] is None and clean[10] == rows[4][1]
    assert pii.find(df.limit(0)).count() == 0


def slow_disclosures(texts):
    """(owner, term) -> (share, bits, action, broader), by the definition, from all texts."""
    near, n_e, df = {}, {}, {}
    for d, t in enumerate(texts):
        words = {w.lower() for w in re.findall(r"[^\W\d_]{2,}", t)}
        for x in {x for w in words for x in (w, w[:4] + "*" if len(w) > 4 else w, w[:2] + "*" if len(w) > 2 else w)}:
            df[x] = df.get(x, 0) + 1
        spans = plain(t)
        terms = [m for m in re.finditer(r"[^\W\d_]{2,}", t) if not any(b < m.end() and m.start() < e for b, _, e in spans)]
        for s in spans:
            owner = pii.entity(t, s)
            n_e.setdefault(owner, set()).add(d)
            i = sum(m.start() < s[0] for m in terms)
            for m in terms[max(0, i - 8) : i + 8]:
                w = m[0].lower()
                for x in (w, w[:4] + "*" if len(w) > 4 else w, w[:2] + "*" if len(w) > 2 else w):
                    near.setdefault((owner, x), set()).add(d)
    share = {(e, x): len(ds) / (df[x] + 1) for (e, x), ds in near.items()}
    out = {}
    for (e, x), p in share.items():
        bits = math.log2(p * len(texts) / len(n_e[e]))
        if x[-1] != "*" and p >= 0.5 and bits >= 4:
            wide = [c for c in (x[:4] + "*" if len(x) > 4 else None, x[:2] + "*" if len(x) > 2 else None) if c and share[e, c] < 0.5]
            out[e, x] = (p, bits, "remove" if p >= 0.8 or not wide else "generalise", wide[0] if wide and p < 0.8 else None)
    return out


def test_shares_bits_and_actions_by_brute_force(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abdeilnorst") for _ in range(r.randint(2, 8))) for _ in range(120)]
    name = lambda: "".join(r.choice("fghkmpz") for _ in range(6))
    owners = [f"{name()}1@ex.org" for _ in range(40)] + ["10.0.0.1", "10.0.0.7", "4111111111111111", "+1 (555) 555-1234"]
    own_words = {o: [name() for _ in range(3)] + [r.choice(words)] for o in owners}
    texts = []
    for k in range(300):
        w = [r.choice(words) for _ in range(r.randint(5, 40))]
        for _ in range(r.choice([0, 0, 1, 2])):
            o = r.choice(owners)
            w += [o, r.choice(own_words[o]), r.choice(own_words[o])]
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = slow_disclosures(texts)
    got = {(x.e, x.t): (x.share, x.bits, x.action, x.broader) for x in pii.disclosures(pii.cut(pii._first_pass(df, False)), df).collect()}
    assert got.keys() == want.keys() and {x[2] for x in want.values()} == {"remove", "generalise"}
    for k, x in want.items():
        assert got[k][2:] == x[2:] and abs(got[k][0] - x[0]) + abs(got[k][1] - x[1]) < 1e-9
    for x in pii.find(df, keep_text=True).collect():
        spans = plain(x.text)
        assert [(s.begin, s.kind, s.end) for s in x.base] == spans
        for s in x.terms:
            acts = [want.get((pii.entity(x.text, b), x.text[s.begin : s.end])) for b in spans]
            assert (s.action, s.broader) in [a[2:] for a in acts if a]
    clean = {x.doc_id: x.text for x in pii.sanitise(df).collect()}
    assert any("*" in t for t in clean.values()) and not any(o in t for t in clean.values() for o in owners)


def test_query_shows_base_and_added_spans(spark, tmp_path):
    texts = [f"a{i} mail zeta jo@ex.org, call +1 (555) 555-1234 or 1.2.3.4 é" + "y" * i for i in range(4)] + [f"plain {i}" for i in range(100)] + [None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for x in queries.op10_information_pii(spark, str(tmp_path)).collect():
        base = plain(texts[x.doc_id] or "")
        shown = ",".join(f"{pii.KINDS[k]}:{b}:{e}" for b, k, e in base)
        assert x.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        spans = x.spans.split(",") if x.spans else []
        assert set(shown.split(",") if shown else []) <= set(spans)
        assert (x.doc_id < 4) == any(s.startswith("term:") for s in spans)
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
