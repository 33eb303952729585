import random

import duckdb

from tessera.llm import queries, rollup

SCHEMA = "source string, lang string, tokenizer string, n_tokens long"


def total(rows):
    out = {}
    for *k, n in rows:
        d, t = out.get(tuple(k), (0, 0))
        out[tuple(k)] = (d + 1, t + (n or 0))
    return out


def as_dict(df):
    return {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in df.collect()}


def test_batches_replays_and_compaction(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice(["en", None]), "t1", r.choice([3, 5, None])) for _ in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = rollup.Rollup(spark, f"{tmp_path}/rollup")
    assert as_dict(kept.totals()) == {}
    assert kept.commit("one", rollup.inserts(df)) and not kept.commit("one", rollup.inserts(df))
    assert as_dict(kept.totals()) == total(rows)
    gone = spark.createDataFrame(rows[:20], SCHEMA)
    assert kept.commit("two", rollup.deletes(gone))
    kept.compact()
    assert not kept.commit("two", rollup.deletes(gone))
    assert as_dict(kept.totals()) == total(rows[20:])
    new = [(s, lang, "t2", 1) for s, lang, _, _ in rows[20:]]
    assert kept.commit("three", rollup.revisions(spark.createDataFrame(rows[20:], SCHEMA), spark.createDataFrame(new, SCHEMA)))
    assert kept.commit("none", rollup.inserts(df.limit(0)))
    kept.compact()
    again = rollup.Rollup(spark, f"{tmp_path}/rollup")
    assert as_dict(again.totals()) == total(new) and not again.commit("three", rollup.inserts(df))


def test_commits_during_a_compaction(spark, tmp_path, monkeypatch):
    """A batch that is committed while another process compacts counts once; so does one compaction of two; merged folders go."""
    df = spark.createDataFrame([("a", "en", "t", 5)], SCHEMA)
    path = f"{tmp_path}/rollup"
    kept, other = rollup.Rollup(spark, path), rollup.Rollup(spark, path)
    assert kept.commit("one", rollup.inserts(df)) and kept.commit("two", rollup.inserts(df))
    publish = kept._publish

    def late(rows, name):
        if name.startswith("base-") and not other.fs.exists(other._at("batch-three")):
            assert other.commit("three", rollup.inserts(df))
            assert as_dict(other.totals()) == {("a", "en", "t"): (3, 15)}
        return publish(rows, name)

    monkeypatch.setattr(kept, "_publish", late)
    before = other.totals()
    assert kept.compact()
    assert as_dict(kept.totals()) == as_dict(other.totals()) == {("a", "en", "t"): (3, 15)}
    assert as_dict(before) == {("a", "en", "t"): (2, 10)}  # planned before, read after
    monkeypatch.setattr(other, "_listing", lambda at=other._listing(): at)  # lists, then is overtaken
    assert kept.compact() and not other.compact()
    assert as_dict(kept.totals()) == {("a", "en", "t"): (3, 15)}
    assert kept.compact() and not any(kept.commit(n, rollup.inserts(df)) for n in ("one", "two", "three"))
    names = sorted(x.name for x in (tmp_path / "rollup").iterdir() if not x.name.startswith("."))
    assert names == ["base-000000000001", "base-000000000002"] and as_dict(kept.totals()) == {("a", "en", "t"): (3, 15)}


def test_clashing_columns_and_very_long_texts(spark, tmp_path):
    rows = [(1, "a b " * 200_000, "en", "s", 7), (2, None, None, None, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long").selectExpr("*", "1 as words", "2 as n_docs").write.parquet(f"{tmp_path}/documents.parquet")
    assert as_dict(queries.op2_token_rollup(spark, str(tmp_path))) == {("s", "en", "words-1"): (1, 400_000)}


def test_query_against_sql(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["x", "y-z", "É1", "(q)"]) for _ in range(r.randint(0, 60))), r.choice(["fr", "de", "en", None]), r.choice(["s", None])) for i in range(200)] + [(9, None, "fr", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {tuple(x[:3]): tuple(x[3:]) for x in con.execute(queries.ORACLE["op2_token_rollup"]).fetchall()}
    assert as_dict(queries.op2_token_rollup(spark, str(tmp_path))) == want
