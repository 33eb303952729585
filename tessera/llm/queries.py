"""The registered queries of this package: thin callers of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, lines, lm, pii, quality, rollup, simhash, toxicity
from .common import cut, fold, shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 5) == 1
    found = lm.fit_and_score(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: The counts that op2 keeps: words by the first tokenizer version, letters-and-digits runs by the second.
_WORDS, _RUNS = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: all come with words-1 counts; French and German ones are
    revised to runs-2 counts; documents of under 20 words are taken down. The
    second batch is committed twice, which changes nothing.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = cut(docs.select("source", "lang", F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("words"), F.regexp_count(F.lower(text), F.lit(_RUNS)).cast("long").alias("runs")))
    old = counts.select("source", "lang", F.lit("words-1").alias("tokenizer"), F.col("words").alias("n_tokens"), "words")
    new = counts.select("source", "lang", F.lit("runs-2").alias("tokenizer"), F.col("runs").alias("n_tokens"), "words")
    moved = F.col("lang").isin("fr", "de")
    now = new.where(moved).unionByName(old.where(~F.coalesce(moved, F.lit(False))))
    kept = rollup.Rollup(spark, shared_path(spark, "token-rollup"))
    kept.commit("0001-load", rollup.inserts(old))
    for _ in range(2):
        kept.commit("0002-upgrade", rollup.revisions(old.where(moved), new.where(moved)))
    kept.compact()
    kept.commit("0003-takedown", rollup.deletes(now.where("words < 20")))
    return kept.totals()


def op3_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    found = quality.score(docs, model)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_text_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    found = toxicity.score(docs, model)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.col("toxic").alias("over_threshold"))


def op6_minhash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.duplicates(table(spark, sf_dir, "documents")).drop("row")


def op7_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        F.expr("aggregate(leak_spans, 0L, (n, s) -> n + s.end - s.begin)").alias("n_hit"),
        F.size("leak_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak_items", ","), 256).alias("items_sha256"),
        (F.size("leak_items") >= 2).alias("contaminated"),
    )


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_information_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    kind = lambda k: F.element_at(F.array(*map(F.lit, pii.KINDS)), k + 1)
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s.kind), s.begin, s.end)), ",")
    every = F.array_sort(F.concat(F.col("base"), F.transform("terms", lambda s: F.struct(s.begin.alias("begin"), F.lit(4).alias("kind"), s.end.alias("end")))))
    acts = F.array_join(F.transform("terms", lambda s: F.concat_ws(":", s.begin, s.end, F.coalesce(s.broader, s.action))), ",")
    n = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    return found.select("doc_id", *map(n, range(4)), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(every).alias("spans"), acts.alias("actions"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_gated_lm, op2_token_rollup, op3_hilbert_ann, op4_byte_cnn, op5_text_cnn, op6_minhash_lines, op7_fm_index, op8_simhash_trie, op9_bpe_prefix_dp, op10_information_pii)}

#: DuckDB SQL of the queries that it can express on whole tables.
ORACLE: dict[str, str] = {
    "op2_token_rollup": r"""
        with counted as (
            select source, lang, coalesce(text, '') as t from documents
        ), sized as (
            select source, lang, coalesce(lang in ('fr', 'de'), false) as moved,
                   len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as words,
                   len(regexp_extract_all(lower(t), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as runs
            from counted
        )
        select source, lang, case when moved then 'runs-2' else 'words-1' end as tokenizer,
               cast(count(*) as bigint) as n_docs, cast(sum(case when moved then runs else words end) as bigint) as n_tokens
        from sized where words >= 20 group by 1, 2, 3
    """,
}
