import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def peer(enc):
    return tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=enc.v.ranks, special_tokens={})


def test_same_ids_as_tiktoken(enc, peer):
    r = random.Random(1)
    letters = "ab cdAB  \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　é日本語ö'’s're 12٣½🙂​́.!?-_"
    for _ in range(600):
        x = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        ids = enc.encode(x)
        assert list(ids) == peer.encode_ordinary(x)
        assert enc.decode(ids) == x.encode()


def test_long_piece_is_linear(enc, peer):
    x = "ab" * 3000 + " " * 2000
    assert list(enc.encode(x)) == peer.encode_ordinary(x)


def test_append_and_replace_are_exact(enc):
    r = random.Random(2)
    for _ in range(60):
        d = bytes(r.choice(b"abc the") for _ in range(r.randint(0, 200)))
        p = bpe.Prefixes(enc.v, d[: len(d) // 2])
        p.append(d[len(d) // 2 :])
        assert p.last == bpe.Prefixes(enc.v, d).last and p.ids() == (enc.v.merged(d) if d else [])
        b = r.randint(0, len(d))
        e, new = r.randint(b, min(len(d), b + 5)), bytes(r.choice(b"abthe ") for _ in range(r.randint(0, 5)))
        p.replace(b, e, new)
        assert p.last == bpe.Prefixes(enc.v, d[:b] + new + d[e:]).last


def test_edit_far_from_the_end_is_local(enc):
    p = bpe.Prefixes(enc.v, b"the thing and " * 400)
    assert p.replace(100, 103, b"xyz") < 200


def test_documents(spark, peer):
    rows = [(1, "The cat's  hat\n", 9), (1, "The cat's  hat\n", 9), (2, "", 9), (3, None, 9), (None, "é" * 3000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")  # a clashing name isn't read
    got = sorted(bpe.encode_digest(df, PATH, public_tokenizers.PATTERN).collect(), key=str)
    want = []
    for i, t, _ in rows:
        ids = peer.encode_ordinary(t or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha((t or "").encode())))
    assert [tuple(x) for x in got] == sorted(want, key=lambda x: str(bpe_row(x)))
    assert bpe.encode_digest(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    full = bpe.encode_documents(df.where("doc_id = 1"), PATH, public_tokenizers.PATTERN).first()
    assert full.ids == peer.encode_ordinary("The cat's  hat\n") and bytes(full.decoded) == b"The cat's  hat\n"


def bpe_row(x):
    from pyspark.sql import Row

    return Row(doc_id=x[0], n_tokens=x[1], ids_sha256=x[2], decoded_sha256=x[3])
