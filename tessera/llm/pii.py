"""Personal data: patterns, and terms around them that give them away.

The patterns find protected entities (addresses, cards, phones). A term near
an entity may reveal it even when the entity itself is gone. How strongly it
does is estimated from co-occurrence in the corpus: of the documents that hold
the term, the share in which it stands next to the entity's owner, and the bits by which
seeing the term raises the owner's probability. One document more without the owner is
assumed, so that a term seen once discloses by one half, and surer as it recurs. Terms
beyond a threshold are generalised to the narrowest class of terms, those that
begin alike, that stays under it; terms beyond a higher one, and those without such a
class, are removed, wherever they stand next to the entity.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, small_batches, strings, text_of

KINDS = ("email", "ip", "card", "phone", "term")
#: Terms on either side of an entity that count as its context.
CONTEXT = 8
#: A term is sanitised if it stands by the owner in this share of its documents and adds so many bits; beyond REMOVE it isn't generalised.
GENERALISE, REMOVE, BITS = 0.5, 0.8, 4.0
#: A broader class holds the terms that begin with the same so many characters, the narrower one first.
STEMS = (4, 2)
#: Bits of the map of candidate terms that workers get; terms that share a bit are told apart by the join.
MAP_BITS = 1 << 23

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W\d_]{2,}")

Span = tuple[int, int, int]  # begin, kind, end in code points


def emails(text: str) -> list[Span]:
    """Leftmost matches of local@domain. Walking back from each @ gives them in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, 0, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def ips(text: str) -> list[Span]:
    def fits(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) < 4 and int(part or 0) <= 255

    return [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(fits, m.group().split(".")))]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _DIGITS.sub("", m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    return out


def phones(text: str) -> list[Span]:
    return [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m.group())) <= 15]


def base_spans(text: str) -> list[Span]:
    """Spans of all kinds by begin, then kind."""
    found = emails(text) if "@" in text else []
    found += ips(text) + cards(text)
    if "+" in text:
        found += phones(text)
    return sorted(found)


def show(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in spans)


def entity(text: str, span: Span) -> int:
    """A 64-bit name of the entity's owner: its kind and the address without the local part's digits, the network of an ip, all digits of a card or phone."""
    value = text[span[0] : span[2]].lower()
    if span[1] == 0:
        local, _, domain = value.partition("@")
        value = f"{local.rstrip('0123456789._%+-') or local}@{domain}"
    elif span[1] == 1:
        value = ".".join(part.lstrip("0") for part in value.split(".")[:3])
    else:
        value = _DIGITS.sub("", value)
    return int.from_bytes(hashlib.blake2b(f"{KINDS[span[1]]}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def contexts(text: str, spans: list[Span]) -> list[tuple[int, str, int, int]]:
    """(entity, term, begin, end) of the terms around each span, outside of all spans."""
    terms, k = [], 0
    for m in _TERM.finditer(text):
        while k < len(spans) and spans[k][2] <= m.start():
            k += 1
        if not any(b < m.end() and m.start() < e for b, _, e in spans[k : k + 4]):
            terms.append((m.start(), m.end()))
    out, i = [], 0
    for s in spans:
        while i < len(terms) and terms[i][0] < s[0]:
            i += 1
        name = entity(text, s)
        out += [(name, text[b:e].lower(), b, e) for b, e in terms[max(0, i - CONTEXT) : i + CONTEXT]]
    return out


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_CONTEXTS = pa.list_(pa.struct([("e", pa.int64()), ("t", pa.string()), ("b", pa.int64()), ("x", pa.int64())]))


def _first_pass(documents: DataFrame, keep_text: bool) -> DataFrame:
    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            spans, near, key = [], [], []
            for t in strings(b.column(1)):
                s = base_spans(t)
                c = contexts(t, s) if s else []
                spans.append([{"begin": x, "kind": k, "end": y} for x, k, y in s])
                near.append([{"e": e, "t": w, "b": x, "x": y} for e, w, x, y in c])
                key.append(hashlib.sha256(t.encode()).hexdigest()[:32] if c else None)
            cols = [b.column(0), pa.array(spans, _SPANS), pa.array(near, _CONTEXTS), pa.array(key, pa.string())]
            return pa.RecordBatch.from_arrays(cols + [b.column(1)] * keep_text, ["doc_id", "base", "near", "key"] + ["text"] * keep_text)

        return run

    schema = "doc_id long, base array<struct<begin:long,kind:int,end:long>>, near array<struct<e:long,t:string,b:long,x:long>>, key string" + ", text string" * keep_text
    return map_rows(documents, [documents["doc_id"].cast("long").alias("doc_id"), text_of(documents)], make, schema)


def items(term: str) -> list[str]:
    """The term and its classes, the narrower one first; no term ends in a star."""
    return [term, *(f"{term[:n]}*" for n in STEMS if len(term) > n)]


def _document_counts(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """(t, df): in how many rows of ``documents`` each candidate, a term or a class of terms, occurs, over all of them.

    Workers get a map of MAP_BITS bits, whatever the number of candidates, and
    count the terms whose bit is set; the join leaves the candidates alone.
    """
    bit = (F.crc32(F.col("t").cast("binary")) % MAP_BITS + 1).cast("int")  # positions count from one
    rows = candidates.select(bit.alias("i")).groupBy(F.bitmap_bucket_number("i").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("i")).alias("bits")).collect()
    packed = bytearray(MAP_BITS // 8)
    for r in rows:  # at most MAP_BITS / 32768
        packed[(r.k - 1) * 4096 : r.k * 4096] = r.bits
    shared = documents.sparkSession.sparkContext.broadcast(bytes(packed))
    small_batches(documents.sparkSession)

    def count(batches):
        bits, wanted, counts = shared.value, {}, Counter()

        def want(word: str) -> tuple[str, ...]:
            """The candidates that the word stands for: itself and its classes."""
            out = []
            for item in items(word):
                i = zlib.crc32(item.encode()) % MAP_BITS
                if bits[i >> 3] >> (i & 7) & 1:
                    out.append(item)
            return tuple(out)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["t", "n"])

        for b in batches:
            for text in strings(b.column(0)):
                found = set()
                for w in {x.lower() for x in set(_TERM.findall(text))}:
                    own = wanted.get(w)
                    if own is None:
                        own = want(w)
                        if len(w) <= 64:  # so that an entry takes 400 bytes at most
                            if len(wanted) >= 100_000:
                                wanted.clear()
                            wanted[w] = own
                    found.update(own)
                counts.update(found)
            if len(counts) > 200_000:
                yield rows()
                counts.clear()
        if counts:
            yield rows()

    counted = documents.select(text_of(documents)).mapInArrow(count, "t string, n long").groupBy("t").agg(F.sum("n").alias("df"))
    return candidates.select("t").distinct().join(counted, "t")


def disclosures(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(e, t, share, bits, action, broader) of the terms that give owners away, from the first pass over all rows."""
    rows = found.where("key is not null").withColumn("d", F.monotonically_increasing_id())  # of rows that are written down
    near = rows.select("d", F.explode(F.array_distinct(F.transform("near", lambda x: F.struct(x.e.alias("e"), x.t.alias("t"))))).alias("x")).select("d", "x.e", "x.t")
    length = F.char_length("t")
    stem = lambda n: F.when(length > n, F.concat(F.substring("t", 1, n), F.lit("*")))
    seen = near.select("d", "e", F.explode(F.array(F.col("t"), *map(stem, STEMS))).alias("t")).where("t is not null")
    joint = cut(seen.distinct().groupBy("e", "t").agg(F.count("*").alias("n")))
    owners = near.select("d", "e").distinct().groupBy("e").agg(F.count("*").alias("n_e"))
    total = found.count()
    shared = joint.join(_document_counts(documents, joint), "t").withColumn("share", F.col("n") / (F.col("df") + 1))
    shared = cut(shared.join(owners, "e").withColumn("bits", F.log2(F.col("share") * F.lit(float(max(total, 1))) / F.col("n_e"))).select("e", "t", "share", "bits"))
    out = shared.where(~F.endswith("t", F.lit("*"))).where((F.col("share") >= GENERALISE) & (F.col("bits") >= BITS))
    for n in STEMS:
        classes = shared.where((F.col("share") < GENERALISE) & F.endswith("t", F.lit("*")) & (F.char_length("t") == n + 1))
        classes = classes.select("e", F.col("t").alias(f"stem{n}"), F.col("t").alias(f"class{n}"))
        out = out.withColumn(f"stem{n}", stem(n)).join(classes, ["e", f"stem{n}"], "left")
    broader = F.coalesce(*[F.col(f"class{n}") for n in STEMS])
    removed = (F.col("share") >= REMOVE) | broader.isNull()
    return out.select("e", "t", "share", "bits", F.when(removed, "remove").otherwise("generalise").alias("action"), F.when(~removed, broader).alias("broader"))


def find(documents: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, base, terms[, text]) of every row of ``documents``.

    ``base``: the spans of the patterns (begin, kind, end; kind is the place in
    KINDS) by begin, then kind; ``terms``: spans of disclosing terms (begin,
    end, action, broader: the class that stands for a generalised one). Null and empty texts have none; repeated rows each give a
    row, with the same spans, and count as documents of their own; an empty table gives none; other columns aren't read.
    """
    found = cut(_first_pass(documents, keep_text))
    telling = disclosures(found, documents)
    spans = (
        found.where("key is not null").select("key", F.explode("near").alias("x")).select("key", "x.e", "x.t", "x.b", "x.x").distinct()
        .join(telling, ["e", "t"]).groupBy("key", "b", "x").agg(F.max(F.struct("action", "broader")).alias("a"))  # of two owners' actions, 'remove' is the stronger
        .groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("b").alias("begin"), F.col("x").alias("end"), F.col("a.action").alias("action"), F.col("a.broader").alias("broader")))).alias("terms"))
    )
    none = F.array().cast("array<struct<begin:bigint,end:bigint,action:string,broader:string>>")
    names = ["doc_id", "base", "terms"] + ["text"] * keep_text
    plain = found.where("key is null").withColumn("terms", none)
    return plain.select(*names).unionByName(found.where("key is not null").join(spans, "key", "left").withColumn("terms", F.coalesce("terms", none)).select(*names))


def redact(text: str | None, base: list, terms: list) -> str | None:
    """``text`` with spans of the patterns named by kind, telling terms generalised to their class or removed. Of overlapping spans the first counts."""
    if text is None:
        return None
    marks = [(s["begin"], s["end"], f"[{KINDS[s['kind']].upper()}]") for s in base]
    marks += [(s["begin"], s["end"], "" if s["action"] == "remove" else s["broader"]) for s in terms]
    out, at = [], 0
    for b, e, mark in sorted(marks):
        if b >= at:
            out += [text[at:b], mark]
            at = e
    return "".join([*out, text[at:]])


def sanitise(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with every row's text redacted."""

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            out = [redact(*x) for x in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

        return run

    rows = find(documents, keep_text=True)
    return map_rows(rows, [rows["doc_id"], rows["text"], rows["base"], rows["terms"]], make, "doc_id long, text string")
