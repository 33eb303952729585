"""Fuzzy line deduplication by MinHash, in DataFrame and SQL functions only.

A line is compared in lower case, without outer white space of any script. Its signature is
the bottom of a MinHash ordering: character shingles that begin where a
word does are hashed, the smallest SKETCH distinct hashes are kept in order,
and each two neighbours of them make a band. Lines that share a band, and a third
of their signatures, are candidates; of these, pairs whose sets of five-character
shingles have an exact Jaccard similarity of 0.8 or more are linked, and of
each component of links the first line stays.

The smallest key of a band leads it: every member meets the leader. Members
that aren't linked with it all meet one another, by sketches of their shingles of which a
pair at the threshold never differs in too many bits; very large bands are
dealt by a further hash of the signatures first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, free_name, shared_dir, stored, tidy

#: Hashes of a signature; SKETCH - 1 bands. A pair at the threshold shares a band with a probability of 0.985.
SKETCH = 12
CHARS = 5
#: A shingle begins after each space; in lines of long words, as in scripts that don't part them, anywhere. Lines between
#: the two numbers of characters a word have both signatures, so that similar lines always have one in common.
_WORDWISE, _DENSE = r"(?s) (?=(\S.{0,8}))", r"(?s)(?=(.{9}))"
LONG_WORDS = (12, 20)
_SHINGLE = r"(?s)(?=(.{5}))"
#: White space of Unicode, the separators of ASCII included; a line feed ends a line.
_BLANK = " \t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Rows of one long at most that are broadcast (some 16 MB in all); larger sides are shuffled.
SMALL = 250_000
#: Bits of a filter, as powers of two: sixteen a value between these bounds, so 16 MB at most are broadcast. A bitmap of Spark's has 2^15.
FILTER_BITS, BITMAP = (20, 27), 15
#: Members that a band may have beside its leader before it is dealt anew.
CROWD = 4_000
#: Longs of a sketch of a line's shingles.
PARITY = 16
#: Parts of the members by a hash of the line, the rounds at most in which they meet, and the pairs of a row that ask for one more.
DEALS, ROUNDS, ROUND_PAIRS = 256, 4, 256
#: Bits of the first hash that tells lines apart; a second one of 64 bits finds lines that share it.
KEY_BITS = 64
_LINES = 4294967296  # places of lines within a document
_WORD_COLUMNS, _DENSE_COLUMNS = [f"w{i}" for i in range(SKETCH // 2)], [f"d{i}" for i in range(SKETCH // 2)]


def _if_small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def among(rows: DataFrame, names: list[str], held: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``names`` aren't a row of ``held`` (the same names): fewer rows are shuffled to the join that follows.

    A broadcast of bitmaps by hash; of other rows a sixteenth passes, more only beyond 8 million rows of ``held``.
    """
    low, high = FILTER_BITS
    power = max(low, min(high, (16 * held.count()).bit_length()))
    bit = F.xxhash64(F.lit(power), *names).bitwiseAND(F.lit((1 << power) - 1))
    own, bits = free_name(rows, "bucket"), free_name(rows, "bits")
    bucket, at = F.shiftright(bit, BITMAP).alias(own), bit.bitwiseAND(F.lit((1 << BITMAP) - 1))
    maps = held.select(bucket, at.alias("at")).repartition(own).groupBy(own).agg(F.bitmap_construct_agg("at").alias(bits))
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.select("*", bucket).join(F.broadcast(maps), own)
    return marked.where(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1).select(*rows.columns)


def lines_of(documents: DataFrame, clash: DataFrame | None = None) -> DataFrame:
    """(doc_id, row, line_no, norm, key, check) of every line; ``row`` tells rows that share an id apart, key is null for blank lines.

    ``clash`` holds the keys that different lines share; these get another key from both hashes.
    """
    text = documents["text"].cast("string")
    norm = F.lower(F.btrim("line", F.lit(_BLANK)))
    key = F.xxhash64("norm") if KEY_BITS == 64 else F.xxhash64("norm").bitwiseAND(F.lit((1 << KEY_BITS) - 1))
    lines = (
        documents.select(documents["doc_id"].cast("long").alias("doc_id"), F.xxhash64(documents["doc_id"].cast("long"), text).alias("row"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
        .select("doc_id", "row", "line_no", norm.alias("norm"))
        .withColumn("key", F.when(F.col("norm") != "", key)).withColumn("check", F.xxhash64(F.lit(1), "norm"))
    )
    if clash is not None:
        lines = lines.join(clash.select("key", F.lit(True).alias("shared")), "key", "left")
        lines = lines.withColumn("key", F.when(F.col("shared"), F.xxhash64("key", "check")).otherwise(F.col("key"))).drop("shared")
    return lines


def _entries(pattern: str) -> Column:
    """The smallest 32-bit hashes of the shingles of norm, in order."""
    found = F.regexp_extract_all(F.concat(F.lit(" "), "norm"), F.lit(pattern), F.lit(1))
    return F.slice(F.sort_array(F.array_distinct(F.transform(found, lambda x: F.hash(x)))), 1, SKETCH)


def _packed(entries: str, names: list[str]) -> list[Column]:
    """Two entries a long; where the second is missing the first stands twice."""
    at = lambda i: F.get(entries, F.lit(i))
    low = lambda i: F.coalesce(at(i + 1), at(i)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return [F.shiftleft(at(2 * k).cast("long"), 32).bitwiseOR(low(2 * k)).alias(n) for k, n in enumerate(names)]


def _unpacked(keys: DataFrame) -> DataFrame:
    """(key, w, d) with the entries of both signatures as arrays, empty where a line has no such signature.

    An array is made once a line and read by its places, as expressions over single entries grow past the 8,000
    bytes of a method that Java compiles, and are interpreted then.
    """
    made = []
    for names, to in ((_WORD_COLUMNS, "w"), (_DENSE_COLUMNS, "d")):
        halves = [x for n in names for x in (F.shiftright(n, 32), F.shiftright(F.shiftleft(n, 32), 32))]
        # an entry that stands twice or is null there is none of
        made.append(F.array_except(F.array(*halves), F.array(F.lit(None).cast("long"))).alias(to))
    return keys.select("key", *made)


def signed(rows: DataFrame) -> DataFrame:
    """``rows`` with packed signatures of norm: by words, dense at every character, one or both by the words' length."""
    words = F.char_length("norm") - F.char_length(F.replace("norm", F.lit(" "))) + 1
    low, high = LONG_WORDS
    made = rows.withColumn("per", F.char_length("norm") / words)
    made = made.withColumns({"by_word": F.when(F.col("per") <= high, _entries(_WORDWISE)), "dense": F.when(F.col("per") >= low, _entries(_DENSE))})
    return made.select(*rows.columns, *_packed("by_word", _WORD_COLUMNS), *_packed("dense", _DENSE_COLUMNS))


def _bands(keys: DataFrame) -> DataFrame:
    """(key, t) of the bands of both signatures: each two neighbours; of six or fewer hashes every other two as well, of three or fewer each alone."""
    steps = lambda *n: F.array(*[F.lit(16 * kind + i) for kind, many in enumerate(n) for i in range(many)])
    at, kind = F.col("step") % 16, F.floor(F.col("step") / 16).cast("int")
    rows = _unpacked(keys).select("key", F.explode(F.array("w", "d")).alias("e")).withColumn("n", F.size("e")).where("n > 0")
    rows = rows.select("key", "e", F.explode(F.when(F.col("n") > 6, steps(SKETCH - 1)).when(F.col("n") > 3, steps(5, 4)).otherwise(steps(2, 1, 3))).alias("step"))
    rows = rows.select("key", F.get("e", at).alias("x"), F.get("e", at + kind + 1).alias("y"), kind.alias("kind"))
    pair, alone = F.xxhash64("x", "y"), F.xxhash64(F.lit("one"), "x")
    return rows.where("x is not null and (kind = 2 or y is not null)").select("key", F.when(F.col("kind") == 2, alone).otherwise(pair).alias("t"))


def members_of(keys: DataFrame) -> DataFrame:
    """(t, key, leader) of the members of bands of two or more lines, from packed signatures.

    Leaders are partial aggregates, stored before they are joined back on the band, so that only one shuffle of all bands
    is held at a time, and only the bands that may have one are shuffled again; adaptive execution splits its skewed values.
    """
    spread = _bands(keys)
    leaders = stored(spread.groupBy("t").agg(F.min("key").alias("leader"), F.max("key").alias("other")).where("leader <> other").drop("other"), "line-leaders")
    tidy(keys.sparkSession)
    return among(spread, ["t"], leaders.select("t")).join(leaders, "t").select("t", "key", "leader").distinct()


def _place(doc_id: Column, line_no: Column) -> Column:
    """Order of lines: by doc_id, a null one last, then by number."""
    return (F.coalesce(doc_id, F.lit(2**63 - 1)).cast("decimal(20,0)") * F.lit(_LINES).cast("decimal(10,0)") + line_no.cast("decimal(10,0)")).cast("decimal(32,0)")


def shingles(x: Column) -> Column:
    """The set of five-character shingles, told apart by 64-bit hashes; a shorter line is one shingle."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(_SHINGLE), F.lit(1)), lambda y: F.xxhash64(y)))
    return F.when(F.char_length(x) < CHARS, F.array(F.xxhash64(x))).otherwise(found)


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of distinct ``pairs`` (u, v) those whose lines have an exact Jaccard similarity of 0.8 or more."""
    texts = among(texts, ["key"], pairs.select(F.explode(F.array("u", "v")).alias("key")))
    side = lambda k, n: texts.select(F.col("key").alias(k), F.col("norm").alias(n))
    both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v")
    sets = both.select("u", "v", shingles(F.col("a")).alias("a"), shingles(F.col("b")).alias("b"))
    return cut(sets.where(F.size(F.array_intersect("a", "b")) * 9 >= (F.size("a") + F.size("b")) * 4).select("u", "v"))


def _likely(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """Of distinct ``pairs`` those that share a third of the smaller one of their signatures by words, or of the dense ones.

    Of a pair at the threshold fewer than four of twelve are shared with a probability of under 0.005.
    """
    arrays = _unpacked(keys)
    side = lambda k, of: arrays.select(F.col("key").alias(k), F.col("w").alias(of + "w"), F.col("d").alias(of + "d"))
    met = pairs.join(side("u", "x"), "u").join(side("v", "y"), "v")
    third = lambda c: f"(size(x{c}) > 0 and size(y{c}) > 0 and size(array_intersect(x{c}, y{c})) * 3 >= least(size(x{c}), size(y{c})))"
    return met.where(f"{third('w')} or {third('d')}").select("u", "v")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("u"), F.greatest(x, y).alias("v")]


def _mixed(rows: DataFrame, by: str = "t") -> DataFrame:
    """``rows`` (.., key, root) of bands that hold several roots, with the number n of the band's rows."""
    held = rows.groupBy(by).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high")
    return cut(rows.join(held.select(by, "n"), by))


def _finer(crowd: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (t, key, root) of crowded bands with finer bands f by a further hash of their signatures, and the members of short signatures.

    Candidates share a third of a signature: of seven hashes or more one at least beside the band's own two. A line of
    under seven can be like one of a few more, so lines of under ten stay in their band as well.
    """
    rows = crowd.select("t", "key", "root").join(_unpacked(keys), "key").withColumn("size", F.greatest(F.size("w"), F.size("d")))
    each = rows.where("size >= 7").select("t", "key", "root", F.posexplode(F.array("w", "d")).alias("k", "e"))
    each = each.select("t", "key", "root", "k", "e", F.posexplode("e").alias("i", "c"))
    before, after = F.get("e", F.col("i") - 1), F.get("e", F.col("i") + 1)
    of_band = (before.isNotNull() & (F.col("t") == F.xxhash64(before, "c"))) | (after.isNotNull() & (F.col("t") == F.xxhash64("c", after)))
    finer = each.where(~of_band).select("t", "key", "root", F.xxhash64("t", "k", "c").alias("f"))
    return finer, rows.where("size < 10").select("t", "key", "root")


def _sketches(members: DataFrame, keys: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the lines of ``members`` (t, key): (key, size, o0.., ts, and the packed signatures).

    ``size`` counts the shingles; a bit of o0.. tells whether an odd number of them hash to it, so two lines differ in no more
    bits than in shingles. ``ts`` are the line's bands. The shingles of a line stay in its task.
    """
    own = members.groupBy("key").agg(F.collect_set("t").alias("ts"))
    each = own.select("key").join(among(texts, ["key"], members.select("key")), "key").repartition("key").select("key", F.explode(shingles(F.col("norm"))).alias("s"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("s", 8).bitwiseAND(F.lit(63)).cast("int"))
    odd = [F.bit_xor(F.when(F.pmod("s", F.lit(PARITY)) == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"o{k}") for k in range(PARITY)]
    made = each.groupBy("key").agg(F.count("*").alias("size"), *odd)
    return stored(made.join(own, "key").join(keys.select("key", *_WORD_COLUMNS, *_DENSE_COLUMNS), "key"), "line-sketches")


def _meeting(members: DataFrame, sketches: DataFrame, roots: DataFrame, low: int = 0, high: int = DEALS) -> DataFrame:
    """Pairs (u, v) of lines of a band that differ in the root and, by size and sketch, may be similar by 0.8 or more.

    Sets that are so similar differ in a ninth of the sum of their sizes at most. A pair is made in the first band alone that it shares,
    and only if its smaller line is of the deals ``low`` up to ``high``, of DEALS in all.
    """
    odd = [f"o{k}" for k in range(PARITY)]
    rooted = sketches.select("key", "size", "ts", *odd).join(_if_small(roots, roots.count()), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rows = members.join(rooted, "key")
    x, y = (rows.select("t", *[F.col(c).alias(n + c) for c in ("key", "root", "size", "ts", *odd)]) for n in "xy")
    if (low, high) != (0, DEALS):
        x = x.where(F.pmod(F.xxhash64("xkey"), F.lit(DEALS)).between(low, high - 1))
    differ = " + ".join(f"bit_count(x{c} ^ y{c})" for c in odd)
    met = x.join(y, "t").where(f"xroot <> yroot and (xsize < ysize or (xsize = ysize and xkey < ykey)) and xsize * 5 >= ysize * 4 and ({differ}) * 9 <= xsize + ysize and array_min(array_intersect(xts, yts)) = t")
    return met.select(F.least("xkey", "ykey").alias("u"), F.greatest("xkey", "ykey").alias("v"))


def _rounds(members: DataFrame) -> list[tuple[int, int]]:
    """Deals (low, high) of the rounds in which the members of bands meet: all in one if they make few pairs, else one deal first, which links
    most of a group of near copies, then ever more of the others, in ROUNDS rounds at most."""
    met, rows = members.groupBy("t").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")), F.sum("n")).first()
    rounds = int(min(ROUNDS - 1, (met or 0) / max(1.0, ROUND_PAIRS * (rows or 0))))
    ends = [0, *(round(DEALS ** (k / rounds)) for k in range(rounds))] if rounds else [0]
    return list(zip(ends, [*ends[1:], DEALS]))


def _merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots`` (key, root) with the components that the links ``found`` (u, v) join made one."""
    named = lambda k: found.join(roots.select(F.col("key").alias(k), F.col("root").alias(k + "root")), k, "left").withColumn(k, F.coalesce(k + "root", k))
    found = named("u").select("u", "v")
    upper = cut(components(named("v").select("u", "v")).withColumnRenamed("root", "top"))
    every = roots.unionByName(upper.select(F.col("node").alias("key"), F.col("node").alias("root"))).distinct()
    return every.join(upper, F.col("root") == F.col("node"), "left").groupBy("key").agg(F.min(F.coalesce("top", "root")).alias("root"))


def _linked(roots: DataFrame, pairs: DataFrame, keys: DataFrame, texts: DataFrame) -> DataFrame:
    """``roots`` after the links among ``pairs``; what is shuffled for them goes before the next ones."""
    likely = cut(_likely(pairs, keys))
    tidy(keys.sparkSession)
    found = similar(likely, texts)
    del likely, pairs
    if found.isEmpty():
        return roots
    roots = cut(_merged(roots, found))
    del found
    tidy(keys.sparkSession)
    return roots


def classes(members: DataFrame, keys: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, root): the component of every linked key, root its smallest key.

    ``members`` (t, key, leader) of bands, ``keys`` with packed signatures, ``texts`` (key, norm) of the members.
    Members meet in rounds; lines that an earlier link or round put into one component aren't compared again.
    """
    beside = members.where("key <> leader")
    likely = cut(_likely(beside.select(*_ordered("key", "leader")).distinct(), keys))
    tidy(members.sparkSession)
    led = similar(likely, texts)
    del likely
    tidy(members.sparkSession)
    roots = cut(components(led).withColumnRenamed("node", "key"))
    del led
    tidy(members.sparkSession)
    open_ = beside.select("t", "key").join(roots, "key", "left").select("t", "key", F.coalesce("root", "key").alias("root"))
    left = _mixed(open_)
    if left.isEmpty():
        return roots
    crowd = left.where(F.col("n") > CROWD)
    met = left.where(F.col("n") <= CROWD).select("t", "key")
    if not crowd.isEmpty():
        finer, short = _finer(crowd, keys)
        met = met.unionByName(_mixed(finer, "f").select(F.col("f").alias("t"), "key")).unionByName(short.select("t", "key"))
    met = stored(met.distinct(), "line-crowds")
    del left, open_, crowd
    tidy(members.sparkSession)
    sketches = _sketches(met, keys, texts)
    tidy(members.sparkSession)
    for low, high in _rounds(met):
        roots = _linked(roots, _meeting(met, sketches, roots, low, high), sketches, texts)
    return roots


def _keys(lines: DataFrame) -> DataFrame:
    """(key, place, least, most, signature) of every distinct line; equal lines are summed in each task before the shuffle, so a hot line costs one row a task."""
    placed = lines.where("key is not null").select("key", "check", _place(F.col("doc_id"), F.col("line_no")).alias("place"), "norm")
    names = [*_WORD_COLUMNS, *_DENSE_COLUMNS]
    return signed(placed).groupBy("key").agg(F.min("place").alias("place"), F.min("check").alias("least"), F.max("check").alias("most"), *[F.min(n).alias(n) for n in names])


def duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, class_doc_id, class_line_no, kept) of every line of ``documents``.

    The class is named by its first line, by doc_id, then number, which alone
    is kept. Blank lines are their own class and stay. Null texts have no
    lines, an empty one a blank line; rows that repeat a doc_id and text are
    one document, whose lines are kept or not together; null ids come last; an empty table has no lines.
    Other columns aren't read. Lines are told apart by two 64-bit hashes of their normal form; links are verified on texts.
    """
    shared_dir(documents.sparkSession)
    lines = lines_of(documents)
    keys = stored(_keys(lines), "line-keys")
    clash = keys.where("least <> most").select("key")
    if not clash.isEmpty():
        lines = lines_of(documents, clash)
        keys = stored(_keys(lines), "line-keys")
    full = lines.where("key is not null")
    tidy(documents.sparkSession)
    members = stored(members_of(keys), "line-bands")
    tidy(documents.sparkSession)
    held = stored(keys.join(members.select("key").distinct(), "key", "left_semi").select("key", F.col("place").alias("first"), *_WORD_COLUMNS, *_DENSE_COLUMNS), "line-members")
    wanted = held.select("key", "first")
    # of equal lines only the first one's text moves on
    many, texts = wanted.count(), full.select("key", _place(F.col("doc_id"), F.col("line_no")).alias("place"), "norm")
    if many > SMALL:
        texts = among(texts, ["key", "place"], wanted.select("key", F.col("first").alias("place")))
    texts = texts.join(_if_small(wanted, many), "key").where("place = first").groupBy("key", "place").agg(F.min("norm").alias("norm")).drop("place")  # dealt by both
    texts = stored(texts, "line-texts")
    tidy(documents.sparkSession)
    roots = cut(classes(members, held, texts))
    linked = keys.select("key", "place").join(roots, "key")
    first = linked.groupBy("root").agg(F.min("place").alias("first"))
    moved = cut(linked.join(first, "root").select("key", "first"))
    of_key = keys.select("key", "place").join(moved, "key", "left").select("key", F.coalesce("first", "place").alias("first"))
    own = _place(F.col("doc_id"), F.col("line_no"))
    every = lines.select("doc_id", "row", "line_no", "key", own.alias("place"))
    marked = every.where("key is not null").join(of_key, "key").unionByName(every.where("key is null").withColumn("first", F.col("place")))
    base = F.lit(_LINES).cast("decimal(10,0)")
    low = F.expr(f"pmod(first, cast({_LINES} as decimal(10,0)))")
    return marked.select(
        "doc_id", "row", "line_no", ((F.col("first") - low) / base).cast("long").alias("class_doc_id"), low.cast("long").alias("class_line_no"), (F.col("first") == F.col("place")).alias("kept")
    )


def deduplicate(documents: DataFrame) -> DataFrame:
    """``documents`` with the kept lines alone; n_chars, where there is one, follows the text.

    Documents whose every line with text goes leave with them; those without such lines, null texts included, stay as they are.
    All columns stay, whatever their names; an empty table stays empty.
    """
    row, gone, new, id_ = (free_name(documents, n) for n in ("row", "gone", "new", "id"))
    removed = duplicates(documents).where("not kept").groupBy(F.col("doc_id").alias(id_), F.col("row").alias(row)).agg(F.collect_set("line_no").alias(gone))
    text = documents["text"].cast("string")
    with_row = documents.withColumns({row: F.xxhash64(documents["doc_id"].cast("long"), text), id_: documents["doc_id"].cast("long")})
    joined = with_row.alias("d").join(removed.alias("r"), (F.col(f"d.{row}") == F.col(f"r.{row}")) & F.col(f"d.{id_}").eqNullSafe(F.col(f"r.{id_}")), "left")
    joined = joined.select(*[F.col(f"d.`{c}`") for c in documents.columns], F.col(f"r.{gone}"))
    rebuilt = F.transform(F.array(F.split("text", "\n")), lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(gone)), lambda i: p[i]), "\n"))[0]
    out = joined.withColumn(new, F.when(F.col(gone).isNotNull(), rebuilt)).where(F.col(gone).isNull() | (F.btrim(new, F.lit(_BLANK + "\n")) != ""))
    out = out.withColumn("text", F.coalesce(new, "text"))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col(new).isNotNull(), F.char_length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in documents.columns])
