"""Document fingerprints by SimHash, and the search for near ones, in DataFrame functions alone.

A term is a distinct lower-cased word; its weight is its length up to four, so that
short common words count less. Each term's 128-bit hash votes with its weight, for a
bit where it is set and against it where not; the fingerprint has the bits that win.
Votes are summed two bits to a long (lanes of 32 bits, which the weights of a string
cannot overflow), in 64 sums per text.

The search cuts fingerprints into radius + 1 blocks. Two of them within the radius
agree on at least one block, so a table for each block, keyed by it, holds every pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helmwind.llm.common import documents, materialise, shuffle_partitions

#: Longs of a fingerprint, and its bits.
WORDS = 2
BITS = 64 * WORDS
HEAVIEST = 4
#: Bits in which near fingerprints may differ.
RADIUS = 3
WHITE = "[\\x20\\x09-\\x0D]+"
_LANES = 0x0000000100000001
#: Buckets of ids: so many to a shuffle partition, and in all.
BUCKETS_A_PARTITION, MOST_BUCKETS = 8, 32_768


def terms(text: Column) -> Column:
    """Distinct lower-cased words; a blank one may be among them and has no weight."""
    return F.array_distinct(F.split(F.lower(text), WHITE))


def hexadecimal(parts: list[Column]) -> Column:
    """Fingerprint as hex digits, the highest word first."""
    return F.lower(F.concat(*[F.lpad(F.hex(p), 16, "0") for p in reversed(parts)]))


def distance(a: list[Column], b: list[Column]) -> Column:
    """Bits that differ."""
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def likeness(bits: Column) -> Column:
    """Estimated cosine of the weighted terms of two texts: cos(pi * bits / 128), 0 where it is below."""
    return F.greatest(F.cos(bits * F.lit(3.141592653589793 / BITS)), F.lit(0.0))


def _won(lane: Column) -> Column:
    """The bits that win among the two of a lane."""
    one, none, half = F.lit(1).cast("long"), F.lit(0).cast("long"), F.col("__all")
    low = F.when(2 * lane["sum"].bitwiseAND(F.lit(0xFFFFFFFF)) > half, one).otherwise(none)
    high = F.when(2 * F.shiftrightunsigned(lane["sum"], 32) > half, one).otherwise(none)
    return F.call_function("shiftleft", low.bitwiseOR(F.shiftleft(high, 32)), lane["bit"])


def _vote(rows: DataFrame, keys: list[str], words: str) -> DataFrame:
    """(keys, f0, f1): fingerprint of the terms in the array column ``words``, one for each combination of keys."""
    w = F.col("__w")
    weight = F.least(F.coalesce(F.length(w), F.lit(0)), F.lit(HEAVIEST)).cast("long")
    hashes = [F.xxhash64(w, F.lit(i)).alias(f"__h{i}") for i in range(WORDS)]
    cast = rows.select(*keys, F.explode_outer(words).alias("__w")).select(*keys, weight.alias("__weight"), *hashes)
    sums = [
        F.sum(F.col("__weight") * F.shiftrightunsigned(f"__h{i}", k).bitwiseAND(F.lit(_LANES))).alias(f"__s{i}_{k}")
        for i in range(WORDS)
        for k in range(32)
    ]
    voted = cast.groupBy(*keys).agg(F.sum("__weight").alias("__all"), *sums)
    parts = []
    for i in range(WORDS):
        lanes = F.array(*[F.struct(F.col(f"__s{i}_{k}").alias("sum"), F.lit(k).alias("bit")) for k in range(32)])
        parts.append(F.aggregate(lanes, F.lit(0).cast("long"), lambda word, lane: word.bitwiseOR(_won(lane))).alias(f"f{i}"))
    return voted.select(*keys, *parts)


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, f0, f1) of each text; ``keys`` must tell the rows apart.

    Null, empty and blank texts have fingerprint 0. Texts are read whole, of any length; an
    empty table gives an empty result; other columns are ignored.
    """
    named = rows.select(*[F.col(f"`{k}`") for k in keys], terms(F.col(f"`{text}`").cast("string")).alias("__words"))
    return _vote(named, keys, "__words")


def within(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q0, q1, f0, f1, distance): every pair of a distinct query (f0, f1) and a distinct fingerprint of the corpus within ``radius`` bits.

    A pair is found in the table of the first block on which it agrees. Repeated rows count
    once; rows with a null word match nothing; an empty side gives an empty result.
    """
    if not 0 <= radius < BITS:
        raise ValueError("the radius must be 0 or more and below the number of bits")
    words = [f"f{i}" for i in range(WORDS)]
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]

    def cut(names: list[str], low: int, high: int) -> Column:
        """Bits low to high as a hash of the masked words, so that one join serves all blocks."""
        parts = []
        for i, name in enumerate(names):
            mask = ((1 << high) - (1 << low)) >> (64 * i) & ((1 << 64) - 1)
            if mask:
                parts.append(F.col(name).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        return F.xxhash64(*parts)

    def tables(side: DataFrame, names: list[str]) -> DataFrame:
        own = side.select(*[F.col(w).alias(n) for w, n in zip(words, names)]).dropna().distinct()
        return own.select(*names, F.posexplode(F.array(*[cut(names, a, b) for a, b in zip(edges, edges[1:])])).alias("__block", "__key"))

    asked, q = tables(queries, [f"q{i}" for i in range(WORDS)]), [f"q{i}" for i in range(WORDS)]
    held = tables(corpus, words).withColumnsRenamed({"__block": "__b", "__key": "__k"})
    bits = distance([F.col(c) for c in q], [F.col(c) for c in words])
    earlier = F.lit(False)
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        earlier = earlier | ((F.col("__block") > i) & (cut(q, a, b) == cut(words, a, b)))
    same = (F.col("__key") == F.col("__k")) & (F.col("__block") == F.col("__b")) & (bits <= radius) & ~earlier
    return asked.join(held, same).select(*q, *words, bits.alias("distance"))


def near_counts(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(f0, f1, n_near): for each distinct fingerprint the rows within ``radius`` bits of it, its own row not counted.

    Distinct fingerprints are compared once, whatever the number of their copies.
    """
    words = [f"f{i}" for i in range(WORDS)]
    held = prints.groupBy(*words).agg(F.count("*").alias("__n"))
    found = within(held, held, radius).join(held, words).groupBy(*[f"q{i}" for i in range(WORDS)]).agg((F.sum("__n") - 1).alias("n_near"))
    return found.withColumnsRenamed({f"q{i}": f"f{i}" for i in range(WORDS)})


def _bucket(doc_id: Column, tie: Column, bounds: list[int]) -> Column:
    """Number of bounds up to the id, by a binary search without branches; null ids are below all, dealt by the tie in its order."""
    steps = max(len(bounds), 1).bit_length()
    padded = F.lit(bounds + [None] * ((1 << steps) - len(bounds))) if bounds else F.array(F.lit(None).cast("long"))
    jumps = F.array(*[F.lit(1 << s) for s in reversed(range(steps))])
    found = F.aggregate(jumps, F.lit(0), lambda at, jump: at + F.when(F.get(padded, at + jump - 1) <= doc_id, jump).otherwise(F.lit(0)))
    return F.when(doc_id.isNull(), F.shiftright(tie, 58).cast("int") - 33).otherwise(found)


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, rank, doc_id, text, next_text) of (doc_id, text): each row with the text that follows in descending order of the id.

    The last row is followed by the first. Null ids come after all others; rows of one id, and
    those without one, are in descending order of their texts' hash; null texts are empty. An
    empty table gives an empty result; other columns are ignored.

    Ids are cut at quantiles into buckets that keep their order (rows of one id share a
    bucket), so a bucket's rows follow each other within it; only its last row asks
    for the head of the next bucket, whose ids are found by an aggregate of ids alone.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n = min(BUCKETS_A_PARTITION * shuffle_partitions(spark), MOST_BUCKETS)
    cuts = F.percentile_approx("doc_id", F.lit([i / n for i in range(1, n)]), F.lit(20 * n))
    bounds = sorted(set(rows.agg(cuts.alias("c")).head()["c"] or []))
    tie = F.xxhash64("text")
    placed = rows.withColumn("tie", tie).withColumn("bucket", _bucket(F.col("doc_id"), F.col("tie"), bounds))
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.desc("tie"))
    heads = _heads(placed)
    own = placed.withColumns({"rank": F.row_number().over(order), "__next": F.lead("text").over(order)})
    joined = own.join(heads, "bucket", "left")
    return joined.select("bucket", "rank", "doc_id", "text", F.coalesce("__next", "__head").alias("next_text"))


def _heads(placed: DataFrame) -> DataFrame:
    """(bucket, __head): for each bucket the first text of the bucket that follows; one row a bucket."""
    by_id = placed.where("doc_id is not null").groupBy("bucket").agg(F.max("doc_id").alias("doc_id"))
    top = placed.join(F.broadcast(by_id.withColumnsRenamed({"bucket": "__b", "doc_id": "__id"})), (F.col("doc_id") == F.col("__id")), "left_semi")
    without = placed.where("doc_id is null")
    first = top.unionByName(without).groupBy("bucket").agg(F.max_by("text", "tie").alias("text"))
    ranked = Window.orderBy(F.desc("bucket"))  # one row a bucket
    heads = materialise(first, "fingerprint-heads")
    listed = heads.select("bucket", F.coalesce(F.lead("bucket").over(ranked), F.first("bucket").over(ranked)).alias("__follows"))
    return listed.join(heads.select(F.col("bucket").alias("__follows"), F.col("text").alias("__head")), "__follows").select("bucket", "__head")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by the first as many code points of another, or all of them."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def edited_fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near of (doc_id, text).

    ``n_near`` is the number of other rows whose fingerprint is within ``radius`` bits. See
    :func:`with_next` for nulls, ties, repeated rows and empty tables; a single row follows
    itself; wordless texts have fingerprint 0 and likeness 1 to each other.
    """
    pairs = with_next(docs)
    made = pairs.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    head = ["bucket", "rank", "doc_id", "n_chars", "edited_sha256"]
    sides = F.inline(F.array(*[F.struct(F.lit(i).alias("side"), terms(F.col(c)).alias("words")) for i, c in enumerate(("text", "edited"))]))
    cut = made.select(
        "bucket", "rank", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sides
    )
    both = _vote(cut, [*head, "side"], "words")
    words = [f"f{i}" for i in range(WORDS)]
    picked = [F.max(F.when(F.col("side") == s, F.col(w))).alias(w if s == 0 else f"e{w}") for s in (0, 1) for w in words]
    table = materialise(both.groupBy(*head).agg(*picked), "fingerprints")
    own, changed = [F.col(w) for w in words], [F.col(f"e{w}") for w in words]
    order = Window.partitionBy("bucket").orderBy("rank")
    ranked = Window.orderBy(F.desc("bucket"))  # one row a bucket
    firsts = table.where("rank = 1").select("bucket", F.struct(*own).alias("__first"))
    follows = firsts.select("bucket", F.coalesce(F.lead("__first").over(ranked), F.first("__first").over(ranked)).alias("__head"))
    following = F.coalesce(F.lead(F.struct(*own)).over(order), F.col("__head"))
    joined = table.join(F.broadcast(follows), "bucket").withColumn("__next", following)
    near = near_counts(table.select(*words), radius)
    return joined.join(near, words).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexadecimal(own).alias("fingerprint"),
        hexadecimal(changed).alias("edited_fingerprint"),
        likeness(distance(own, changed)).alias("near_edited"),
        likeness(distance(own, [F.col(f"__next.{w}") for w in words])).alias("near_next"),
        "n_near",
    )


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near of every document."""
    return edited_fingerprints(documents(spark, sf_dir))
