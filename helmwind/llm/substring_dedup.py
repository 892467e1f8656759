"""Substring deduplication by recompression.

Words are rewritten in rounds: equal neighbours (runs) get one name, then pairs of a
left-class and a right-class symbol get one name. A name follows from what it stands
for, so a symbol depends only on the few words around it: equal passages get the same
interior symbols wherever they occur. Each symbol carries the words it stands for and
the range of words that its identity was read from.

Spark rounds settle the names of the levels in ``LEVELS``, low ones first: all tasks
send the names they hold to buckets by name, which tell whether a name occurs once or
more often in the corpus. What stands on a name that occurs once occurs once itself
and is not asked for again, so the higher rounds see only what recurs. A window of
``width`` words is ruled out if it holds, context included, a symbol that occurs
once. A last Spark round verifies the others by the symbols that cover the window,
the words at its ends, and a second hash of all its words. The result is that of
comparing all windows.

All rounds go by chunks, which rows are dealt to evenly: a chunk sends each distinct
name once and gets one bit back, so a name that a third of all documents share is sent
once per chunk, not per occurrence, and copies of a row do not meet in one chunk.
A chunk writes to ``FAN`` buckets, whatever the input. Where more buckets are needed,
so that each fits into a task, names go on by digits: what ``FAN`` chunks sent to one
bucket is merged and dealt to ``FAN`` finer buckets, and answers take the same way
back. A step has at most ``FAN`` rows a chunk, and steps grow with the logarithm of
the input.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helmwind.llm.common import (
    _R,
    _R_INV,
    _powers,
    documents,
    hash_spans,
    mix64,
    shuffle_partitions,
    text_buffer,
    window_hashes,
    word_spans,
)

WIDTH = 35
#: Levels of pairs that Spark rounds settle; the last one is the height of the symbols.
LEVELS = (3, 7)
#: Text of a chunk; a worker holds about forty times as much. Larger chunks send fewer rows.
CHUNK_BYTES = 1 << 20
#: Buckets that a sender of a counting round writes to; names that a bucket of the last step may hold.
FAN, BUCKET_NAMES = 256, 1 << 20
#: Beyond any window.
_FAR = 1 << 40
_RUN, _PAIR = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Symbols:
    """Symbols of one level in order: their names, the words [start, end) they stand for, and the range [low, high) that determines them."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __getitem__(self, at) -> Symbols:
        return Symbols(self.name[at], self.start[at], self.end[at], self.low[at], self.high[at])


def recompress(words: np.ndarray, offsets: np.ndarray, levels: tuple[int, ...] = LEVELS) -> list[Symbols]:
    """Symbols of concatenated documents at each of ``levels``.

    ``offsets`` are the n+1 word offsets of the documents; no symbol spans two. Where
    all words of a symbol's range occur again, the symbol occurs again. What was
    read from the edge of a document gets a range that fits into no window.

    Runs of words are named first. In later rounds equal neighbours share a class and
    stay apart, which keeps the ranges short; they still pair with what follows.
    """
    if not len(words):
        empty = np.zeros(0, np.int64)
        return [Symbols(words, empty, empty, empty, empty)] * len(levels)
    total = len(words)
    first = np.zeros(total + 1, dtype=bool)
    first[offsets] = True
    # Runs: a word or run is known as such by the words on both sides. Symbols cover all words, so each ends where the next starts.
    start = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | first[1:-1]])
    end = np.r_[start[1:], total]
    name, runs = words[start], np.flatnonzero(end - start > 1)
    name[runs] = mix64(name[runs] ^ mix64((end - start)[runs].astype(np.uint64) * _RUN))
    low, high = start - 1 - _FAR * first[start], end + 1 + _FAR * first[end]
    out = []
    for level in range(max(levels)):
        # Pairs: a left symbol and the right symbol after it. The class is a bit of the name, another one at each level.
        right = (name >> np.uint64(level % 64) & np.uint64(1)).astype(bool)
        joins = np.r_[~first[start[1:]], False]  # whether the next symbol is of the same document
        head = joins.copy()
        head[:-1] &= right[1:] & ~right[:-1]
        second = np.r_[False, head[:-1]]
        # A left symbol alone is known by its right neighbour, a right symbol alone by its left one.
        left, after = np.flatnonzero(~right & ~head), np.flatnonzero(right & ~second)
        old_low, old_high = low, high
        low, high = low.copy(), high.copy()
        has = joins[left]
        high[left[~has]] += _FAR
        left = left[has]
        low[left] = np.minimum(old_low[left], old_low[left + 1])
        high[left] = np.maximum(old_high[left], old_high[left + 1])
        has = ~first[start[after]]
        low[after[~has]] -= _FAR
        after = after[has]
        low[after] = np.minimum(old_low[after], old_low[after - 1])
        high[after] = np.maximum(old_high[after], old_high[after - 1])
        pair = np.flatnonzero(head)
        low[pair] = np.minimum(old_low[pair], old_low[pair + 1])
        high[pair] = np.maximum(old_high[pair], old_high[pair + 1])
        name[pair] = mix64(mix64(name[pair] + _PAIR) ^ (name[pair + 1] * _RUN))
        keep = np.flatnonzero(~second)
        name, start, low, high = name[keep], start[keep], low[keep], high[keep]
        if level + 1 in levels:
            out.append(Symbols(name.copy(), start, np.r_[start[1:], total], low, high))
    return out


class Chunk:
    """The texts of one chunk in an order that every read of it agrees on."""

    def __init__(self, table: pa.Table, width: int, levels: tuple[int, ...] = LEVELS):
        self.table = table.sort_by("k").combine_chunks()
        data, offsets = text_buffer(self.table.column("text"))
        self.starts, self.ends, self.offsets = word_spans(data, offsets)
        self.data, self.text_offsets, self.width = data, offsets, width
        self.words = hash_spans(data, self.starts, self.ends)
        # Symbols that fit into a window with their context.
        self.levels = [s[s.high - s.low <= width] for s in recompress(self.words, self.offsets, levels)]
        self.ruled = np.zeros(len(self.words) + 1, dtype=np.int64)
        self.last_once = np.full(len(self.words) + 1, -1, dtype=np.int64)

    def window_starts(self) -> np.ndarray:
        """Whether a window of ``width`` words of one document starts at each word."""
        can = np.zeros(len(self.words), dtype=bool)
        last = self.offsets[1:] - self.width + 1
        mark = np.zeros(len(self.words) + 1, dtype=np.int64)
        has = last > self.offsets[:-1]
        np.add.at(mark, self.offsets[:-1][has], 1)
        np.add.at(mark, last[has], -1)
        can[:] = np.cumsum(mark[:-1]) > 0
        return can

    def asked(self, level: int) -> Symbols:
        """Symbols of a level that stand on no symbol known to occur once."""
        own = self.levels[level]
        return own[self.last_once[own.high] < own.low]

    def settle(self, level: int, recurs: np.ndarray) -> None:
        """Take the answers to :meth:`asked`: which of these symbols occur more than once in the corpus."""
        once = self.asked(level)[~recurs]
        # Windows that hold a symbol that occurs once start in (high - width - 1, low].
        np.add.at(self.ruled, np.maximum(once.high - self.width, 0), 1)
        np.add.at(self.ruled, once.low + 1, -1)
        np.maximum.at(self.last_once, once.high, once.low)
        self.last_once = np.maximum.accumulate(self.last_once)

    def candidates(self) -> np.ndarray:
        """Starts of windows that hold no symbol that occurs once in the corpus."""
        return np.flatnonzero(self.window_starts() & (np.cumsum(self.ruled[:-1]) == 0))

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows at ``at``: of the high-level symbols in it and the words at its ends, and of other hashes of all its words."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        top, to = self.levels[-1], at + self.width
        # Symbols whose range lies in the window are in a row, but for what is known by far context.
        low, high = np.minimum.accumulate(top.low[::-1])[::-1], np.maximum.accumulate(top.high)
        first, last = np.searchsorted(low, at), np.searchsorted(high, to, side="right")
        some = first < last
        i, j = np.minimum(first, max(len(top.name) - 1, 0)), np.maximum(last, 1) - 1
        head = np.where(some, top.start[i], to) if len(top.name) else to
        tail = np.where(some, top.end[j], to) if len(top.name) else to
        words, symbols = Spans(self.words), Spans(top.name)
        key = mix64(words.hashes(at, head) + _RUN) ^ mix64(symbols.hashes(first, np.maximum(first, last)) + _PAIR) ^ words.hashes(tail, to)
        # Other hashes of the words that these windows hold; the windows that start at ``at`` lie in runs of such words.
        held = np.flatnonzero(self.removed(at))
        second = window_hashes(hash_spans(self.data, self.starts[held], self.ends[held], seed=7), self.width)
        return mix64(key), (second[np.searchsorted(held, at)] >> np.uint64(32)).astype(np.uint32)

    def removed(self, repeated: np.ndarray) -> np.ndarray:
        """Words that a window at one of ``repeated`` covers."""
        mark = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.add.at(mark, repeated, 1)
        np.add.at(mark, repeated + self.width, -1)
        return np.cumsum(mark[:-1]) > 0


class Spans:
    """Hashes of runs of any length within one array."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix64(values) * _powers(_R, n)[:n], out=self.sums[1:])
        self.back = _powers(_R_INV, n + 1)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _distinct(hi: np.ndarray, lo: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the names, the first position of each distinct one in it, and the counts."""
    order = np.argsort(hi, kind="stable") if lo is None else np.lexsort((lo, hi))
    new = np.r_[True, hi[order][1:] != hi[order][:-1]] if len(hi) else np.zeros(0, bool)
    if lo is not None and len(hi):
        new[1:] |= lo[order][1:] != lo[order][:-1]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.r_[first, len(hi)])


_REQUEST = pa.schema([("bucket", pa.int64()), ("c", pa.int64()), ("hi", pa.binary()), ("lo", pa.binary()), ("many", pa.binary())])


def _requests(c: int, hi: np.ndarray, lo: np.ndarray | None, buckets: int, many: np.ndarray | None = None) -> pa.Table:
    """Distinct names of a sender, cut into buckets by their high bits, with a bit for names that it holds twice (or that have the bit in ``many``)."""
    order, first, counts = _distinct(hi, lo)
    twice = counts > 1
    if many is not None and len(first):
        twice |= np.maximum.reduceat(many[order], first).astype(bool)
    hi = hi[order][first]
    lo = None if lo is None else lo[order][first]
    bucket = ((hi >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    rows = {k: [] for k in _REQUEST.names}
    for s, e in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(hi)].tolist()):
        if s == e:
            continue
        rows["bucket"].append(int(bucket[s]))
        rows["c"].append(c)
        rows["hi"].append(hi[s:e].tobytes())
        rows["lo"].append(b"" if lo is None else lo[s:e].tobytes())
        rows["many"].append(np.packbits(twice[s:e]).tobytes())
    return pa.table([pa.array(rows[k], t) for k, t in zip(_REQUEST.names, _REQUEST.types)], schema=_REQUEST)


def _opened(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray | None, np.ndarray]:
    """Names of requests in a row: how many each request has, both parts of them, and the bits."""
    his = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hi")]
    los = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("lo")]
    sizes = [len(x) for x in his]
    many = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n) for x, n in zip(table.column("many"), sizes)]
    hi = np.concatenate(his)
    lo = np.concatenate(los) if sum(map(len, los)) else None
    return sizes, hi, lo, np.concatenate(many)


def _bits(table: pa.Table, sizes: list[int], flags: np.ndarray) -> pa.Table:
    """Answers to requests from a bit for each of their names."""
    at = np.r_[0, np.cumsum(sizes)]
    bits = [np.packbits(flags[s:e]).tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
    return pa.table(
        {"c": table.column("c"), "bucket": table.column("bucket"), "n": pa.array(sizes, pa.int64()), "bits": pa.array(bits, pa.binary())}
    )


def _answers(table: pa.Table) -> pa.Table:
    """For each request of a bucket, a bit per name: whether it occurs twice or more in the corpus."""
    sizes, hi, lo, many = _opened(table)
    order, first, counts = _distinct(hi, lo)
    seen = np.maximum.reduceat(many[order], first) | (counts > 1)
    flags = np.zeros(len(hi), dtype=np.uint8)
    flags[order] = np.repeat(seen, counts)
    return _bits(table, sizes, flags)


def _flags(answers: pa.Table, hi: np.ndarray, lo: np.ndarray | None) -> np.ndarray:
    """The answered bit of each name of a chunk."""
    order, first, counts = _distinct(hi, lo)
    if not len(hi):
        return np.zeros(0, dtype=bool)
    answers = answers.sort_by("bucket")
    got = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=n.as_py()) for b, n in zip(answers.column("bits"), answers.column("n"))]
    bits = np.concatenate(got) if got else np.zeros(0, np.uint8)
    if len(bits) != len(first):
        raise RuntimeError("a chunk's answers do not fit its names")
    out = np.zeros(len(hi), dtype=bool)
    out[order] = np.repeat(bits.astype(bool), counts)
    return out


REQUEST_DDL = "bucket long, c long, hi binary, lo binary, many binary"
ANSWER_DDL = "c long, bucket long, n long, bits binary"


def steps_needed(names: int, fan: int = FAN, bucket_names: int = BUCKET_NAMES) -> int:
    """Steps of ``fan`` buckets each after which a bucket holds about ``bucket_names`` of so many names."""
    steps = 1
    while fan**steps * bucket_names < names and fan ** (steps + 1) <= 1 << 32:
        steps += 1
    return steps


def answered(asked: DataFrame, senders: int, steps: int, fan: int = FAN, step: int = 1) -> DataFrame:
    """Answers (``ANSWER_DDL``) to requests (``REQUEST_DDL``) of about ``senders`` values of c, each to ``fan`` buckets by the first digit of its names.

    A step merges what ``fan`` senders sent to one bucket, about as much as one of them
    holds, and sends it on to ``fan`` buckets by the next digit; its answers are dealt
    back to the senders. The last step counts. No requests, no answers.
    """
    if step >= steps:
        return asked.groupBy("bucket").applyInArrow(_answers, ANSWER_DDL)
    groups = -(-senders // fan)

    def merge(table: pa.Table) -> pa.Table:
        _, hi, lo, many = _opened(table)
        return _requests(table.column("g")[0].as_py(), hi, lo, fan ** (step + 1), many)

    def deal(table: pa.Table, answers: pa.Table) -> pa.Table:
        sizes, hi, lo, _ = _opened(table)
        return _bits(table, sizes, _flags(answers, hi, lo))

    routed = asked.withColumn("g", F.pmod("c", F.lit(groups).cast("long"))).groupBy("g", "bucket")
    found = answered(routed.applyInArrow(merge, REQUEST_DDL), groups, steps, fan, step + 1).withColumn("over", F.expr(f"bucket div {fan}"))
    return routed.cogroup(found.groupBy("c", "over")).applyInArrow(deal, ANSWER_DDL)


def repeated_words(
    docs: DataFrame,
    width: int = WIDTH,
    keep_text: bool = False,
    carry: F.Column | None = None,
    chunk_bytes: int = CHUNK_BYTES,
    fan: int = FAN,
    bucket_names: int = BUCKET_NAMES,
) -> DataFrame:
    """Remove each word covered by a window of ``width`` words whose sequence also starts elsewhere.

    ``docs`` has doc_id and text. Returns doc_id, n_words, n_removed and kept_sha256;
    with ``keep_text`` also kept, the remaining words joined by one space or, if
    nothing went, the text as it was; with ``carry``, a struct column, also that. Null
    texts have no words; a text shorter than ``width`` words loses nothing; repeated
    rows remove each other's words; a null doc_id is carried along; a text of any
    length is read whole, in one chunk; an empty table gives an empty result. Other
    columns are ignored. ``docs`` must give its rows in the same order when a task is
    repeated, as a table does.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    carried = carry is not None
    extra = [carry.alias("carried")] if carried else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    chunks = max(4 * n, -(-total // chunk_bytes))
    # Names of a round: a word has about six bytes, and about every second one starts a name or a candidate window.
    steps = steps_needed(total // 12, fan, bucket_names)
    keyed = rows.withColumn("k", F.monotonically_increasing_id()).withColumn("c", F.pmod(F.xxhash64("k"), F.lit(chunks)))
    rounds = len(LEVELS)

    def read(table: pa.Table, answers: pa.Table, upto: int) -> Chunk:
        """A chunk that knows the answers of the first rounds."""
        own = Chunk(table, width)
        kind = answers.column("round").to_numpy()
        for level in range(upto):
            own.settle(level, _flags(answers.filter(pa.array(kind == level)), own.asked(level).name, None))
        return own

    def first(table: pa.Table) -> pa.Table:
        return _requests(table.column("c")[0].as_py(), Chunk(table, width, LEVELS[:1]).asked(0).name, None, fan)

    def ask(level: int):
        def run(table: pa.Table, answers: pa.Table) -> pa.Table:
            if not table.num_rows:
                return _REQUEST.empty_table()
            own = read(table, answers, level)
            names = (own.asked(level).name, None) if level < rounds else own.windows(own.candidates())
            return _requests(table.column("c")[0].as_py(), *names, fan)

        return run

    def final(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = read(table, answers, rounds)
        starts = own.candidates()
        recurs = _flags(answers.filter(pa.array(answers.column("round").to_numpy() == rounds)), *own.windows(starts))
        gone = own.removed(starts[recurs])
        counts = np.r_[0, np.cumsum(gone)]
        raw = own.data.tobytes()
        at, words, sha, kept = own.offsets.tolist(), np.diff(own.offsets), [], []
        for i, (s, e) in enumerate(zip(at[:-1], at[1:])):
            words_of = raw[own.text_offsets[i] : own.text_offsets[i + 1]].split()
            if counts[e] > counts[s]:
                mask = gone[s:e].tolist()
                words_of = [w for w, out in zip(words_of, mask) if not out]
            left = b" ".join(words_of)
            sha.append(hashlib.sha256(left).hexdigest())
            if keep_text:
                whole = raw[own.text_offsets[i] : own.text_offsets[i + 1]]
                kept.append((left if counts[e] > counts[s] else whole).decode("utf-8"))
        columns = {
            "doc_id": own.table.column("doc_id"),
            "n_words": pa.array(words.astype(np.int64)),
            "n_removed": pa.array((counts[own.offsets[1:]] - counts[own.offsets[:-1]]).astype(np.int64)),
            "kept_sha256": pa.array(sha, pa.string()),
        }
        if keep_text:
            columns["kept"] = pa.array(kept, pa.string())
        if carried:
            columns["carried"] = own.table.column("carried")
        return pa.table(columns)

    out = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else ""))
    if carried:
        out.add(rows.schema["carried"])

    # One query: its plan names each exchange of texts and of answers once and reuses it in the later rounds.
    asked, known = keyed.groupBy("c").applyInArrow(first, REQUEST_DDL), None
    for level in range(rounds + 1):
        if level:
            asked = keyed.groupBy("c").cogroup(known.groupBy("c")).applyInArrow(ask(level), REQUEST_DDL)
        answers = answered(asked, chunks, steps, fan).withColumn("round", F.lit(level))
        known = answers if known is None else known.unionByName(answers)
    return keyed.groupBy("c").cogroup(known.groupBy("c")).applyInArrow(final, out)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return repeated_words(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated passages removed: words kept, joined by one space where any were removed.

    Texts that lose nothing stay as they are. n_chars follows the text. The other
    columns travel with the text through the operator, so nothing is joined back, and
    may have any names. Nulls stay null, rows without doc_id and repeated rows are
    documents like others, an empty table stays empty. Texts are read whole; a very long
    one is one row of one task, which needs about forty times its bytes.
    """
    kind = docs.schema["text"].dataType
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
    found = repeated_words(docs, keep_text=True, carry=F.struct(F.col("text").isNull().alias("no_text"), *others))
    cut = F.col("n_removed") > 0
    columns = []
    for i, c in enumerate(docs.columns):
        own = F.col(f"carried.c{i}")
        if c == "text":
            own = F.when(cut | ~F.col("carried.no_text"), F.col("kept")).cast(kind)
        elif c == "n_chars":
            own = F.when(cut, F.char_length("kept").cast(docs.schema[c].dataType)).otherwise(own)
        columns.append(own.alias(c))
    return found.select(columns)
