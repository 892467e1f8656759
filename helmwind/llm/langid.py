"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays.

Characters are lower-cased letters; anything else is one blank, runs of blanks
are one. Spark counts the n-grams of the training documents and fits all orders by
grouping and joining, one row per language and n-gram. The models live in arrays
sorted by n-gram hash with a column for each language of a block, so one binary
search serves a block. The language with the lowest cross-entropy per character
wins. A document is rejected when its cross-entropy with each character in its best
language, so that texts in several known languages stay, is beyond what held-back
documents show.

Every value of lang is learned. Models are scored in groups of languages whose n-grams
fit into ``GROUP_ROWS``: one group as a rule, else a pass over the documents for each,
which carries a document's best language so far, the sum of likelihoods and each
character's best. So what the driver builds and tasks hold at a time is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helmwind.llm.common import discard, documents, fold, materialise, shuffle_partitions, slices

ORDER = 4
#: Training documents drawn for a language by a hash of doc_id, at most about so many and so many bytes of text (one document may be longer).
DOCS_PER_LANGUAGE, LANGUAGE_BYTES = 1500, 6 << 20
#: Rows of ``LEVEL_DDL`` whose languages share one pass over the documents; a language is never split.
GROUP_ROWS = 6_000_000
#: Every so-many-th drawn document calibrates the rejection instead of being counted.
CALIBRATION_EVERY = 6
#: Languages that share sorted arrays; numbers (characters times languages) that one scoring step holds.
LANGUAGE_BLOCK, STEP = 8, 1 << 20
#: Texts of fewer letters are not rejected for their cross-entropy.
REJECT_LETTERS = 40
REJECT_QUANTILE, REJECT_MARGIN = 0.999, 1.5
#: A short text may exceed the limit by so much over the root of its letters: one odd token weighs more there.
REJECT_SPREAD = 4.0
UNKNOWN = "und"

_BLANK = 0x20
_BASE = 0xC6BC279692B5CC83


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-case letter of each character of the basic plane, or the blank."""
    out = np.full(0x10000, _BLANK, dtype=np.uint32)
    for code in range(0x10000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised characters of all texts, the row of each, and the number of letters of each row."""
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    row = np.repeat(np.arange(len(texts)), size)
    low = _letters()[np.minimum(codes, 0xFFFF)]
    far = np.flatnonzero(codes > 0xFFFF)
    if len(far):
        low[far] = [c if chr(c).isalpha() else _BLANK for c in codes[far].tolist()]
    blank = low == _BLANK
    letters = np.bincount(row[~blank], minlength=len(texts))
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1] & (row[1:] == row[:-1])
    return low[keep].astype(np.uint64), row[keep], letters


def gram_hashes(chars: np.ndarray, row: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """Hashes of the 1..order-grams that end at each character; a text starts after blanks."""
    out, power = [chars], 1
    for back in range(1, order):
        power = power * _BASE & (1 << 64) - 1
        before = np.full(len(chars), _BLANK, dtype=np.uint64)
        inside = np.zeros(len(chars), dtype=bool)
        inside[back:] = row[back:] == row[:-back]
        before[back:][inside[back:]] = chars[:-back][inside[back:]]
        out.append(out[-1] + before * np.uint64(power))
    return out


#: Grams of an order: language, order, gram, its suffix and context as hashes, log-probability, the context's log-weight.
LEVEL_DDL = "lang string, k int, gram long, suffix long, context long, logp double, logw double"


class KneserNey:
    """Interpolated models of a group of languages over sorted arrays, from rows of ``LEVEL_DDL``; ``known`` characters occur in all groups."""

    def __init__(self, levels: pa.Table, order: int = ORDER, block: int = LANGUAGE_BLOCK, known: int | None = None):
        rows = {name: levels.column(name).to_numpy() for name in ("k", "logp", "logw")}
        rows |= {name: levels.column(name).to_numpy().view(np.uint64) for name in ("gram", "suffix", "context")}
        names = np.array(levels.column("lang").to_pylist(), dtype=object)
        self.languages = sorted(set(names.tolist()))
        self.order = order
        known = len(np.unique(rows["gram"][rows["k"] == 1])) if known is None else known
        self.floor = np.float32(-np.log(known + 1))
        self.blocks = []
        for at in range(0, len(self.languages), block):
            place = {x: i for i, x in enumerate(self.languages[at : at + block])}
            column = np.array([place.get(x, -1) for x in names.tolist()])
            tables: list[tuple] = []
            for k in range(1, order + 1):
                own = np.flatnonzero((rows["k"] == k) & (column >= 0))
                keys, first = np.unique(rows["gram"][own], return_index=True)
                contexts = np.unique(rows["context"][own])
                weights = np.zeros((len(contexts), len(place)), np.float32)
                weights[np.searchsorted(contexts, rows["context"][own]), column[own]] = rows["logw"][own]
                # A language without the gram backs off: its weight of the context, and its probability of the suffix.
                values = weights[np.searchsorted(contexts, rows["context"][own][first])]
                values = values + (tables[-1][1][np.searchsorted(tables[-1][0], rows["suffix"][own][first])] if tables else self.floor)
                values[np.searchsorted(keys, rows["gram"][own]), column[own]] = rows["logp"][own]
                tables.append((keys, values.astype(np.float32), contexts, weights))
            self.blocks.append(tables)

    def log_probabilities(self, grams: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Log-probability, by language, of the characters at ``at``."""
        return np.concatenate([self._block(tables, grams, at) for tables in self.blocks], axis=1)

    def _block(self, tables: list[tuple], grams: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), tables[0][1].shape[1]), dtype=np.float32)
        rest = np.arange(len(at))
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        for k in range(len(tables) - 1, -1, -1):
            keys, values, contexts, weights = tables[k]
            want = grams[k][at[rest]]
            place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[place] == want
            out[rest[hit]] += values[place[hit]]
            rest, want = rest[~hit], want[~hit]
            if not len(rest):
                return out
            # The context's hash: drop the last character and shift.
            context = (want - grams[0][at[rest]]) * inverse
            place = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            hit = contexts[place] == context
            out[rest[hit]] += weights[place[hit]]
        out[rest] += self.floor
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nats per character by text and language, the log-probability of each character in its best language, their row, and letters by text."""
        chars, row, letters = characters(texts)
        total, top = np.zeros((len(texts), len(self.languages))), np.zeros(len(chars), np.float32)
        step = max(256, STEP // len(self.languages))
        if len(chars):
            grams = gram_hashes(chars, row, self.order)
            for s in range(0, len(chars), step):
                at = np.arange(s, min(len(chars), s + step))
                logs = self.log_probabilities(grams, at)
                rows = row[at]
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                total[rows[first]] += np.add.reduceat(logs, first, axis=0, dtype=np.float64)
                top[at] = logs.max(axis=1)
        length = np.maximum(np.bincount(row, minlength=len(texts)), 1)
        return -total / length[:, None], top, row, letters


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """Rows of ``LEVEL_DDL`` from (lang, gram binary of ``order`` int32 characters, n).

    Orders below the highest count distinct left neighbours. The discount of a
    language and order is that of Kneser and Ney, n1 / (n1 + 2 n2), within 0.1 and
    0.9. The order below the first is uniform over all characters and an unknown one.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(batch.column(1).to_pylist())
            window = np.frombuffer(raw, np.int32).reshape(batch.num_rows, order).astype(np.uint64)
            # suffixes[k]: hash of the last k characters; contexts[k]: of the k before the last one.
            suffixes, contexts = [np.zeros(len(window), np.uint64)], [np.zeros(len(window), np.uint64)]
            for back in range(order):
                suffixes.append(suffixes[-1] + window[:, order - 1 - back] * np.uint64(pow(_BASE, back, 1 << 64)))
            for back in range(order - 1):
                contexts.append(contexts[-1] + window[:, order - 2 - back] * np.uint64(pow(_BASE, back, 1 << 64)))
            columns = [batch.column(0), batch.column(2), *(pa.array(x.view(np.int64)) for x in (*suffixes[1:], *contexts))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["lang", "n", *(f"g{k}" for k in range(1, order + 1)), *(f"x{k}" for k in range(order))]
    grams = counts.select("lang", "gram", "n").mapInArrow(coded, "lang string, n long, " + ", ".join(f"{x} long" for x in names[2:]))
    grams = materialise(grams, "langid-grams")
    unknown = grams.agg(F.count_distinct("g1")).head()[0] + 1
    levels: DataFrame | None = None
    below = None
    for k in range(1, order + 1):
        keys = ["lang", *(f"g{i}" for i in range(max(k - 1, 1), k + 1)), f"x{k - 1}"]
        if k == order:
            own = grams.groupBy(*keys).agg(F.sum("n").alias("c"))
        else:
            own = grams.select(*keys, f"g{k + 1}").distinct().groupBy(*keys).agg(F.count("*").alias("c"))
        suffix = F.col(f"g{k - 1}") if k > 1 else F.lit(0).cast("long")
        own = own.select("lang", F.col(f"g{k}").alias("gram"), suffix.alias("suffix"), F.col(f"x{k - 1}").alias("context"), "c")
        ones, twos = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
        kept = F.least(F.greatest(ones / F.greatest(ones + 2 * twos, F.lit(1)), F.lit(0.1)), F.lit(0.9))
        discount = own.groupBy("lang").agg(kept.alias("d"))
        total = own.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
        joined = own.join(total, ["lang", "context"]).join(discount, "lang")
        weight = F.col("d") * F.col("kinds") / F.col("total")
        if below is None:
            lower = F.lit(1.0 / unknown)
        else:
            joined = joined.join(below.select("lang", F.col("gram").alias("suffix"), F.exp("logp").alias("lower")), ["lang", "suffix"])
            lower = F.col("lower")
        p = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + weight * lower
        made = joined.select("lang", F.lit(k).alias("k"), "gram", "suffix", "context", F.ln(p).alias("logp"), F.ln(weight).alias("logw"))
        below = materialise(made, f"langid-level{k}")
        levels = below if levels is None else levels.unionByName(below)
    return levels


def gram_code(gram: tuple[int, ...]) -> int:
    """The hash that :func:`gram_hashes` gives to these characters."""
    return sum(c * pow(_BASE, back, 1 << 64) for back, c in enumerate(reversed(gram))) & (1 << 64) - 1


def distinct_grams(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a table of characters and their counts; rows are packed into one number where they fit."""
    letters = np.unique(window)
    if len(letters) ** window.shape[1] >= 1 << 63:
        return np.unique(window, axis=0, return_counts=True)
    packed = np.zeros(len(window), dtype=np.int64)
    for column in np.searchsorted(letters, window).T:
        packed = packed * len(letters) + column
    keys, counts = np.unique(packed, return_counts=True)
    rows = np.empty((len(keys), window.shape[1]), dtype=window.dtype)
    for place in range(window.shape[1] - 1, -1, -1):
        keys, at = np.divmod(keys, max(len(letters), 1))
        rows[:, place] = letters[at] if len(letters) else 0
    return rows, counts


def train_sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame | None:
    """(lang, text, calibrate) of the documents to learn from, written to the shared folder; None where there are none.

    A language takes its drawn documents in the order of a hash, long ones (a sixteenth of
    ``LANGUAGE_BYTES``) after the others, until the bytes are full; the first one comes in any case.
    """
    usable = docs.where((fold() != 2) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).withColumn("lang", F.col("lang").cast("string"))
    counts = materialise(usable.groupBy("lang").agg(F.count("*").alias("docs")), "langid-languages")  # counted without reading texts
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    calibrate = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(12)), F.lit(CALIBRATION_EVERY)) == 0
    drawn = usable.select("lang", "text", "doc_id").where(F.col("text").isNotNull()).join(counts, "lang")
    drawn = drawn.where((unit < F.lit(float(max(1, per_language))) / F.col("docs")) | (F.col("docs") <= per_language))
    size = F.octet_length(F.col("text").cast("string"))
    row = F.monotonically_increasing_id()
    wide = drawn.select("lang", F.col("text").cast("string").alias("text"), "doc_id", calibrate.alias("calibrate"), size.alias("size"))
    wide = materialise(wide.repartition(shuffle_partitions(docs.sparkSession)).withColumn("row", row), "langid-drawn")
    turn = Window.partitionBy("lang").orderBy(F.col("size") > LANGUAGE_BYTES // 16, F.xxhash64("doc_id", F.lit(11)), "doc_id", "row")
    taken = wide.select("lang", "row", F.sum("size").over(turn.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(turn).alias("at"))
    taken = taken.where((F.col("upto") <= LANGUAGE_BYTES) | (F.col("at") == 1)).select("row")
    sample = materialise(wide.join(taken, "row").select("lang", "text", "calibrate"), "langid-sample")
    discard(wide)
    return sample if sample.head() else None


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) of the n-grams of the highest order in (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for s, e in slices(batch.column(1)):
                texts = batch.column(1).slice(s, e - s).to_pylist()
                chars, row, _ = characters(texts)
                window = np.full((len(chars), ORDER), _BLANK, dtype=np.int32)
                window[:, ORDER - 1] = chars
                for back in range(1, ORDER):
                    inside = np.flatnonzero(row[back:] == row[:-back]) + back
                    window[inside, ORDER - 1 - back] = chars[inside - back]
                for lang in sorted(set(langs[s:e])):
                    grams, n = distinct_grams(window[np.isin(row, np.flatnonzero(langs[s:e] == lang))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n), pa.string()), pa.array([g.tobytes() for g in grams], pa.binary()), pa.array(n, pa.int64())],
                        names=["lang", "gram", "n"],
                    )

    found = sample.select("lang", "text").mapInArrow(count, "lang string, gram binary, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def language_groups(rows: list[tuple[str, int]], group_rows: int) -> list[tuple[str, str]]:
    """First and last language of each group of (language, rows in order of names) with at most ``group_rows`` rows, or one language."""
    groups, held = [], 0
    for lang, n in rows:
        if groups and held + n <= group_rows:
            groups[-1], held = (groups[-1][0], lang), held + n
        else:
            groups, held = [*groups, (lang, lang)], n
    return groups


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, group_rows: int = GROUP_ROWS) -> tuple[list[Broadcast], float]:
    """Models of all languages in groups, and the cross-entropy, each character in its best language, beyond which a text is rejected.

    The driver holds the names of the languages and builds and broadcasts the arrays of one group at a time.
    """
    spark = docs.sparkSession
    sample = train_sample(docs, per_language)
    if sample is None:
        return [], math.inf
    levels = materialise(kneser_ney(gram_counts(sample.where("not calibrate"))), "langid-models")
    known = levels.where("k = 1").agg(F.count_distinct("gram")).head()[0]
    models = []
    for first, last in language_groups([tuple(r) for r in levels.groupBy("lang").count().orderBy("lang").collect()], group_rows):
        model = KneserNey(levels.where(F.col("lang").between(first, last)).toArrow(), known=known)
        models.append(spark.sparkContext.broadcast(model))
    edge = scored(sample.where("calibrate"), models, []).where(F.col("letters") >= REJECT_LETTERS)
    found = edge.agg(F.percentile("mixed", F.lit(REJECT_QUANTILE)).alias("q")).head()
    return models, math.inf if found.q is None else found.q * REJECT_MARGIN


#: A document's best language and its cross-entropy, likelihoods of all languages over that of the best, cross-entropy in best languages, letters.
SCORE_DDL = "lang_best string, least double, total double, mixed double, letters long"


def scored(docs: DataFrame, models: list[Broadcast], carry: list[str]) -> DataFrame:
    """``carry`` columns of ``docs`` and ``SCORE_DDL``; a pass for each group of models, tables of the shared folder between them."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = "".join(f"`{c}` {fields[c]}, " for c in carry) + SCORE_DDL
    state = docs.select(*carry, F.col("text").cast("string").alias("__text"))
    for turn, shared in enumerate(models):
        last = turn == len(models) - 1
        step = _pass(shared, len(carry), turn == 0, last)
        state = state.mapInArrow(step, schema + ("" if last else ", `__top` binary, `__text` string"))
        if not last:
            state = materialise(state, "langid-pass")
    if not models:
        none = "cast(null as string) lang_best, 0D least, 1D total, 0D mixed, 0L letters"
        state = state.select(*carry, *(F.expr(x) for x in none.split(", ")))
    return state


def _pass(shared: Broadcast, carried: int, first: bool, last: bool):
    """One group's pass: columns of the carry, then (after the first group) the state so far, then the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for s, e in slices(whole.column(whole.num_columns - 1)):
                batch = whole.slice(s, e - s)
                texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                entropy, top, row, letters = own.cross_entropy(texts)
                best = entropy.argmin(axis=1)
                least = entropy[np.arange(len(texts)), best]
                length = np.minimum(letters, 60)
                total = np.exp(-(entropy - least[:, None]) * length[:, None]).sum(axis=1)
                names = [own.languages[b] for b in best.tolist()]
                if not first:
                    before, old_least, old_total = (batch.column(carried + i) for i in range(3))
                    old_least, old_total = old_least.to_numpy(), old_total.to_numpy()
                    # Earlier groups have the lesser names, which win ties.
                    stays, low = old_least <= least, np.minimum(old_least, least)
                    total = total * np.exp(-(least - low) * length) + old_total * np.exp(-(old_least - low) * length)
                    names, least = [b if x else a for a, b, x in zip(names, before.to_pylist(), stays.tolist())], low
                    top = np.maximum(top, np.frombuffer(b"".join(batch.column(carried + 5).to_pylist()), np.float32))
                size = np.bincount(row, minlength=len(texts))
                mixed = -np.bincount(row, weights=top, minlength=len(texts)) / np.maximum(size, 1)
                columns = [*batch.columns[:carried], pa.array(names, pa.string()), *map(pa.array, (least, total, mixed, letters.astype(np.int64)))]
                if not last:
                    tops = np.split(top, np.cumsum(size)[:-1])
                    columns += [pa.array([x.tobytes() for x in tops], pa.binary()), batch.column(batch.num_columns - 1)]
                names_out = [*batch.schema.names[:carried], *(x.split()[0] for x in SCORE_DDL.split(", "))]
                yield pa.RecordBatch.from_arrays(columns, names=names_out if last else [*names_out, "__top", "__text"])

    return run


def identify(docs: DataFrame, models: list[Broadcast], limit: float, carry: list[str]) -> DataFrame:
    """``carry`` columns of ``docs`` (names of their own), lang_pred, score and accepted.

    ``score`` is the winner's share of the languages' likelihoods at a fixed length;
    null texts, texts without a letter and no models give ``und``, 0 and not
    accepted. Of equally likely languages the first by name wins. Texts are read whole;
    repeated rows are judged each; an empty table gives an empty result.
    """
    letters = F.col("letters")
    allowed = F.lit(float(limit)) * (1 + REJECT_SPREAD / F.sqrt(F.greatest(letters, F.lit(1))))
    return scored(docs, models, carry).select(
        *carry,
        F.when(letters > 0, F.col("lang_best")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(letters > 0, 1 / F.col("total")).otherwise(0.0).alias("score"),
        ((letters > 0) & ((letters < REJECT_LETTERS) | (F.col("mixed") <= allowed))).alias("accepted"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of every document."""
    docs = documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = identify(docs, *train(docs), carry=["doc_id"])
    return found.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted, as they are.

    Null texts and texts without a letter are not accepted, nor is anything where
    nothing could be learned; repeated rows are judged alike; texts are read whole;
    an empty table stays empty; columns may have any names.
    """
    inner = docs.select([F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = docs.columns.index("text")
    found = identify(inner.withColumn("text", F.col(f"c{at}")), *train(docs), carry=inner.columns)
    return found.where("accepted").select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
