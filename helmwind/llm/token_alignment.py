"""Alignment of two tokenizers over a corpus: postings of token pairs, cogrouped by the id of one side.

A and B cut the same bytes, so the union of their ends cuts a text into pieces that
lie in one A and one B token each: these are the links, and the ends that both have
close the groups. A slice of documents gives, for each B id, the A ids linked with
it and for each such pair the documents and multiplicities (its postings). Pair
counts are summed in Spark. Counts and postings meet by B id in sorted streams that
spill: the counts of an id come first (at most one for each A id), give its highest
count, and then its postings pass by and leave what they add to their documents. Ids
with many postings are dealt to several tasks, each of which gets the counts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helmwind.llm.common import documents, materialise, shuffle_partitions, slices

SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
MAX_VOCABULARY_BYTES = 16 << 20
#: Bytes of text and documents of a slice; bounds a worker's memory, but for a longer single text.
SLICE_TEXT, SLICE_DOCS = 3 << 20, 32_000
#: Segments of B that a worker remembers, and the characters of the longest.
REMEMBERED, REMEMBERED_CHARS = 300_000, 64
#: Document contributions that a worker sums up before it hands them on.
PENDING = 1 << 20
#: Bytes of postings of one id that a task takes.
POSTING_BYTES = 32 << 20
#: Texts of these characters are split alike by all Unicode versions; others go through the slower library of A.
_STABLE = re.compile("[\t\n\r -~\xa1-\xac\xae-ɏ‐-‧]*")
#: Runs of one kind beyond this go through the library whose merges take n log n steps.
_LONG_RUN = 4096
_SEGMENT = re.compile(" +[^ ]*")

_TABLE = (
    "is_doc boolean, slice long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "b int, a array<int>, total array<long>, docs_of_a binary, docs binary, times binary"
)


def byte_characters() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class SideA:
    """Byte-level BPE of a tokenizers file; special tokens' strings are plain text."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        special = {t["id"] for t in spec.get("added_tokens", ())}
        characters = byte_characters()
        ranks = {bytes(characters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if i not in special}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_str(blob.decode("utf-8"))
        self.exact.encode_special_tokens = True
        self.token_bytes = {i: token for token, i in ranks.items()}
        self.length = np.zeros(max(spec["model"]["vocab"].values()) + 1, dtype=np.int64)
        self.length[list(self.token_bytes)] = [len(token) for token in self.token_bytes.values()]

    def encode(self, text: str) -> np.ndarray | None:
        """Ids of a text; None if their bytes are not the text's."""
        if _STABLE.fullmatch(text) and not (len(text) > _LONG_RUN and max(map(len, re.findall(r"\S+|\s+", text))) > _LONG_RUN):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        ids = self.exact.encode(text, add_special_tokens=False).ids
        if b"".join([self.token_bytes.get(i, b"") for i in ids]) != text.encode("utf-8"):
            return None
        return np.array(ids, dtype=np.int64)


class SideB:
    """A sentencepiece model with byte fallback, of which no piece has a space after another character.

    Its merges then stay within a run of spaces and what follows up to the next one, so
    that such segments can be encoded by themselves and remembered.
    """

    def __init__(self, blob: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.by_segment = not any("▁" in p.lstrip("▁") for p in pieces)
        self.token_bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)
        ]
        self.length = np.array([len(b) for b in self.token_bytes], dtype=np.int64)
        self.space = self.model.piece_to_id("▁")
        self.known: dict[str, bytes | None] = {}

    def _checked(self, segment: str, ids: list[int]) -> bytes | None:
        same = b"".join([self.token_bytes[i] for i in ids]) == segment.encode("utf-8")
        return np.array(ids, dtype="<u4").tobytes() if same else None

    def _learn(self, segments: list[str]) -> dict[str, bytes | None]:
        """Ids of segments; all are compared with their text at once, one by one only where some differ."""
        found = self.model.encode([s[1:] for s in segments], num_threads=1)
        found = [ids if len(s) > 1 else [self.space] for s, ids in zip(segments, found)]
        flat = list(chain.from_iterable(found))
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        data = [s.encode("utf-8") for s in segments]
        reached = np.concatenate([[0], np.cumsum(self.length[flat])])[ends]
        told = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        if not np.array_equal(reached, told) or b"".join(map(self.token_bytes.__getitem__, flat)) != b"".join(data):
            return {s: self._checked(s, ids) for s, ids in zip(segments, found)}
        blob, at = np.array(flat, dtype="<u4").tobytes(), [0, *(4 * ends).tolist()]
        return {s: blob[low:high] for s, low, high in zip(segments, at, at[1:])}

    def encode(self, text: str) -> np.ndarray | None:
        """Ids of a text that begins with the space that the model adds; None if their bytes are not the text's."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text, as :meth:`encode`; what no text before had is encoded once for all of them."""
        if not self.by_segment:
            found = [self._checked(text, self.model.encode(text[1:], num_threads=1)) for text in texts]
        else:
            parts, known = list(map(_SEGMENT.findall, texts)), self.known
            wanted = set().union(*parts)
            new = wanted.difference(known)
            if len(known) + len(new) > REMEMBERED:
                held = {p: known[p] for p in wanted - new}
                known.clear()
                known.update(held)
            if new:
                known.update(self._learn(list(new)))
            found = [list(map(known.__getitem__, x)) for x in parts]
            found = [None if None in x else b"".join(x) for x in found]
            for p in new:
                if len(p) > REMEMBERED_CHARS:
                    del known[p]
        return [None if x is None else np.frombuffer(x, dtype="<u4").astype(np.int64) for x in found]


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers up to ``most`` with a place for a separator behind, and which places count."""
    width = len(str(most))
    numbers = np.arange(most + 1)
    places = numbers[:, None] // 10 ** np.arange(width - 1, -1, -1)
    live = places > 0
    live[:, -1] = True
    text = np.concatenate([(places % 10 + 48).astype(np.uint8), np.zeros((most + 1, 1), np.uint8)], axis=1)
    return text, np.concatenate([live, np.ones((most + 1, 1), bool)], axis=1)


def group_digests(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, doc_of_group: np.ndarray, n_docs: int, digits) -> list[str]:
    """SHA-256 of each document's groups, ``a1,a2|b1;a3|b2,b3``; '' without tokens.

    group_a and group_b number the groups of the tokens from 0, rising.
    """
    n = len(doc_of_group)
    before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n))])
    through_a = np.cumsum(np.bincount(group_a, minlength=n))
    ids = np.empty(len(a) + len(b), dtype=np.int64)
    mark = np.full(len(ids), ord(","), dtype=np.uint8)
    place_a = np.arange(len(a)) + before_b[group_a]
    place_b = np.arange(len(b)) + through_a[group_b]
    ids[place_a], ids[place_b] = a, b
    mark[place_a[through_a - 1]] = ord("|")
    mark[place_b[before_b[1:] - 1]] = ord(";")
    text, live = digits[0][ids], digits[1][ids]
    text[:, -1] = mark
    flat = text[live]
    ends = np.cumsum(live.sum(axis=1))[place_b[before_b[1:] - 1]]  # of each group
    last = np.searchsorted(doc_of_group, np.arange(n_docs), side="right") - 1
    out, view, at = [], memoryview(np.ascontiguousarray(flat)), 0
    for doc, group in enumerate(last.tolist()):
        if group < 0 or doc_of_group[group] != doc:
            out.append("")
            continue
        out.append(hashlib.sha256(view[at : int(ends[group]) - 1]).hexdigest())
        at = int(ends[group])
    return out


def _ends_before(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the marked bytes come before each of ``at``."""
    return np.cumsum(ends, dtype=np.int64)[at] - ends[at]


class Aligner:
    def __init__(self, blob_a: bytes, blob_b: bytes):
        self.a, self.b = SideA(blob_a), SideB(blob_b)
        self.bits = int(len(self.a.length)).bit_length()
        self.digits = _digits(max(len(self.a.length), len(self.b.length)))

    def align(self, texts: list[str | None]) -> tuple[dict, tuple]:
        """Counts and digests of each text, and the links of all: (document, B id, A id) as one number, rising, with its multiplicity."""
        ids_a, ids_b, n_a, n_b = [], [], [], []
        spaced = [f" {text}" for text in texts if text]
        all_b = iter(self.b.encode_all(spaced))
        all_a = map(self.a.encode, spaced)
        for text in texts:
            a, b = (next(all_a), next(all_b)) if text else (None, None)
            if a is not None and b is not None and self.a.length[a].sum() == self.b.length[b].sum():
                ids_a.append(a)
                ids_b.append(b)
            else:
                a = b = ()
            n_a.append(len(a))
            n_b.append(len(b))
        n = len(texts)
        none = np.zeros(0, np.int64)
        a, b = (np.concatenate(x) if x else none for x in (ids_a, ids_b))
        n_a, n_b = np.array(n_a, dtype=np.int64), np.array(n_b, dtype=np.int64)
        doc_a = np.repeat(np.arange(n), n_a)
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        # Where both end; the totals of a document's bytes agree, so documents end in both.
        is_a, is_b = (np.zeros(int(end_a[-1]) + 1 if len(a) else 1, dtype=bool) for _ in range(2))
        is_a[end_a], is_b[end_b] = True, True
        is_common = is_a & is_b
        doc_of_group = doc_a[is_common[end_a]]
        cuts = np.flatnonzero(is_a | is_b)
        of_a, of_b = _ends_before(is_a, cuts), _ends_before(is_b, cuts)
        if len(cuts):
            pair = (doc_a[of_a] << (2 * self.bits)) | (b[of_b] << self.bits) | a[of_a]
            pair.sort()
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            pairs, times = pair[first], np.diff(np.append(first, len(pair)))
        else:
            pairs, times = none, none
        n_groups = np.bincount(doc_of_group, minlength=n)
        digests = [""] * n
        if len(a):
            groups = (_ends_before(is_common, end_a), _ends_before(is_common, end_b))
            digests = group_digests(a, b, *groups, doc_of_group, n, self.digits)
        counts = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups, "groups_sha256": digests}
        return counts, (pairs, times)

    def postings(self, pairs: np.ndarray, times: np.ndarray) -> dict[str, pa.Array]:
        """A row for each B id: its A ids with their links in these documents, and the documents and multiplicities of each."""
        low = (1 << self.bits) - 1
        doc, key = pairs >> (2 * self.bits), pairs & ((1 << (2 * self.bits)) - 1)
        order = np.argsort(key, kind="stable")
        key, doc, times = key[order], doc[order], times[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        key, counts = key[starts], np.diff(np.append(starts, len(doc)))
        totals = np.add.reduceat(times, starts) if len(starts) else np.zeros(0, np.int64)
        b = key >> self.bits
        rows = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        edges = np.append(rows, len(b))
        posting = np.append(starts, len(doc))[edges]

        def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))

        def blobs(values: np.ndarray, kind: str, at: np.ndarray) -> pa.Array:
            data = values.astype(kind)
            offsets = (at * data.itemsize).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])

        return {
            "b": pa.array(b[rows], pa.int32()),
            "a": lists(key & low, pa.int32()),
            "total": lists(totals, pa.int64()),
            "docs_of_a": blobs(counts, "<u2", edges),
            "docs": blobs(doc, "<u2", posting),
            "times": blobs(times, "<u4", posting),
        }


def _table(docs: DataFrame, blob_a: bytes, blob_b: bytes) -> DataFrame:
    """Rows of documents and rows of postings, slice by slice."""
    shared = docs.sparkSession.sparkContext.broadcast((blob_a, blob_b))
    names = [part.split()[0] for part in _TABLE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value)

        def batch(n: int, schema: pa.Schema, **columns) -> pa.RecordBatch:
            made = [columns[name].cast(field.type) if name in columns else pa.nulls(n, field.type) for name, field in zip(names, schema)]
            return pa.RecordBatch.from_arrays(made, names=names)

        lists = (pa.list_(pa.int32()), pa.list_(pa.int64()))
        kinds = [pa.bool_(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int32(), *lists, *[pa.binary()] * 3]
        schema = pa.schema(list(zip(names, kinds)))
        for whole in batches:
            texts = whole.column(2)
            for low, high in slices(texts, SLICE_TEXT):
                for at in range(low, high, SLICE_DOCS):
                    part = whole.slice(at, min(high, at + SLICE_DOCS) - at)
                    counts, (pairs, times) = aligner.align(part.column(2).to_pylist())
                    n, number = part.num_rows, part.column(0)[0].as_py()
                    same = pa.array(np.full(n, number))
                    of_docs = {k: pa.array(v) for k, v in counts.items()}
                    yield batch(n, schema, is_doc=pa.array([True] * n), slice=same, place=pa.array(range(n)), doc_id=part.column(1), **of_docs)
                    rows = aligner.postings(pairs, times)
                    m = len(rows["b"])
                    yield batch(m, schema, is_doc=pa.array([False] * m, pa.bool_()), slice=pa.array(np.full(m, number)), **rows)

    text = F.col("text").cast("string")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return numbered.mapInArrow(run, _TABLE)


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    """The values of a binary column, all rows on end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, kind)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)


class _Pending:
    """Contributions to (slice, place), summed until there are many."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, number: np.ndarray, place: np.ndarray, best: np.ndarray, total: np.ndarray) -> bool:
        """Whether it is time to hand them on."""
        self.parts.append(self._summed(number, place, best, total))
        self.size += len(self.parts[-1][0])
        if self.size > 2 * PENDING:
            self.parts = [self._summed(*(np.concatenate(x) for x in zip(*self.parts)))]
            self.size = len(self.parts[0][0])
        return self.size > PENDING

    @staticmethod
    def _summed(number, place, best, total):
        order = np.lexsort((place, number))
        number, place, best, total = (x[order] for x in (number, place, best, total))
        starts = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (place[1:] != place[:-1])])) if len(number) else np.zeros(0, int)
        if not len(starts):
            return number, place, best, total
        return number[starts], place[starts], np.add.reduceat(best, starts), np.add.reduceat(total, starts)

    def take(self) -> pa.RecordBatch | None:
        """A row for each slice."""
        if not self.parts:
            return None
        number, place, best, total = self._summed(*(np.concatenate(x) for x in zip(*self.parts)))
        self.parts, self.size = [], 0
        cuts = np.append(np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])), len(number)) if len(number) else np.zeros(1, int)
        rows = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        blobs = [pa.array([x[s:e].astype(kind).tobytes() for s, e in rows], pa.binary()) for x, kind in ((place, "<u2"), (best, "<i8"), (total, "<i8"))]
        return pa.RecordBatch.from_arrays([pa.array(number[cuts[:-1]], pa.int64()), *blobs], names=["slice", "places", "best", "total"])


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (b, part, counted, slice, a, total, docs_of_a, docs, times) in order: the counts of an id, then its postings."""
    pending, key, count, top = _Pending(), *(np.zeros(0, np.int64) for _ in range(3))
    for batch in batches:
        if not batch.num_rows:
            continue
        b = batch.column("b").to_numpy().astype(np.int64)
        counted = batch.column("counted").to_numpy(zero_copy_only=False)
        # The counts that this batch needs: of its ids, and of the last id before it.
        rows = batch.filter(pa.array(counted))
        if rows.num_rows:
            sizes = np.diff(rows.column("a").offsets.to_numpy())
            own, own_count = rows.column("a").flatten().to_numpy().astype(np.int64), rows.column("total").flatten().to_numpy()
            own_key = np.repeat(b[counted], sizes) << 32 | own
            tops = np.repeat(np.maximum.reduceat(own_count, np.concatenate([[0], np.cumsum(sizes)[:-1]])), sizes)
            key, count, top = (np.concatenate(x) for x in ((key, own_key), (count, own_count), (top, tops)))
            key, keep = np.unique(key, return_index=True)  # a later part of an id repeats its counts
            count, top = count[keep], top[keep]
        rows = batch.filter(pa.array(~counted))
        if rows.num_rows:
            sizes = np.diff(rows.column("a").offsets.to_numpy())
            wanted = np.repeat(b[~counted], sizes) << 32 | rows.column("a").flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(key, wanted)
            each = _flat(rows.column("docs_of_a"), "<u2").astype(np.int64)
            times = _flat(rows.column("times"), "<u4").astype(np.int64)
            row_of_pair = np.repeat(np.arange(rows.num_rows), sizes)
            number = np.repeat(rows.column("slice").to_numpy()[row_of_pair], each)
            place = _flat(rows.column("docs"), "<u2").astype(np.int64)
            full = pending.add(number, place, times * np.repeat(count[at] == top[at], each), times * np.repeat(count[at], each))
            if full:
                yield pending.take()
        last = key >> 32 == b[-1]
        key, count, top = key[last], count[last], top[last]
    rest = pending.take()
    if rest is not None:
        yield rest


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a slice in order: contributions, then documents, which leave with their sums."""
    number, best, total = None, np.zeros(SLICE_DOCS, np.int64), np.zeros(SLICE_DOCS, np.int64)
    for batch in batches:
        slices_of = batch.column("slice").to_numpy()
        cuts = np.append(np.flatnonzero(np.concatenate([[True], slices_of[1:] != slices_of[:-1]])), len(slices_of)) if len(slices_of) else [0]
        for low, high in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(low, high - low)
            if slices_of[low] != number:
                number = slices_of[low]
                best[:], total[:] = 0, 0
            is_doc = part.column("is_doc")
            sums = part.filter(pa.compute.invert(is_doc))
            for places, own_best, own_total in zip(*(sums.column(c).to_pylist() for c in ("places", "best", "total"))):
                at = np.frombuffer(places, "<u2")
                best[at] += np.frombuffer(own_best, "<i8")
                total[at] += np.frombuffer(own_total, "<i8")
            docs = part.filter(is_doc)
            if docs.num_rows:
                at = docs.column("place").to_numpy()
                made = {"n_best": pa.array(best[at]), "count_sum": pa.array(total[at])}
                names = [x.split()[0] for x in _RESULT.split(", ")]
                yield pa.RecordBatch.from_arrays([made[c] if c in made else docs.column(c) for c in names], names=names)


def alignment(docs: DataFrame, blob_a: bytes, blob_b: bytes) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of (doc_id, text), from the files of A and B.

    Null and empty texts and texts that a tokenizer changes have zeros and ''. Repeated rows
    count each, a null doc_id is a document like others, texts are read whole; an
    empty table gives an empty result; other columns are ignored. The files are broadcast;
    they are refused above 16 MB.
    """
    if max(len(blob_a), len(blob_b)) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    n = shuffle_partitions(docs.sparkSession)
    table = materialise(_table(docs, blob_a, blob_b), "alignment")
    postings = table.where("not is_doc").select("slice", "b", "a", "total", "docs_of_a", "docs", "times")
    linked = postings.select("b", F.inline(F.arrays_zip("a", "total"))).groupBy("b", "a").agg(F.sum("total").alias("total"))
    counts = linked.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("a", "total"))).alias("pairs"))  # at most one for each A id
    size = F.length("docs_of_a") + F.length("docs") + F.length("times")
    parts = postings.groupBy("b").agg(F.ceil(F.sum(size) / POSTING_BYTES).cast("int").alias("parts"))  # a row for each B id
    parts = materialise(counts.join(parts, "b"), "alignment-counts")
    counted = parts.select(
        "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("counted"), F.col("pairs.a").alias("a"), F.col("pairs.total").alias("total")
    )
    many = F.broadcast(parts.where("parts > 1").select("b", "parts"))  # at most a number for each B id
    dealt = postings.join(many, "b", "left").withColumn("part", F.pmod(F.xxhash64("slice"), F.coalesce("parts", F.lit(1))).cast("int"))
    held = dealt.select("b", "part", F.lit(False).alias("counted"), "slice", "a", "docs_of_a", "docs", "times")
    stream = counted.unionByName(held, allowMissingColumns=True).repartition(n, "b", "part").sortWithinPartitions("b", "part", F.desc("counted"))
    given = stream.mapInArrow(_contributions, "slice long, places binary, best binary, total binary")
    own = table.where("is_doc").select("is_doc", "slice", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    both = own.unionByName(given.withColumn("is_doc", F.lit(False)), allowMissingColumns=True)
    return both.repartition(n, "slice").sortWithinPartitions("slice", "is_doc").mapInArrow(_summed, _RESULT)


def read_file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read(MAX_VOCABULARY_BYTES + 1)


def op13_token_alignment(spark: SparkSession, sf_dir: str, side_a: str | None = None, side_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    paths = (side_a or public_tokenizers.path(SIDE_A), side_b or public_tokenizers.path(SIDE_B))
    return alignment(documents(spark, sf_dir), *map(read_file, paths))
