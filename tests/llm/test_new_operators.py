"""Fill-in-middle, fingerprints and token alignment against brute force, on odd rows and on the test tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helmwind.llm import fill_middle, fingerprints, token_alignment
from helmwind.llm.common import documents
from tests.llm.test_oracles import both

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Fill-in-middle


def test_fill_in_middle_sql(spark, odd, tmp_path):
    marked = spark.createDataFrame([(60 + i, f"a {m} b" * 3, None, None, 1) for i, m in enumerate(("<P>", "<S>", "<M>", "<", "<P"))], odd.schema)
    odd.unionByName(marked).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want, got = both(spark, tmp_path, "documents", "op11_fill_in_middle")
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert all(r[2] == "plain" for r in got if r[0] in (60, 61, 62))


def test_fill_in_middle_odd_rows(odd, odd_rows, clashing, nothing):
    for table in (odd, clashing):
        rows = fill_middle.fill_in_middle(table).collect()
        assert sorted(r.restored_sha256 for r in rows) == sorted(sha(r[1] or "") for r in odd_rows)
        assert all((r.form == "plain") == (r.prefix_chars is None) for r in rows)
    assert fill_middle.fill_in_middle(nothing).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(odd, unit="page")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<PSM> \n\t\U0001d4b3é"), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4), st.sampled_from(fill_middle.UNITS))
def test_restore_inverts(text, h, unit):
    output, form, n, prefix, middle = fill_middle.transform(text, h, unit)
    assert fill_middle.restore(output, form) == text and n == len(text)
    if form != "plain":
        places = {0, len(text)} | {i for i in range(1, len(text)) if unit == "point" or differ(text[i - 1], text[i], unit)}
        assert {prefix, prefix + middle} <= places


def differ(a, b, unit):
    return (a in " \t\n") != (b in " \t\n") if unit == "word" else a == "\n"


# Fingerprints


def bits_of(doc):
    return int(doc.fingerprint, 16), int(doc.edited_fingerprint, 16)


def test_fingerprints_of_edited_texts(spark, odd, odd_rows, clashing, nothing):
    for table in (odd, clashing):
        rows = sorted(fingerprints.edited_fingerprints(table).collect(), key=repr)
        by_id = defaultdict(set)
        for r in odd_rows:
            by_id[r[0]].add(r[1] or "")
        order = sorted({r[0] for r in odd_rows if r[0] is not None}, reverse=True)
        assert len(rows) == len(odd_rows)
        for r in rows:
            if r.doc_id is None or r.doc_id == 8:
                continue
            (text,) = by_id[r.doc_id]
            at = order.index(r.doc_id)
            nexts = by_id[order[at + 1]] if at + 1 < len(order) else by_id[None]  # rows without id come last
            half = len(text) // 2
            assert r.n_chars == len(text)
            assert r.edited_sha256 in {sha(text[: len(text) - half] + after[:half]) for after in nexts}
            assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        prints = defaultdict(set)
        for r in rows:
            if r.doc_id in by_id and len(by_id[r.doc_id]) == 1:
                prints[" ".join(sorted(set(next(iter(by_id[r.doc_id])).lower().split())))].add(r.fingerprint)
        assert all(len(x) == 1 for x in prints.values())
        assert {r.fingerprint for r in rows if r.doc_id in (2, 3, 4)} == {"0" * 32}
    assert fingerprints.edited_fingerprints(nothing).count() == 0
    (alone,) = fingerprints.edited_fingerprints(odd.where("doc_id = 1")).collect()
    text = next(r[1] for r in odd_rows if r[0] == 1)
    assert alone.near_next == 1.0 and alone.edited_sha256 == sha(text[: len(text) - len(text) // 2] + text[: len(text) // 2])


def test_votes_by_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "Of", "a", "word", "longer", "éé", "x" * 70, "b", "cc"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.f0, r.f1) for r in fingerprints.fingerprints(table, ["doc_id"]).collect()}
    words = sorted({w for t in texts for w in t.lower().split()})
    hashed = spark.createDataFrame([(w,) for w in words], "w string").select("w", *[F.xxhash64("w", F.lit(i)).alias(f"h{i}") for i in (0, 1)]).collect()
    hash_of = {r.w: (r.h0, r.h1) for r in hashed}
    for i, text in enumerate(texts):
        want = []
        for part in (0, 1):
            value, own = 0, set(text.lower().split())
            for bit in range(64):
                votes = sum(min(len(w), 4) * (1 if hash_of[w][part] >> bit & 1 else -1) for w in own)
                value |= (votes > 0) << bit
            want.append(value - (1 << 64) if value >> 63 else value)
        assert got[i] == tuple(want)


@pytest.mark.parametrize("radius", [0, 2, 3, 7])
def test_search_finds_all_within_the_radius(spark, radius):
    rng = random.Random(radius)
    values = [rng.getrandbits(128) for _ in range(30)]
    values += [v ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, radius + 2))) for v in values for _ in range(6)]
    values = sorted(set(values)) + [0, 1 << 127, (1 << 128) - 1]

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    rows = [(signed(v & (1 << 64) - 1), signed(v >> 64)) for v in values] + [(None, 1), (1, None)]
    table = spark.createDataFrame(rows, "f0 long, f1 long")
    asked = table.where("f0 % 3 = 0")
    got = [((r.q0, r.q1), (r.f0, r.f1), r.distance) for r in fingerprints.within(asked, table, radius).collect()]
    number = {row: v for row, v in zip(rows, values)}
    own = {(r.f0, r.f1) for r in asked.collect()} & set(number)
    want = {(a, b, bin(number[a] ^ number[b]).count("1")) for a in own for b in number if bin(number[a] ^ number[b]).count("1") <= radius}
    assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        fingerprints.within(asked, table, 128)


@pytest.mark.parametrize("buckets", [1, 3, 1000])
def test_next_row_over_bucket_ends(spark, monkeypatch, buckets):
    monkeypatch.setattr(fingerprints, "MOST_BUCKETS", buckets)
    rng = random.Random(7)
    ids = rng.sample(range(-(10**12), 10**12), 150) + [2**63 - 1, -(2**63)]
    table = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(table).collect()}
    order = sorted(ids, reverse=True)
    assert got == {a: f"text {b}" for a, b in zip(order, order[1:] + order[:1])}


def test_null_ids_and_copies_follow_each_other(spark):
    rows = [(None, f"no id {i % 90}") for i in range(300)] + [(5, "same")] * 40 + [(6, None), (4, "")]
    pairs = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(pairs) == len(rows)
    assert Counter(p.next_text for p in pairs) == Counter(p.text for p in pairs)  # each row follows one
    assert next(p.next_text for p in pairs if p.doc_id == 6) == "same"
    assert sum(p.next_text == "same" for p in pairs if p.doc_id == 5) == 39
    assert next(p for p in pairs if p.doc_id == 4).next_text.startswith("no id")


def test_fingerprint_query(spark):
    rows = fingerprints.op12_document_fingerprints(spark, SF).toPandas()
    texts = {r.doc_id: r.text for r in documents(spark, SF).collect()}
    assert len(rows) == len(texts)
    order = sorted(texts, reverse=True)
    follows = dict(zip(order, order[1:] + order[:1]))
    own = {r.doc_id: bits_of(r) for r in rows.itertuples()}
    for r in rows.itertuples():
        differing = (own[r.doc_id][0] ^ own[follows[r.doc_id]][0]).bit_count()
        assert r.near_next == pytest.approx(max(0.0, math.cos(math.pi * differing / 128)))
        differing = (own[r.doc_id][0] ^ own[r.doc_id][1]).bit_count()
        assert r.near_edited == pytest.approx(max(0.0, math.cos(math.pi * differing / 128)))
        assert r.n_near == sum((own[r.doc_id][0] ^ x[0]).bit_count() <= 3 for x in own.values()) - 1
    assert (rows.near_edited > rows.near_next).mean() > 0.95
    plan = fingerprints.op12_document_fingerprints(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# Token alignment


@pytest.fixture(scope="module")
def files():
    return tuple(token_alignment.read_file(public_tokenizers.path(x)) for x in (token_alignment.SIDE_A, token_alignment.SIDE_B))


def library(files):
    a = Tokenizer.from_str(files[0].decode())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    return (lambda t: a.encode(t, add_special_tokens=False).ids), (lambda t: b.encode(t)), a, b


def brute(files, texts):
    """Everything from the definitions, by loops over bytes."""
    encode_a, encode_b, a, b = library(files)
    chars = token_alignment.byte_characters()
    bytes_a = lambda i: bytes(chars[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, corpus = [], Counter()
    for text in texts:
        whole = f" {text}".encode() if text else b""
        ids_a, ids_b = (encode_a(f" {text}"), encode_b(text)) if text else ([], [])
        if b"".join(map(bytes_a, ids_a)) != whole or b"".join(map(bytes_b, ids_b)) != whole:
            ids_a = ids_b = []
        at_a = [k for k, i in enumerate(ids_a) for _ in bytes_a(i)]
        at_b = [k for k, i in enumerate(ids_b) for _ in bytes_b(i)]
        links = sorted(set(zip(at_a, at_b)))
        groups, own_a, own_b = [], [], []
        for k in range(len(at_a)):
            end_a = k + 1 == len(at_a) or at_a[k + 1] != at_a[k]
            end_b = k + 1 == len(at_b) or at_b[k + 1] != at_b[k]
            own_a += [str(ids_a[at_a[k]])] * end_a
            own_b += [str(ids_b[at_b[k]])] * end_b
            if end_a and end_b:
                groups.append(",".join(own_a) + "|" + ",".join(own_b))
                own_a, own_b = [], []
        pairs = [(ids_a[x], ids_b[y]) for x, y in links]
        corpus.update(pairs)
        docs.append((len(ids_a), len(ids_b), len(groups), len(links), pairs, sha(";".join(groups)) if groups else ""))
    top = Counter()
    for (_, y), n in corpus.items():
        top[y] = max(top[y], n)
    return [(*d[:4], sum(corpus[p] == top[p[1]] for p in d[4]), sum(corpus[p] for p in d[4]), d[5]) for d in docs]


def rows_of(found):
    return sorted(((r.doc_id, *(getattr(r, c) for c in found.columns[1:])) for r in found.collect()), key=repr)


def test_alignment_of_odd_rows(spark, odd, odd_rows, clashing, nothing, files):
    rows = [(r[0], r[1] if r[1] is None or len(r[1]) < 50_000 else r[1][:3000]) for r in odd_rows]
    rows += [(90, "a▁b"), (91, "trail  "), (92, "  lead"), (93, "<|endoftext|> <s> </s> <unk>"), (94, "\x00\x01 \x85 　"), (95, "é́ﬁ ﷺ \U0001f600\U0001f468‍\U0001f469")]
    rows += [(96, " "), (97, "\n\n  \n"), (98, "don't we'll   it's 12345 ２３ ½"), (99, "한국어 中文 русский العربية")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute(files, [t for _, t in rows]))), key=repr)
    assert rows_of(token_alignment.alignment(table, *files)) == want
    assert next(w for w in want if w[0] == 90)[1:] == (0, 0, 0, 0, 0, 0, "")
    assert token_alignment.alignment(nothing, *files).count() == 0
    assert rows_of(token_alignment.alignment(odd, *files)) == rows_of(token_alignment.alignment(clashing, *files))


def test_alignment_over_many_slices_and_tasks(spark, files, monkeypatch):
    """Tiny slices, parts and buffers, so that ids run over tasks, batches and flushes; broadcast code reads module constants at the driver's values."""
    rows = [(r.doc_id, r.text) for r in documents(spark, SF).collect()][:120]
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute(files, [t for _, t in rows]))), key=repr)
    monkeypatch.setattr(token_alignment, "POSTING_BYTES", 200)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows_of(token_alignment.alignment(table, *files)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_contributions_are_flushed(monkeypatch):
    monkeypatch.setattr(token_alignment, "PENDING", 5)
    pending, rng, want, got = token_alignment._Pending(), np.random.default_rng(1), Counter(), Counter()

    def read(batch):
        for number, places, best, total in zip(*(c.to_pylist() for c in batch.columns)):
            for p, b, t in zip(np.frombuffer(places, "<u2"), np.frombuffer(best, "<i8"), np.frombuffer(total, "<i8")):
                got[number, int(p)] += np.array([b, t])

    for _ in range(50):
        number, place = rng.integers(0, 3, 9), rng.integers(0, 4, 9)
        best, total = rng.integers(0, 9, 9), rng.integers(0, 10**12, 9)
        for n, p, b, t in zip(number.tolist(), place.tolist(), best, total):
            want[n, p] += np.array([b, t])
        if pending.add(number, place, best, total):
            read(pending.take())
    rest = pending.take()
    if rest is not None:
        read(rest)
    assert {k: v.tolist() for k, v in got.items()} == {k: v.tolist() for k, v in want.items()}
    assert pending.take() is None


@lru_cache(1)
def sides():
    blobs = [token_alignment.read_file(public_tokenizers.path(x)) for x in (token_alignment.SIDE_A, token_alignment.SIDE_B)]
    return token_alignment.SideA(blobs[0]), token_alignment.SideB(blobs[1])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab cé'1 \n\t.▁\x00\xa0<s>ß中\U0001f600"), max_size=60))
def test_segments_encode_as_the_whole(text):
    side_a, side_b = sides()
    if not text:
        return
    found = side_b.encode(f" {text}")
    whole = side_b.model.encode(text, num_threads=1)
    assert found is None or found.tolist() == whole
    assert (found is None) == (b"".join(side_b.token_bytes[i] for i in whole) != f" {text}".encode())
    assert side_a.encode(f" {text}").tolist() == side_a.exact.encode(f" {text}", add_special_tokens=False).ids


def test_long_runs_and_full_memory(files, monkeypatch):
    side_a, side_b = token_alignment.SideA(files[0]), token_alignment.SideB(files[1])
    monkeypatch.setattr(token_alignment, "REMEMBERED", 20)
    rng = random.Random(2)
    for text in ("x" * 9000, " " * 9000 + "y", " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(300))):
        for _ in range(2):
            assert side_b.encode(f" {text}").tolist() == side_b.model.encode(text, num_threads=1)
            assert side_a.encode(f" {text}").tolist() == side_a.exact.encode(f" {text}", add_special_tokens=False).ids
    assert len(side_b.known) <= 320


def test_segments_of_a_slice_are_learnt_at_once(monkeypatch):
    """One call of the model for all texts of a slice, and a check of bytes by itself only where some segment changes."""
    aligner = token_alignment.Aligner(*[token_alignment.read_file(public_tokenizers.path(p)) for p in (token_alignment.SIDE_A, token_alignment.SIDE_B)])
    calls, learn, checked = [], aligner.b._learn, aligner.b._checked
    monkeypatch.setattr(aligner.b, "_learn", lambda new: calls.append("learn") or learn(new))
    monkeypatch.setattr(aligner.b, "_checked", lambda s, ids: calls.append(s) or checked(s, ids))
    texts = [f"word{i} of  some text\n{i}" for i in range(40)]
    counts, _ = aligner.align([*texts, None, ""])
    assert calls == ["learn"] and counts["n_b"].tolist() == [len(aligner.b.model.encode(t)) for t in texts] + [0, 0]
    whole = [aligner.b.model.encode(t) for t in ("mark \u2581here", "plain")]
    counts, _ = aligner.align(["mark \u2581here", "plain"])
    assert " plain" in calls and counts["n_b"].tolist() == [0, len(whole[1])]
