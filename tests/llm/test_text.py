"""Mixing, tokens, quality, toxicity, language and pages: brute force, round trips, held-out accuracy, odd rows."""

import hashlib
import html
import itertools
import json
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from helmwind.llm import bpe, html_extract, langid, learning, mixing, quality_cnn, quality_rules, toxicity
from helmwind.llm.common import documents, hash_spans, slices, text_buffer, window_hashes, word_spans

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    y = np.array(labels)
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_words_and_hashes(odd_rows):
    texts = [r[1] for r in odd_rows]
    data, offsets = text_buffer(pa.array(texts))
    starts, ends, at = word_spans(data, offsets)
    raw = data.tobytes()
    want = [WORD.findall(t or "") for t in texts]
    assert [raw[s:e].decode() for s, e in zip(starts, ends)] == [w for ws in want for w in ws]
    assert np.diff(at).tolist() == [len(w) for w in want]
    by_word = dict(zip((w for ws in want for w in ws), hash_spans(data, starts, ends).tolist()))
    assert len(set(by_word.values())) == len(by_word)
    assert [t for s, e in slices(pa.array(texts), 1000) for t in texts[s:e]] == texts
    words = np.array([1, 2, 3, 1, 2, 3], dtype=np.uint64)
    h = window_hashes(words, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 3


# Mixing


def test_targets():
    sizes, weights = [1000, 10, 500, 0, 300], [1.0, 2.0, 3.0, 1.0, 2.0]
    got = mixing.targets_of(sizes, weights)
    assert sum(got) == pytest.approx(1810) and got[1] == 30 and got[3] == 0
    free = [i for i in range(5) if sizes[i] and got[i] < 3 * sizes[i]]
    assert len({round(got[i] / weights[i], 6) for i in free}) == 1
    assert mixing.targets_of([], []) == []


def test_splitting_tree():
    quotas = np.array([1000, 3, 0, 250])
    dealt = mixing.split_quotas(quotas, 7, 5)
    assert (dealt.sum(axis=0) == quotas).all() and (dealt >= 0).all()
    totals = dealt.sum(axis=1)
    assert totals.max() - totals.min() <= 3
    assert (mixing.split_quotas(quotas, 7, 5) == dealt).all()
    many = np.array([mixing.split_quotas(np.array([30, 10]), 4, s)[0] for s in range(400)])
    assert abs(many[:, 0].mean() - 7.5) < 0.3 and many[:, 0].std() > 0.5  # without replacement: 10 draws of 40


def check_mix(df, rows):
    found = mixing.mix_plan(df, shards=5).collect()
    sizes = Counter((r[0], r[3], len(WORD.findall(r[1] or ""))) for r in rows)
    assert Counter((r.doc_id, r.source, r["size"]) for r in found) == sizes
    order = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    own = [sum(len(WORD.findall(r[1] or "")) for r in rows if r[3] == s) for s in order]
    targets = dict(zip(order, mixing.targets_of(own, [float(1 + i % 3) for i in range(len(order))])))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        assert r.source_size == own[order.index(r.source)] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r["size"] * len(r.draws) <= 3 * r["size"] and all(0 <= d.shard < 5 for d in r.draws)
        assert [d.unit for d in r.draws] == sorted(d.unit for d in r.draws)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in order:
        assert abs(taken[s] - targets[s]) <= largest[s]
    again = mixing.mix_plan(df, shards=5).collect()
    assert Counter(map(str, found)) == Counter(map(str, again))
    return found


def test_mixing(spark, odd, odd_rows, clashing, nothing):
    check_mix(odd, odd_rows)
    check_mix(clashing, odd_rows)
    assert mixing.mix_plan(nothing).count() == 0
    rows = [tuple(r) for r in documents(spark, SF2).collect()]
    found = check_mix(documents(spark, SF2), rows)
    per_shard = Counter(d.shard for r in found for d in r.draws)
    assert min(per_shard.values()) > 0.5 * max(per_shard.values())
    taken, target = Counter(), {}
    for r in mixing.op1_mixing(spark, SF2).collect():
        taken[r.target, r.source_size] += r.taken
    for (t, _), n in taken.items():
        assert abs(n - t) < 0.02 * t


def test_leaves_hold_disjoint_draws(spark, monkeypatch):
    docs = documents(spark, SF2)
    found = mixing.mix_plan(docs, shards=7).collect()
    leaf_of = {}
    for r in found:
        for d in r.draws:
            assert leaf_of.setdefault((r.source, d.unit), d.shard) == d.shard  # a block is drawn whole, into one leaf
    assert len({d.position for r in found for d in r.draws}) == sum(len(r.draws) for r in found)
    quotas = []
    monkeypatch.setattr(mixing, "split_quotas", lambda q, shards, seed: quotas.append(q) or np.zeros((shards, len(q)), np.int64))
    assert sum(r.taken for r in mixing.mix_plan(docs, shards=7).collect()) == 0  # without the tree nothing is taken
    sources = sorted({r.source for r in found}, key=lambda s: (s is None, s or ""))
    most = Counter()
    for s, i in leaf_of:
        most[s] = max(most[s], i + 1)
    assert all(most[s] <= q for s, q in zip(sources, quotas[0]))


def test_permutation(spark):
    for half in range(5):
        n = 4**half
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(half), F.lit(2**half - 1).cast("long"), F.lit(9)).alias("x"), "id").orderBy("id")
        order = [r.x for r in rows.collect()]
        assert sorted(order) == list(range(n)) and (half < 2 or order != list(range(n)))


def test_small_sources_come_as_near_as_documents_allow(spark):
    rng = np.random.default_rng(4)
    sizes = [73, 461, 790] + [int(x) for x in rng.integers(1, 900, 57)]
    rows = [(i, " ".join("w" * n), f"s{i // 3:02}") for i, n in enumerate(sizes)]
    by = defaultdict(list)
    for r in mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        by[r.source].append(r)
    for rows in by.values():
        best = min(abs(sum(r["size"] * n for r, n in zip(rows, times)) - rows[0].target) for times in itertools.product(range(4), repeat=3))
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= best + 1


def test_many_sources(spark):
    text = F.expr("repeat('w ', cast(1 + pmod(xxhash64(id), 400) as int))")
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 30_000).cast("string").alias("source"), text.alias("text"))
    found = mixing.mix_plan(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).toPandas()
    off = (found.taken - found.target).abs() / found.target
    assert len(found) == 30_000 and off.median() < 0.15 and abs(found.taken.sum() / found.target.sum() - 1) < 0.05
    dealt = mixing.split_quotas(np.full(30_000, 40_000), 4, 1)  # beyond numpy's own range
    assert (dealt >= 0).all() and (dealt.sum(axis=0) == 40_000).all() and np.ptp(dealt.sum(axis=1)) <= 2 and abs(dealt[0].std() / 86.6 - 1) < 0.05


@pytest.mark.parametrize("cap", [1, 3])
def test_nearest_times(cap):
    rng = np.random.default_rng(cap)
    for _ in range(60):
        sizes = rng.integers(1, 50, rng.integers(1, 6))
        target = float(rng.integers(-5, cap * sizes.sum() + 20))
        got = mixing.nearest_times(sizes, target, cap)
        best = min(abs(sizes @ np.array(m) - target) for m in itertools.product(range(cap + 1), repeat=len(sizes)))
        assert ((0 <= got) & (got <= cap)).all() and abs(sizes @ got - target) == pytest.approx(best)


def test_mixing_stage(spark, clashing):
    clashing = clashing.withColumns({c: F.lit(f"own {c}") for c in ("__mix_h", "own", "p", "shard", "position", "draw")})
    out = mixing.mixing_stage(spark, clashing, "")
    assert out.columns == clashing.columns
    assert {(r["__mix_h"], r.own, r.p, r["size"]) for r in out.collect()} == {("own __mix_h", "own own", "own p", "own size")}
    assert mixing.mixing_stage(spark, clashing.limit(0), "").count() == 0
    plan = {(r.doc_id, r["size"]): len(r.draws) for r in mixing.mix_plan(clashing, shards=max(mixing.SHARDS, 4)).collect()}
    got = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in out.collect())
    assert all(got[k] in (n, 2 * n) for k, n in plan.items())


# Tokens


@pytest.fixture(scope="module")
def coders():
    blob = bpe.read_vocabulary(public_tokenizers.path(bpe.VOCABULARY))
    return bpe.ByteBpe(blob), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(blob), special_tokens={})


def test_bpe_is_tiktoken(coders, odd_rows, spark):
    ours, theirs = coders
    rng = np.random.default_rng(0)
    texts = [r[1] or "" for r in odd_rows] + [r.text for r in documents(spark, SF).collect()]
    texts += ["".join(chr(c) for c in rng.integers(1, hi, size=60) if not 0xD800 <= c < 0xE000) for hi in (128, 256, 0x3000, 0x1FFFF) for _ in range(60)]
    texts += ["<|endoftext|>", "▁▁ a▁", " " * 300, "\n\n\t x", "don't we'll I'M", "a\x00b", "ĀāĂ"]
    for text in texts:
        ids = ours.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()


def test_bpe_memory_is_bounded(coders, monkeypatch):
    ours, theirs = coders
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    for i in range(30):
        text = " ".join(f"w{i}x{j}" for j in range(40))
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode_ordinary(text)
        assert len(ours.known) <= 50 + 4 * 41


def test_bpe_rows(spark, odd, odd_rows, clashing, nothing, coders):
    blob = bpe.read_vocabulary(public_tokenizers.path(bpe.VOCABULARY))
    want = Counter()
    for r in odd_rows:
        ids = np.array(coders[1].encode_ordinary(r[1] or ""), dtype="<u4")
        want[r[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    for df in (odd, clashing):
        found = bpe.encode_decode(df, blob).collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == want
    assert bpe.encode_decode(nothing, blob).count() == 0
    out = bpe.tokens_stage(spark, clashing, "")
    assert out.columns[-4:] == ["n_tokens", "ids_sha256", "decoded_sha256", "ids"] and {"doc_ids", "doc_n_tokens"} <= set(out.columns)
    assert all(len(r.ids) == r.n_tokens for r in out.collect())
    got = {r.doc_id: r.decoded_sha256 for r in bpe.op2_byte_bpe(spark, SF).collect()}
    assert got == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in documents(spark, SF).collect()}


# Quality rules


def slow_counts(text):
    text = text or ""
    words, lines, seen, dup = WORD.findall(text), text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = [False] * len(words)
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(hit)


def test_quality_counts(spark, odd, odd_rows, clashing, nothing):
    model = quality_rules.NgramRegression()
    for df in (odd, clashing):
        found = quality_rules.quality_rules(df, model).collect()
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
        want = Counter()
        for r in odd_rows:
            c = slow_counts(r[1])
            want[(r[0], *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
        assert got == want
        assert all(not r.kept for r in found if r.base_failed)
    assert quality_rules.quality_rules(nothing, model).count() == 0


def test_quality_query(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in documents(spark, SF2).collect()}
    rows = quality_rules.op3_quality_rules(spark, SF2).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows} == {i: slow_counts(t) for i, t in texts.items()}
    known = [r for r in rows if r.doc_id in labels and not r.base_failed]
    assert auc([labels[r.doc_id] for r in known], [r.probability for r in known]) > 0.97
    assert np.mean([r.kept for r in known if labels[r.doc_id]]) > 0.97


# Classifiers


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.mark.parametrize("module,query,column,modulus,out", [(quality_cnn, "op4_quality_classifier", "quality", 5, 0), (toxicity, "op5_toxicity", "toxic", 4, 2)])
def test_classifiers_held_out(spark, module, query, column, modulus, out):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    rows = getattr(module, query)(spark, SF2).collect()
    assert len(rows) == documents(spark, SF2).count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (crc(r.doc_id, modulus) == out) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert auc([labels[r.doc_id] for r in held], [r.score for r in held]) > 0.85


def test_classifiers_odd_rows(spark, odd, clashing, nothing):
    cnn, words = quality_cnn.ByteCnn(), toxicity.WordCnn()
    for df in (odd, clashing):
        for found in (quality_cnn.score(df, cnn).collect(), toxicity.score(df, words).collect()):
            assert len(found) == 15 and all(0 <= r.score <= 1 for r in found)
            assert all(len({round(r.score, 5) for r in found if r.doc_id in ids}) == 1 for ids in ((2, 3), (8,)))
    assert quality_cnn.score(nothing, cnn).count() == 0 and toxicity.score(nothing, words).count() == 0


def test_scores_do_not_depend_on_the_batch():
    texts = ["short", "", "word " * 500, "x" * 70_000, "Some Other text | with # signs"]
    for model in (quality_cnn.ByteCnn(), toxicity.WordCnn()):
        together = model.probabilities(*text_buffer(pa.array(texts)))
        alone = [float(model.probabilities(*text_buffer(pa.array([t])))[0]) for t in texts]
        np.testing.assert_allclose(together, alone, rtol=1e-5)


@pytest.mark.parametrize("order", range(4))
def test_quality_rules_do_not_depend_on_the_batch(order):
    rng = np.random.default_rng(order)
    texts = ["short", "", "a", "ab", "word " * 500, "x" * 70_000, "Some Other text | with # signs", "été " * 9, "end"]
    model = quality_rules.NgramRegression()
    model.weights = np.random.default_rng(1).normal(size=model.weights.shape).astype(np.float32)
    model.dense, model.bias = np.array([0.3, -2.0, 1.7, 0.01]), 0.2

    def run(own):
        data, offsets = text_buffer(pa.array(own))
        return model.probabilities(data, offsets, quality_rules.base_counts(data, offsets)).tolist()

    alone = [run([t])[0] for t in texts]
    at = rng.permutation(len(texts)).tolist()
    assert run([texts[i] for i in at]) == [alone[i] for i in at]


def test_byte_grams_stay_within_rows():
    texts = ["abcdefg", "", "xy", "hijkl"]
    together = quality_rules.gram_indices(*text_buffer(pa.array(texts)))
    for kind, (index, at) in enumerate(together):
        for i, t in enumerate(texts):
            assert index[at[i] : at[i + 1]].tolist() == quality_rules.gram_indices(*text_buffer(pa.array([t])))[kind][0].tolist()
    assert [np.diff(at).tolist() for _, at in together[2:]] == [[5, 0, 0, 3], [3, 0, 0, 1]]


def test_samples_are_bounded_by_bytes_and_rerun(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 90, "long " * 30_000 if i == 7 else f"text {i // 90} of {i % 90}") for i in range(180)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    rows, prior = learning.labelled_sample(docs, labels, "quality", 1000)
    assert [r.doc_id for r in rows] == list(range(90)) and prior == 0.5 and len(rows[7].text) == 150_000
    assert all(r.text == f"text 0 of {i}" for i, r in enumerate(rows) if i != 7) and all(r.label == r.doc_id % 2 for r in rows)
    monkeypatch.setattr(learning, "TRAIN_BYTES", 200)
    few = [learning.labelled_sample(docs.repartition(n), labels, "quality", 1000)[0] for n in (2, 5)]
    assert few[0] == few[1] and 10 < len(few[0]) < 60 and {r.label for r in few[0]} == {0, 1}


def test_cnn_gradients():
    model = quality_cnn.ByteCnn()
    texts, labels = [b"abc def " * 60, b"## $$ %% " * 9], [1.0, 0.0]
    grads = model.gradients(texts, labels)

    def loss():
        total = 0.0
        for t, y in zip(texts, labels):
            z = float(model.logits(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])
            total += np.log1p(np.exp(-z if y else z))
        return total / len(texts)

    for name, at in (("head", 3), ("out", 0), ("bias", 5)):
        model.p[name][at] += 1e-2
        up = loss()
        model.p[name][at] -= 2e-2
        down = loss()
        model.p[name][at] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(float(grads[name][at]), abs=5e-3)


def test_no_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows, prior = learning.labelled_sample(documents(spark, SF), empty, "quality", 10)
    assert rows == [] and prior == 0.5
    for module in (quality_cnn, toxicity, quality_rules):
        assert module.train([], 0.5) is not None


def test_platt():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000)
    a, b = learning.platt(3 * (y - 0.5) + rng.normal(size=4000), y, 0.1)
    p = learning.sigmoid(a * (3 * (y - 0.5) + rng.normal(size=4000)) + b)
    assert a > 0 and p[y == 1].mean() > p[y == 0].mean()


# Language


def test_language(spark, odd, clashing, nothing):
    docs = documents(spark, SF2)
    langs = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.op9_language_id(spark, SF2).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows) and len(rows) == len(langs)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.accepted for r in rows]) > 0.995
    model, limit = langid.train(docs)
    for df in (odd, clashing):
        found = {r.doc_id: r for r in langid.identify(df, model, limit, ["doc_id"]).collect()}
        assert all(found[i].lang_pred == "und" and found[i].score == 0 and not found[i].accepted for i in (2, 3, 4))
        assert found[5].lang_pred in {"en", "de", "fr", "es"}
    assert langid.identify(nothing, model, limit, ["doc_id"]).count() == 0
    none, _ = langid.train(nothing)
    assert {r.lang_pred for r in langid.identify(odd, none, 0.0, ["doc_id"]).collect()} == {"und"}
    junk = spark.createDataFrame([(1, "qzxj wvkq xqjz " * 30), (2, "кириллица совсем другая " * 20)], "doc_id long, text string")
    assert not any(r.accepted for r in langid.identify(junk, model, limit, ["doc_id"]).collect())
    out = langid.language_stage(spark, docs.limit(50).withColumn("score", F.lit("own")), "")
    assert out.columns == [*docs.columns, "score"]


def test_distinct_grams():
    rng = np.random.default_rng(0)
    for high in (5, 40_000, 0x10FFFF):
        window = rng.integers(0, high, size=(500, 4)).astype(np.int32)
        window[250:] = window[:250]
        rows, counts = langid.distinct_grams(window)
        want, n = np.unique(window, axis=0, return_counts=True)
        assert (rows == want).all() and (counts == n).all()
    assert len(langid.distinct_grams(np.zeros((0, 4), np.int32))[0]) == 0


def slow_kneser_ney(texts_of, order=4):
    """p(lang, context, character) by the definition, from dictionaries."""
    counts = {lang: [Counter() for _ in range(order + 1)] for lang in texts_of}
    for lang, texts in texts_of.items():
        for text in texts:
            line = " " * (order - 1) + re.sub(r"[\W\d_]+", " ", text.lower())
            counts[lang][order].update(line[i - order + 1 : i + 1] for i in range(order - 1, len(line)))
        for k in range(order - 1, 0, -1):
            counts[lang][k].update(g[1:] for g in counts[lang][k + 1])
    alphabet = {g for c in counts.values() for g in c[1]}

    def p(lang, context, char):
        value = 1 / (len(alphabet) + 1)
        for k in range(1, order + 1):
            c, head = counts[lang][k], context[len(context) - k + 1 :]
            after = [n for g, n in c.items() if g[:-1] == head]
            if after:
                n1, n2 = (sum(1 for n in c.values() if n == x) for x in (1, 2))
                d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9)
                value = max(c[head + char] - d, 0) / sum(after) + d * len(after) / sum(after) * value
        return value

    return p, sorted(alphabet)


@pytest.mark.parametrize("block", [8, 2])
def test_kneser_ney_against_its_definition(spark, block):
    texts_of = {"x": ["abab bc", "cab ab", "a b"], "y": ["bca", "ccc abc cab"], "z": ["de de ed", "abd"]}
    sample = spark.createDataFrame([(lang, t) for lang, ts in texts_of.items() for t in ts], "lang string, text string")
    model = langid.KneserNey(langid.kneser_ney(langid.gram_counts(sample)).toArrow(), block=block)
    p, alphabet = slow_kneser_ney(texts_of)
    assert model.languages == ["x", "y", "z"] and len(model.blocks) == -(-3 // block)
    for context in ("   ", " ab", "bab", "cab", "ccc", "eed", "zzz", "bzb"):
        sums = np.zeros(3)
        for char in [*alphabet, "q"]:
            seq = np.array([ord(c) for c in context + char], dtype=np.uint64)
            got = model.log_probabilities(langid.gram_hashes(seq, np.zeros(4, dtype=np.int64)), np.array([3]))[0]
            np.testing.assert_allclose(np.exp(got), [p(lang, context, char) for lang in model.languages], rtol=1e-4)
            sums += np.exp(got)
        np.testing.assert_allclose(sums, 1, rtol=1e-4)  # over known characters and an unknown one


def test_many_languages(spark):
    """Five hundred values of lang, each with its own alphabet of a few letters; one document is long."""
    def text(i, n):
        rng = np.random.default_rng([i, n])
        return " ".join("".join(chr(0x4E00 + 5 * i + int(x)) for x in rng.integers(0, 5, 3)) for _ in range(40_000 if (i, n) == (3, 0) else 20))

    rows = [(8 * i + n, text(i, n), f"l{i:03}") for i in range(500) for n in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, limit = langid.train(docs)
    assert sum(len(m.value.languages) for m in model) == 500
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs, model, limit, ["doc_id"]).collect()}
    assert np.mean([found[i] == lang for i, _, lang in rows]) > 0.99


def test_groups_of_models_are_one_model(spark, odd):
    """A pass for each group of languages gives what one pass over all of them gives."""
    docs = documents(spark, SF2)
    whole, limit = langid.train(docs)
    parts, same = langid.train(docs, group_rows=1)
    assert len(whole) == 1 and len(parts) == len(whole[0].value.languages) == 4 and abs(limit - same) < 1e-4
    for df in (docs.select("doc_id", "text"), odd):
        got, want = (sorted((r.doc_id or -1, r.lang_pred) for r in langid.identify(df, m, limit, ["doc_id"]).collect()) for m in (parts, whole))
        assert got == want
    got, want = ({r.doc_id: r for r in langid.identify(docs, m, limit, ["doc_id"]).collect()} for m in (parts, whole))
    assert all(abs(got[i].score - want[i].score) < 1e-3 for i in want) and sum(got[i].accepted != want[i].accepted for i in want) == 0
    assert langid.language_groups([("a", 5), ("b", 4), ("c", 9), ("d", 20), ("e", 1)], 10) == [("a", "b"), ("c", "c"), ("d", "d"), ("e", "e")]


def test_rare_language_and_long_training_texts(spark, monkeypatch):
    """A value of lang that marks three of 150,003 documents is learned; bytes bound what a language sends, long texts come last."""
    common = spark.range(150_000).select(F.col("id").alias("doc_id"), F.lit("der hund und die katze").alias("text"), F.lit("de").alias("lang"))
    rare = spark.createDataFrame([(i, "ωραία μέρα σήμερα", "el") for i in range(200_000, 200_012)], "doc_id long, text string, lang string")
    models, limit = langid.train(common.unionByName(rare.limit(3)))
    assert [x for m in models for x in m.value.languages] == ["de", "el"]
    assert {r.lang_pred for r in langid.identify(rare, models, limit, ["doc_id"]).collect()} == {"el"}
    monkeypatch.setattr(langid, "LANGUAGE_BYTES", 1600)
    texts = [(8 * i, "ab " * (400 if i == 0 else 20), "x") for i in range(60)] + [(9000 + i, "cd " * 900, "y") for i in range(12)]
    sample = langid.train_sample(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect()
    sizes = {x: [len(r.text) for r in sample if r.lang == x] for x in "xy"}
    assert 1400 < sum(sizes["x"]) <= 1600 and max(sizes["x"]) == 60 and sizes["y"] == [2700]


def test_language_stage_drops_junk_and_keeps_the_rest(spark):
    docs = documents(spark, SF2).select("doc_id", "text", "lang")
    rng = np.random.default_rng(5)
    junk = [(10**6 + i, " ".join("".join(rng.choice(list("qwxzjkvpfg"), rng.integers(3, 9))) for _ in range(60)), None) for i in range(40)]
    mixed = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    kept = {r.doc_id for r in langid.language_stage(spark, mixed, "").select("doc_id").collect()}
    clean = docs.count()
    assert not kept & {i for i, _, _ in junk} and len(kept) > 0.995 * clean


# Pages


def test_page_parts():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar">
    <header><h2>Site</h2></header><nav><ul><li><a href="/a>b">It</a></ul></nav><!-- <p>no</p> --><p hidden>no</p><p style="display: none">no</p>
    <div class="wrap sidebar-left"><article><h1>Title &amp; more</h1><p><b>First &nbsp; par<br>next<br><p>Second &quot;par&quot; &#8364; <i>end</i>.
    <ul><li>one<li>two</ul></article></div><aside>side</aside><form><p>f</p></form><footer>x"""
    assert html_extract.extract(page).split("\n\n") == ["Title & more", "First par next", 'Second "par" € end.', "one", "two"]
    deep = "<div>" * 3000 + "deep"
    for odd, text in ((None, ""), ("", ""), ("plain < text &am", "plain < text &am"), ("<p>a</p>b<p>c", "a\n\nb\n\nc"), ("<p a='", "<p a='"), (deep, "deep")):
        assert html_extract.extract(odd) == text
    math = "<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><noscript><p>plain</p></noscript></article>"
    assert html_extract.extract(math) == "so x=1 holds\n\nplain"
    wrapped = "<form><div>f</div><article><p>own</p><form>g</form></article></form>"
    assert html_extract.extract(wrapped) == "own"


def test_names_delete_nothing_alone():
    for page, text in (
        ('<article class="post hentry comments-open"><p>own text</p></article>', "own text"),
        ('<body><div class="site no-ads"><p>own text</p></div></body>', "own text"),
        ('<article><p>a</p><section class="related-work"><p>b</p></section></article>', "a\n\nb"),
        ('<p>w <span class="ad">x<span>y</span>z</span> v</p>', "w xyz v"),
        ('<p>a</p><div class="comments"><p>b</p></div>', "a\n\nb"),
    ):
        assert html_extract.extract(page) == text
        blocks, _ = html_extract.parse(page)
        tree = {path: 0.85 for b in blocks for path, _, _ in b.parts}
        assert html_extract.extract(page, (tree, frozenset())) == {"w xyz v": "w v", "a\n\nb": "a\n\nb" if "related" in page else "a"}.get(text, text)
    left = html_extract.importance_left
    assert left("cookie-notice") == left("ad") == left("sidebar-left comments") == html_extract.NAMED < left("entry ad") < left("related-work") == left("") == 1


@pytest.mark.parametrize("piece,end", [("<div>", "</p>"), ("<div><b>", "</i></li>"), ("<li><div>", "</td>"), ("<p><span class='ad'>x", "</section>"), ("<a ", '"'), ("<td><i a='", "</th>")])
def test_a_badly_nested_page_takes_seconds(piece, end):
    page = piece * (500_000 // len(piece)) + "text" + end * (500_000 // len(end))
    began = time.perf_counter()
    html_extract.extract(page)
    assert time.perf_counter() - began < 20


def story(i):
    return (
        f"<html><body><div class='top'><p>Welcome to our site</p></div><div class='body'><p>Story {i} has words of its own {i * 7}.</p>"
        f"<p>And more {i * 13}.</p></div><div class='end'><p>All rights</p></div></body></html>"
    )


def test_site_tree(spark):
    rows = [(i, f"http://host{i % 2}.example/{i}", story(i), "own") for i in range(24)]
    rows += [(100, None, story(100), ""), (102, "http://host0.example/y", None, ""), (5, rows[5][1], rows[5][2], ""), (None, rows[7][1], rows[7][2], "")]
    rows += [(101, "http://lone.example/x", "<html><body><main class='top'><p>Only page</p></main></body></html>", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = {(r.page_id, r.text, r.n_chars) for r in html_extract.extract_text(df).collect()}
    own = {i: f"Story {i} has words of its own {i * 7}.\n\nAnd more {i * 13}." for i in [*range(24), 100]}
    # Page 100 stands alone on its host: the tree of all hosts knows its layout.
    assert found == {(i, t, len(t)) for i, t in own.items()} | {(102, "", 0), (None, own[7], len(own[7])), (101, "Only page", 9)}
    assert html_extract.extract_text(df.limit(0)).count() == 0
    assert all(html_extract.extract(story(i)) != t for i, t in own.items())  # without the tree nothing goes


def test_tree_decides_inside_articles(spark):
    def page(i):
        return (
            f"<html><body><div><p>latest: item {i}</p></div><article><h1>Title {i}</h1><p>Text {i} of its own.</p><p>Share this with friends!</p><p>Further text {i * 3}.</p>"
            f"<div class='box'><p>Read our letter</p></div><div class='comments'><p>reader {i} says {i}</p></div><p>so <span class='ad'>buy {i % 3}</span> ends {i}.</p></article></body></html>"
        )

    rows = [(i, "http://a.example/", page(i)) for i in range(40)]
    found = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"Title {i}\n\nText {i} of its own.\n\nFurther text {i * 3}.\n\nso ends {i}." for i in range(40)}


def teaser(i):
    return (
        f"<html><body><nav>menu</nav><article><h2>Soon {i}</h2><p>A word {i}.</p></article><div class='story'><p>Story {i} is told here at length, {i * 7} times over.</p>"
        f"<p>It goes on with {i * 11} and ends with {i * 13}.</p></div><div><p>latest {i}</p></div><div class='promo'><p>buy {i} of these now, they are cheap, and {i} more besides</p></div>"
        f"<div class='end'><p>All rights are reserved by the owner of this site since it was made</p></div></body></html>"
    )


def test_story_beside_a_teaser_stays_by_its_importance(spark):
    rows = [(i, "http://t.example/", teaser(i)) for i in range(30)]
    found = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    story = "Story {0} is told here at length, {1} times over.\n\nIt goes on with {2} and ends with {3}."
    for i, text in found.items():
        assert story.format(i, i * 7, i * 11, i * 13) in text and f"Soon {i}" in text and "menu" not in text and "All rights" not in text and "cheap" not in text


def test_replaced_importances_change_the_text():
    """Which branch is the article follows from the importances of a page's nodes, not from its markup."""
    page = teaser(5)
    blocks, _ = html_extract.parse(page)
    story = {b.path for b in blocks if "Story" in b.text()}
    high = {b.path: 0.9 for b in blocks}
    texts = {
        name: html_extract.extract(page, (tree, frozenset()))
        for name, tree in {
            "high": high, "story low": high | dict.fromkeys(story, 0.1), "all low": dict.fromkeys(high, 0.1), "turned": {p: (0.9 if p in story else 0.2) for p in high}
        }.items()
    }
    assert len(set(texts.values())) == 4, texts
    assert "Story" in texts["high"] and "Story" not in texts["story low"] and "Story" in texts["turned"] and "latest" not in texts["turned"]


def slow_tree(pages):
    """Importance by (tree, path) from dictionaries over all pages."""
    styles, texts = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
    for url, page in pages:
        host = re.sub(r":\d+$", "", url.split("//")[1].split("/")[0]).lower()
        blocks, shown = html_extract.parse(page)
        for tree in (host, html_extract.EVERYWHERE):
            for path, style in shown.items():
                styles[tree, path][style].add((host, page))
            for b in blocks:
                texts[tree, b.path, b.parent][b.text()].add((host, page))
                for path, _, raw in b.parts:
                    if path != b.path:
                        texts[tree, path, b.path][raw].add((host, page))
    out = {}
    for tree, path in {k[:2] for k in texts}:
        m = sum(map(len, styles[tree, path].values()))
        if m < 5 or m < 0.01 * sum(map(len, styles[tree, 0].values())):
            continue
        nodes = {k[2]: v for k, v in texts.items() if k[:2] == (tree, path)}
        for parent, values in nodes.items():
            counts = [len(v) for v in styles[tree, parent].values()]
            n = sum(counts)
            layout = 1.0 if n == 1 else -sum(c / n * np.log(c / n) for c in counts) / np.log(n)
            content = 1 - np.mean([np.log(len(v)) / np.log(m) for v in values.values()])
            share = 0.9 ** len(counts)
            out[tree, path] = max(out.get((tree, path), -1), (1 - share) * layout + share * content)
    return out


def test_pages_query(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    pages = {r.page_id: r for r in df.collect()}
    want = slow_tree([(r.url, r.html) for r in pages.values()])
    got = {(r.tree, r.path): r.importance for r in html_extract.node_importance(html_extract.node_counts(df)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    rows = html_extract.op7_html_extraction(spark, SF).collect()
    assert {r.page_id for r in rows} == set(pages) and all(r.n_chars == len(r.text) for r in rows)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b), json.dumps(pages[r.page_id].html[:500])
        assert html_extract.extract(pages[r.page_id].html) != r.text  # the tree is what drops the adverts


# Pipeline


@pytest.mark.parametrize("own", [None, "64m"])
def test_pipeline_bounds_batches(spark, own):
    """Batches of whole texts are bounded in bytes, unless the session says how."""
    import corpus_pipeline

    session = spark.newSession()
    if own:
        session.conf.set(corpus_pipeline.BATCH, own)
    docs = session.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"), F.lit("s").alias("source"))
    out = corpus_pipeline.STAGES[-1][1](session, docs, "")
    assert out.count() == 3000

    def size(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)

    assert (max(r.n for r in docs.mapInArrow(size, "n long").collect()) < 6_000_000) == (own is None)


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "mixing", "byte_bpe"]
    docs = documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == documents(spark, SF).columns, name
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and all(len(r.ids) == r.n_tokens for r in rows)


def test_html_copies_do_not_empty_a_page(spark):
    """Groups of copies dominate one host; on another all pages hold one text."""
    page = "<html><body><div class='head'>{}</div><div class='story'>{}</div></body></html>"
    rows = [(i, "http://a.example/x", page.format(f"title {i % 2}", f"story number {i % 2}")) for i in range(40)]
    rows += [(100 + i, "http://b.example/x", page.format("one title", "one story") + f"<!-- {i} -->") for i in range(8)]
    found = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"title {i % 2}\n\nstory number {i % 2}" for i in range(40)} | {100 + i: "one title\n\none story" for i in range(8)}
