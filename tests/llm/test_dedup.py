"""SimHash, substring and embedding dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from helmwind.llm import embed_dedup, near_dup, simhash, substring_dedup
from helmwind.llm.common import documents, mix64
from helmwind.llm.components import connected_components
from tests.llm.conftest import SCHEMA, sentence

SF = "/root/testdata/sf0.001"


def closure(ids, linked):
    """Smallest id reachable, by id."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None]
    want = closure({x for e in real for x in e}, real)
    assert found == {i: c for i, c in want.items() if i != c}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_simhash(rows):
    fp = {(i, t): slow_fingerprint(t) for i, t in rows}
    ids = {i for i, _ in rows if i is not None}
    known = [(i, f) for (i, _), f in fp.items() if i is not None]
    linked = [(a, b) for n, (a, x) in enumerate(known) for b, y in known[:n] if bin(x ^ y).count("1") <= 2]
    return fp, closure(ids, linked)


def check_simhash(df, rows):
    fp, comp = slow_simhash(rows)
    found = simhash.simhash_components(df).collect()
    want = Counter((i, fp[i, t] - (1 << 64) if fp[i, t] >> 63 else fp[i, t], None if i is None else comp[i]) for i, t in rows)
    assert Counter((r.doc_id, r.fp, r.component_id) for r in found) == want


def test_simhash_near_copies(spark):
    rng = random.Random(2)
    rows = []
    for group in range(12):
        base = sentence(rng, 250).split()
        for copy in range(6):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(250)] = "zz"
            rows.append((100 * group + copy, " ".join(words)))
    check_simhash(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_simhash_odd(odd, odd_rows, clashing, nothing):
    rows = [(r[0], r[1]) for r in odd_rows]
    check_simhash(odd, rows)
    check_simhash(clashing, rows)
    assert simhash.simhash_components(nothing).count() == 0


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF).collect()]
    fp, comp = slow_simhash(rows)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash_near_dedup(spark, SF).collect()}
    assert found == {i: (f"{fp[i, t]:016x}", comp[i]) for i, t in rows}


@pytest.mark.parametrize("m", [2, 5, 64, 65, 700])
def test_bit_sliced_comparison(m):
    rng = np.random.default_rng(m)
    base = rng.integers(0, 1 << 63, size=3, dtype=np.uint64)
    values = np.unique([int(base[rng.integers(3)]) ^ int(np.bitwise_or.reduce(1 << rng.integers(0, 16, size=rng.integers(1, 4)))) for _ in range(m)]).astype(np.uint64)
    got = {p for r, c in simhash._within(values, 2, tile=64) for p in zip(r.tolist(), c.tolist())}
    assert got == {(i, j) for i in range(len(values)) for j in range(i) if bin(int(values[i]) ^ int(values[j])).count("1") <= 2}


def test_near_dedup_stage(spark, odd, clashing):
    clashing = clashing.withColumns({c: F.lit("own") for c in ("gone", "gone_", "__gone", "id", "sig")})
    kept = simhash.near_dedup_stage(spark, clashing, "")
    assert simhash.near_dedup_stage(spark, clashing.limit(0), "").count() == 0
    assert kept.columns == clashing.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[12] == 0  # equal but for case
    assert ids[8] == 2 and ids[None] == 1 and ids[2] == 1 and ids[3] == ids[4] == 0  # wordless texts are one group


def five_words(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("tile", [1024, 16])
def test_near_dedup_stage_links_by_similarity(spark, monkeypatch, tile):
    """Pairs about a similarity of 0.8, most of them far over radius 2, against brute force."""
    monkeypatch.setattr(near_dup, "TILE", tile)
    rng = random.Random(5)
    texts, line = [], sentence(rng, 12)
    for group in range(14):
        base = sentence(rng, rng.choice([9, 40, 150, 400])).split()
        for _ in range(7):
            words = list(base)
            for _ in range(rng.randrange(1 + len(base) // 25)):
                words[rng.randrange(len(words))] = "zz"
            texts.append(" ".join(words[rng.randrange(3) :]))
    texts += [f"{sentence(rng, 30)} {line} {sentence(rng, 30)}" for _ in range(30)]  # a common line links nothing
    texts += ["Four words of text", "four words OF text", "four words of texts", None, "", " "]
    rng.shuffle(texts)
    sets = [five_words(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = closure(range(len(texts)), linked)
    assert sum(bin(slow_fingerprint(texts[i]) ^ slow_fingerprint(texts[j])).count("1") > 2 for i, j in linked) > 20
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.shingle_components(rows).collect()} == want
    assert {r.doc_id for r in simhash.near_dedup_stage(spark, rows, "").collect()} == set(want.values())


def test_near_dedup_stage_links_by_fingerprint(spark):
    """Texts within the radius of SimHash whose sets of shingles differ, as what they share repeats."""
    rng = random.Random(8)
    base = sentence(rng, 21) + " "
    texts = [base * 400 + " ".join(f"{side}{i}" for i in range(30)) for side in ("left", "right")] + [sentence(rng, 40)]
    x, y, _ = map(five_words, texts)
    assert 5 * len(x & y) < 4 * len(x | y)
    assert bin(slow_fingerprint(texts[0]) ^ slow_fingerprint(texts[1])).count("1") <= 2
    # An id with two texts ties nothing but its own links.
    rows = spark.createDataFrame([*enumerate(texts), (7, texts[0]), (7, texts[2])], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_dedup_stage(spark, rows, "").collect()) == [0, 2]


def slow_substrings(rows, width=35):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[s : s + width]) for _, w in words for s in range(len(w) - width + 1))
    out = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if seen[tuple(w[s : s + width])] > 1:
                gone[s : s + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def check_substrings(df, rows):
    found = substring_dedup.repeated_words(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == slow_substrings(rows)


def test_substrings_odd(odd, odd_rows, clashing, nothing):
    rows = [(r[0], r[1]) for r in odd_rows]
    check_substrings(odd, rows)
    check_substrings(clashing, rows)
    assert substring_dedup.repeated_words(nothing).count() == 0


def test_substrings_overlaps_runs_and_periods(spark):
    rng = random.Random(3)
    rows, shared = [], [sentence(rng, n) for n in (34, 35, 36, 80, 200)]
    for i in range(60):
        parts = [sentence(rng, rng.randrange(30)) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(shared))
        parts.insert(rng.randrange(3), " ".join(rng.choice(shared).split()[rng.randrange(9) :]))
        if i % 7 == 0:
            parts.insert(1, "for " * rng.randrange(30, 90))
        if i % 11 == 0:
            parts.insert(1, "ab cd ef " * rng.randrange(5, 40))
        rows.append((i, " ".join(parts)))
    check_substrings(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_substring_query(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF).collect()]
    found = substring_dedup.op6_substring_dedup(spark, SF).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == slow_substrings(rows)


def test_symbols_recur_with_their_words():
    rng = np.random.default_rng(1)
    names = mix64(np.arange(1, 12).astype(np.uint64))
    core = names[rng.integers(0, 11, size=90)]
    docs = []
    for _ in range(30):
        docs.append(np.concatenate([names[rng.integers(0, 11, size=rng.integers(0, 40))], core[rng.integers(0, 9) :]]))
        docs.append(np.repeat(names[rng.integers(0, 3, size=9)], rng.integers(1, 6, size=9)))
    words, offsets = np.concatenate(docs), np.r_[0, np.cumsum([len(d) for d in docs])]
    checked = 0
    for symbols in substring_dedup.recompress(words, offsets):
        checked += recurs(docs, offsets, words, symbols)
    assert checked > 300


def recurs(docs, offsets, words, symbols):
    """Where the words of a symbol's range occur again, the symbol does; returns the number of places."""
    at, checked = {}, 0
    for s, a in zip(symbols.name.tolist(), symbols.low.tolist()):
        at.setdefault(s, set()).add(a)
    for s, a, b in zip(symbols.name.tolist(), symbols.low.tolist(), symbols.high.tolist()):
        if b - a > 35:
            continue
        for d, start in zip(docs, offsets.tolist()):
            for p in range(len(d) - (b - a) + 1):
                if (d[p : p + b - a] == words[a:b]).all():
                    checked += 1
                    assert start + p in at[s]
    return checked


def test_windows_are_told_apart_by_their_symbols():
    """The first hash of a window is that of its words, wherever it stands."""
    rng = np.random.default_rng(2)
    lines = [" ".join(rng.choice(list("abcdefg"), size=rng.integers(40, 90))) for _ in range(6)]
    lines += [" ".join(x.split()[rng.integers(9) :] + ["z"] * int(rng.integers(5))) for x in lines * 2] + ["a " * 70, "b " + "a " * 60]
    chunk = substring_dedup.Chunk(pa.table({"k": list(range(len(lines))), "doc_id": list(range(len(lines))), "text": lines}), 35)
    starts = np.flatnonzero(chunk.window_starts())
    first, second = chunk.windows(starts)
    words = [w for x in lines for w in x.split()]
    text = [tuple(words[i : i + 35]) for i in starts.tolist()]
    assert len(set(text)) < len(text) and len(set(zip(text, first.tolist()))) == len(set(text)) == len(set(first.tolist())) == len(set(second.tolist()))
    inside = sum((chunk.levels[-1].low >= s).any() and ((chunk.levels[-1].low >= s) & (chunk.levels[-1].high <= s + 35)).any() for s in starts.tolist())
    assert inside > 0.5 * len(starts)


@pytest.mark.parametrize("level", range(len(substring_dedup.LEVELS)))
def test_spark_rounds_rule_windows_out(spark, monkeypatch, level):
    """Each round asks for less than the one before would; a round that settles nothing leaves more to ask for."""
    docs = documents(spark, SF)
    chunk = substring_dedup.Chunk(docs.select(F.monotonically_increasing_id().alias("k"), "doc_id", "text").toArrow(), 35)
    everything = [len(chunk.asked(i).name) for i in range(len(substring_dedup.LEVELS))]
    windows = int(chunk.window_starts().sum())
    for i in range(level + 1):
        own = chunk.asked(i).name
        _, place, count = np.unique(own, return_inverse=True, return_counts=True)
        chunk.settle(i, count[place] > 1)
        if i + 1 < len(everything):
            assert len(chunk.asked(i + 1).name) < everything[i + 1]
    assert 0 < len(chunk.candidates()) < windows


def test_copies_of_a_row_spread_over_chunks(spark):
    text = sentence(random.Random(4), 80)
    rows = [(7, text)] * 300 + [(None, text)] * 200 + [(8, "short")]
    check_substrings(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    plan = substring_dedup.repeated_words(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(doc_id" not in plan and "monotonically_increasing_id" in plan


def test_names_go_on_by_digits(spark):
    """Three steps of four buckets give what one step gives, for both kinds of requests."""
    rng = random.Random(8)
    shared = [sentence(rng, 60) for _ in range(5)]
    rows = [(i, " ".join([sentence(rng, 50), rng.choice(shared), sentence(rng, 30)])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = substring_dedup.repeated_words(docs, chunk_bytes=600, fan=4, bucket_names=20)
    assert substring_dedup.steps_needed(sum(len(t) for _, t in rows) // 12, 4, 20) >= 3
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in few.collect()) == slow_substrings(rows)
    near = [(i, t if i % 3 else rows[i // 2][1]) for i, t in rows]
    texts = spark.createDataFrame(near, "doc_id long, text string")
    chunks = near_dup.materialise(
        texts.repartition(40).mapInArrow(near_dup._probes, "c long, ids array<long>, sigs array<binary>, sizes array<int>, probe binary"), "test-probes"
    )
    found = [{r.rep for r in near_dup._candidates(texts, chunks, fan, names).collect()} for fan, names in ((64, 1 << 20), (3, 50))]
    assert found[0] == found[1] and len(found[0]) > 10


def test_requests_grow_with_the_names():
    """Rows of all steps at 1, 5 and 25 times a table, buckets scaled down: at most a row per sender, bucket and step."""
    rng = np.random.default_rng(3)
    fan, per_bucket, rows = 8, 400, []
    for times in (1, 5, 25):
        chunks = 40 * times
        steps = substring_dedup.steps_needed(chunks * 200, fan, per_bucket)
        held = [(c, rng.integers(0, 1 << 63, size=200).astype(np.uint64) * np.uint64(2)) for c in range(chunks)]
        made, senders = 0, chunks
        for step in range(1, steps + 1):
            tables = [substring_dedup._requests(c, x, None, fan**step) for c, x in held]
            made += sum(t.num_rows for t in tables)
            groups, merged = -(-senders // fan), {}
            for t in tables:
                for c, b, hi in zip(*(t.column(k).to_pylist() for k in ("c", "bucket", "hi"))):
                    merged.setdefault((c % groups, b), []).append(np.frombuffer(hi, np.uint64))
            largest = max(sum(map(len, x)) for x in merged.values())
            assert step == steps or largest < 2 * 200
            held, senders = [(g, np.concatenate(x)) for (g, _), x in merged.items()], groups
        assert made <= chunks * fan * (steps + 0.5)
        rows.append(made / chunks / steps)
    assert max(rows) < 1.2 * min(rows)


def test_substring_stage(spark, clashing, odd_rows):
    out = substring_dedup.substring_stage(spark, clashing, "")
    assert out.columns == clashing.columns and out.count() == clashing.count()
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    plain = {r[0]: r[1] for r in odd_rows}
    assert texts[1][0] == plain[1] and texts[2][0] is None and texts[13] == ("", 0)
    assert texts[6][0] == " ".join(plain[6].split()[:20] + plain[6].split()[-20:]) and texts[6][1] == len(texts[6][0])


def slow_links(rows):
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v):
            return None
        v = np.array(v, dtype=float)
        return v / np.linalg.norm(v) if v.any() else None

    units = [unit(v) for _, v, _ in rows]
    links, linked = Counter(), []
    for a in range(len(rows)):
        for b in range(a):
            (i, _, x), (j, _, y) = rows[a], rows[b]
            if x is None or x != y or units[a] is None or units[b] is None or len(units[a]) != len(units[b]):
                continue
            if units[a] @ units[b] >= 0.98:
                links[a] += 1
                links[b] += 1
                linked.append((i, j))
    comp = closure({i for i, _, _ in rows}, linked)
    return Counter((i, links[n], comp[i], comp[i] == i) for n, (i, _, _) in enumerate(rows))


def check_links(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("own") for c in ("rep", "unit", "tile", "n_links")})
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    found = embed_dedup.embedding_links(df, **options).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == slow_links(rows)


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 64)
    rng = np.random.default_rng(0)
    rows = []
    for group in range(5):
        center = rng.standard_normal(32)
        for _ in range(160 if group == 0 else 12):
            v = center + rng.standard_normal(32) * 0.11
            rows.append((len(rows), (v * rng.uniform(0.5, 3)).tolist(), group % 2))
    rows += [(len(rows) + i, rng.standard_normal(32).tolist(), 1) for i in range(60)]
    rows += [(900 + i, rows[3][1], rows[3][2]) for i in range(7)]
    check_links(spark, rows, window=16)


def test_embedding_odd(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1), (8, [1.0, float("nan"), 3.0], 1),
        (9, [1.0, float("inf"), 3.0], 1), (10, [], 1), (11, [2.0, 4.0, 6.0], 1), (12, [1.0, 2.0], 1), (13, [-1.0, -2.0, -3.0], 1), (14, [1.0, 2.0, 3.1], 1),
    ]
    check_links(spark, rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed_dedup.embedding_links(empty).count() == 0


def test_embedding_query(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = embed_dedup.op10_embedding_near_dedup(spark, SF).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == slow_links(rows)


def test_recall_where_vectors_share_a_direction(spark):
    """50,000 vectors of one label with a median cosine of 0.95, 300 of them with a partner at 0.983: recall against brute force."""
    rng, n, dim, pairs = np.random.default_rng(3), 50_000, 64, 300
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    rest = rng.standard_normal((n, dim))
    rest[:, 0] = 0
    v = np.sqrt(0.05) * unit(rest)
    v[:, 0] = np.sqrt(0.95)
    other = rng.standard_normal((pairs, dim))
    other = unit(other - (other * v[:pairs]).sum(axis=1, keepdims=True) * v[:pairs])
    v[pairs : 2 * pairs] = 0.983 * v[:pairs] + np.sqrt(1 - 0.983**2) * other
    v = v.astype(np.float32)
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), dim).cast(pa.list_(pa.float32())), "label": np.ones(n, np.int32)})
    rows = embed_dedup.embedding_links(spark.createDataFrame(table)).select("vec_id", "component_id", "n_links").toPandas().sort_values("vec_id")
    component, u, linked = rows.component_id.to_numpy(), unit(v.astype(float)), []
    for s in range(0, n, 2000):
        a, b = np.nonzero(u[s : s + 2000] @ u.T >= 0.98)
        linked.append(np.stack([a + s, b])[:, a + s < b])
    a, b = np.concatenate(linked, axis=1)
    assert len(a) >= pairs and np.mean(component[a] == component[b]) >= 0.99
    counts = np.bincount(np.r_[a, b], minlength=n)
    assert (rows.n_links.to_numpy() <= counts).all() and rows.n_links.sum() >= 0.99 * counts.sum()


def close_vectors(n, dim, closeness, pairs, cosine, seed):
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    rest = rng.standard_normal((n, dim))
    rest[:, 0] = 0
    v = np.sqrt(1 - closeness) * unit(rest)
    v[:, 0] = np.sqrt(closeness)
    other = rng.standard_normal((pairs, dim))
    other = unit(other - (other * v[:pairs]).sum(axis=1, keepdims=True) * v[:pairs])
    v[pairs : 2 * pairs] = cosine * v[:pairs] + np.sqrt(1 - cosine**2) * other
    return v.astype(np.float32)


@pytest.mark.parametrize("n,closeness,window,whole", [(6000, 0.97, 4, True), (4000, 0.5, 8, False)])
def test_rare_links_of_close_vectors(spark, monkeypatch, n, closeness, window, whole):
    """A small window stands for a large table. Rare links are found although hardly any class has one: by whole labels where passes would be too many."""
    called = []
    real = embed_dedup.whole_edges
    monkeypatch.setattr(embed_dedup, "whole_edges", lambda *x: called.append(1) or real(*x))
    v = close_vectors(n, 96, closeness, 60, 0.981, 11)
    rows = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 96).cast(pa.list_(pa.float32())), "label": np.ones(n, np.int32)})
    found = embed_dedup.embedding_links(spark.createDataFrame(rows), window=window).toPandas().sort_values("vec_id")
    component = found["component_id"].to_numpy()
    assert np.mean(component[:60] == component[60:120]) >= 0.98 and bool(called) == whole
    assert (found["n_links"].to_numpy()[:60] >= 1).mean() >= 0.98


def test_planted_partners_measure_a_pass(spark):
    """With one pass few partners at the threshold are seen, with many nearly all; the label that sees too few is named."""
    v = close_vectors(3000, 64, 0.3, 1, 0.99, 2)
    rows = pa.table({"vec_id": np.arange(3000), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 64).cast(pa.list_(pa.float32())), "label": np.ones(3000, np.int32)})
    classes = embed_dedup.classes_of(spark.createDataFrame(rows)).persist()
    means = embed_dedup.label_passes(classes, 0.98, 8)
    planted = embed_dedup.with_planted(classes, means, 8).where("planted").count()
    assert 90 < planted < 170
    shares = []
    for passes in (1, 60):
        own = means.withColumn("passes", F.lit(passes))
        found = embed_dedup.sorted_passes(classes, own, 0.98, 8, 0, np.float32).persist()
        shares.append(found.where("b is null").select("a").distinct().count() / planted)
        assert embed_dedup.unseen_labels(classes, own, found, 8).isEmpty() == (shares[-1] >= embed_dedup.RECALL)
    assert shares[0] < 0.8 and shares[1] > 0.95
    assert embed_dedup.with_planted(classes, means, 3000).where("planted").isEmpty()
    units = embed_dedup._units(v[:20])
    near = embed_dedup.partners(units, np.arange(20), 0.98)
    np.testing.assert_allclose((units * near).sum(axis=1), 0.98, atol=1e-12)
    np.testing.assert_allclose(np.linalg.norm(near, axis=1), 1.0)


def test_neighbours_over_partition_ends(spark):
    """Sorted classes fall into several range partitions; pairs that these part are found."""
    rng = np.random.default_rng(8)
    rows = [(i, (v / np.linalg.norm(v)).tolist(), 0) for i, v in enumerate(1 + 0.004 * np.arange(60)[:, None] * np.eye(1, 8) + 1e-4 * rng.standard_normal((60, 8)))]
    classes = embed_dedup.classes_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    means = embed_dedup.label_passes(classes, 0.98, 60).withColumn("passes", F.lit(1))
    edges = embed_dedup.pass_edges(classes, means, 0.98, 60, 0, np.float64).collect()
    units = np.array([v for _, v, _ in rows])
    linked = [(i, j) for i in range(60) for j in range(i) if units[i] @ units[j] >= 0.98]
    assert closure(range(60), [(e.a, e.b) for e in edges]) == closure(range(60), linked)


def test_schema_constant():
    assert SCHEMA.startswith("doc_id")
