"""Properties of the numpy helpers on generated inputs."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from helmwind.llm import bpe, html_extract, mixing, quality_rules, simhash
from helmwind.llm.common import text_buffer, word_spans

TEXT = st.text(st.one_of(st.sampled_from(" \t\n\x0b\x0c\rabAB#é日𝒳  "), st.characters(exclude_categories=["Cs"])), max_size=60)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CODER = bpe.ByteBpe(bpe.read_vocabulary(public_tokenizers.path(bpe.VOCABULARY)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words(texts):
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    starts, ends, at = word_spans(data, offsets)
    raw = data.tobytes()
    words = [raw[s:e].decode() for s, e in zip(starts, ends)]
    want = [WORD.findall(t or "") for t in texts]
    assert words == [w for ws in want for w in ws] and np.diff(at).tolist() == [len(w) for w in want]


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_tokens_round_trip(text):
    assert CODER.decode(CODER.encode(text)) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=12))
def test_targets(sizes):
    weights = [float(1 + i % 3) for i in range(len(sizes))]
    got = mixing.targets_of(sizes, weights)
    assert abs(sum(got) - sum(sizes)) <= 1e-6 * max(sum(sizes), 1)
    assert all(t <= 3 * s + 1e-6 for t, s in zip(got, sizes))
    free = [t / w for t, s, w in zip(got, sizes, weights) if s and t < 3 * s - 1e-6]
    assert not free or max(free) - min(free) <= 1e-6 * max(free)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 99))
def test_tree(quotas, shards, seed):
    dealt = mixing.split_quotas(np.array(quotas), shards, seed)
    assert (dealt >= 0).all() and dealt.sum(axis=0).tolist() == quotas
    totals = dealt.sum(axis=1)
    assert totals.max() - totals.min() <= np.ceil(np.log2(shards)) + 1 if shards > 1 else True


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=80, unique=True), st.data())
def test_links(values, data):
    near = [v ^ (1 << data.draw(st.integers(0, 63))) ^ (1 << data.draw(st.integers(0, 63))) for v in values[:10]]
    values = np.array(sorted({*values, *near}), dtype=np.uint64)
    got = {p for r, c in simhash._within(values, 2, tile=16) for p in zip(r.tolist(), c.tolist())}
    assert got == {(i, j) for i in range(len(values)) for j in range(i) if bin(int(values[i]) ^ int(values[j])).count("1") <= 2}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), min_size=1, max_size=4))
def test_repeated_windows(rows):
    texts = [" ".join(r) for r in rows]
    got = quality_rules.base_counts(*text_buffer(pa.array(texts)))["n_repeat_words"].tolist()
    for words, n in zip(rows, got):
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = set()
        for i in range(len(words) - 7):
            if seen[tuple(words[i : i + 8])] > 1:
                hit.update(range(i, i + 8))
        assert n == len(hit)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("<>/!-pabdiv='\" &;\n"), max_size=80))
def test_any_page_parses(page):
    text = html_extract.extract(page)
    assert all(b and b == " ".join(b.split()) for b in text.split("\n\n")) or text == ""
