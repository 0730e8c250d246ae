import random

import numpy as np
import pytest

import brute
from kolumna.llm import bwt, near_dup, suffix_dedup
from kolumna.llm.components import components


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("length", [1, 3, 20])
def test_interval_expansion_against_counting(length):
    from collections import Counter

    rng = random.Random(length)
    for round_ in range(30):
        strings = [bytes(rng.choice(b"abc"[: 2 + round_ % 2]) for _ in range(rng.randint(length, 60))) for _ in range(rng.randint(1, 5))] + [b"a" * 50] * (round_ % 3 == 0)
        offsets, shared, classes = bwt.repeats(strings, length)
        count = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        seen = {}
        for k, s in enumerate(strings):
            for i in range(len(s) - length + 1):
                at = offsets[k] + i
                assert shared[at] == (count[s[i : i + length]] > 1)
                assert seen.setdefault(s[i : i + length], classes[at]) == classes[at]
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("how", [{}, {"hot": 1, "block": 2000}])
def test_removal_of_odd_rows(odd_docs, odd_rows, how):
    got = sorted((tuple(r) for r in suffix_dedup.removal_report(odd_docs, **how).collect()), key=key)
    want = sorted(((r[0], *x) for r, x in zip(odd_rows, brute.removal([r[1] for r in odd_rows]))), key=key)
    assert got == want


def test_removal_of_made_texts(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "éa", "漢"]
    passages = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    texts = [" ".join(rng.choice([*passages, *words, str(rng.random())]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(map(tuple, suffix_dedup.removal_report(docs, hot=3, block=5000).collect()))
    assert got == [(i, *x) for i, x in enumerate(brute.removal(texts))]


def test_long_runs_are_cut(spark, monkeypatch):
    """Texts of one repeated phrase, of long lines with one beginning, and of parts that overlap the borders of segments."""
    rng = random.Random(6)
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    tail = "".join(rng.choice("abcdefgh") for _ in range(3000))
    texts = ["ab" * 1500, "abc" * 900 + tail, "x" + "ab" * 700, tail[500:1900] + "!", "y" * 2500, "".join(f"the same beginning of each line {rng.random()}\n" for _ in range(60)), "z" + tail[:1100]]
    for t in texts:
        ((_, _, (_, start, size, _, _)),) = suffix_dedup._segments(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 200)
        assert size.max() <= 64 and sorted(np.concatenate([np.arange(a, a + n) for a, n in zip(start, size)]).tolist()) == list(range(len(t) - 199))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = [(i, *x) for i, x in enumerate(brute.removal(texts))]
    for how in ({}, {"hot": 2, "block": 2000}):
        assert sorted(map(tuple, suffix_dedup.removal_report(docs, **how).collect())) == want


def test_twenty_megabytes_of_one_phrase(spark):
    text = "pad " * 5_000_000
    got = {r["doc_id"]: r for r in suffix_dedup.removal_report(spark.createDataFrame([(1, text), (2, "another text, " + "pad " * 60), (3, "short")], "doc_id bigint, text string")).collect()}
    assert got[1]["n_removed"] == len(text) and got[1]["n_spans"] == 1 and got[3]["n_removed"] == 0
    assert got[2]["n_removed"] == 241 and got[2]["n_bytes"] == 254


def test_kept_bytes_and_clashing_columns(clashing, odd_rows):
    out = suffix_dedup.without_repeats(clashing)
    assert sorted(out.columns) == sorted(clashing.columns)
    import hashlib

    got = sorted(hashlib.sha256(bytes(r["kept"])).hexdigest() for r in out.select("kept").collect())
    assert got == sorted(x[3] for x in brute.removal([r[1] for r in odd_rows]))


def test_empty_tables(no_docs):
    assert suffix_dedup.removal_report(no_docs).collect() == []
    assert near_dup.near_duplicates(no_docs).collect() == []
    assert near_dup.one_of_each(no_docs).collect() == []


@pytest.mark.parametrize("size", [2, 5])
def test_near_groups_of_odd_rows(odd_docs, odd_rows, size):
    got = sorted((tuple(r) for r in near_dup.near_duplicates(odd_docs, shingle=size, block=2).collect()), key=key)
    assert got == sorted(brute.near_groups([r[:2] for r in odd_rows], size), key=key)


def test_near_groups_about_the_threshold(spark):
    rng = random.Random(11)
    base = [[f"{g}w{rng.randrange(400)}" for _ in range(150)] for g in range(3)]
    texts = []
    for k in range(150):
        words = list(base[k % 3])
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(150)] = f"n{rng.random()}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted(map(tuple, near_dup.near_duplicates(docs, shingle=2, block=16).collect()))
    assert got == sorted(brute.near_groups(rows, 2))


def test_odd_sketches_never_differ_more_than_their_sets():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 2**64, rng.integers(1, 80), dtype=np.uint64)]))
        x, y = (np.frombuffer(near_dup.parity(s), np.uint64) for s in (a, b))
        least = min(len(x), len(y))
        bits = int(np.bitwise_count(near_dup._fold(x, least) ^ near_dup._fold(y, least)).sum())
        assert bits <= len(np.setxor1d(a, b)) and bits % 2 == len(np.setxor1d(a, b)) % 2


def test_sketches_estimate_high_similarity():
    rng = np.random.default_rng(2)
    off = []
    for _ in range(60):
        a = rng.integers(0, 2**64, 500, dtype=np.uint64)
        b = np.concatenate([a[:450], rng.integers(0, 2**64, 50, dtype=np.uint64)])
        x, y = (near_dup.bands_and_sketch(near_dup.samples(s))[1].view(np.uint64) for s in (a, b))
        differ = int(np.bitwise_count(x ^ y).sum())
        off.append(1 + near_dup.SKETCH_BITS / (4 * near_dup.SAMPLES) * np.log(1 - 2 * differ / near_dup.SKETCH_BITS) - 450 / 550)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_one_of_each_keeps_columns(clashing, odd_rows):
    out = near_dup.one_of_each(clashing)
    assert out.columns == clashing.columns
    groups = brute.near_groups([r[:2] for r in odd_rows], 5)
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({g[0] for g in groups if g[0] is not None and g[3]})
    assert ids.count(None) == 2


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {x: find(x) for a, b in links for x in (a, b) if a != b}
