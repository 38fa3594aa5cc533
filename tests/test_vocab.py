import itertools
import math
import random
from collections import Counter

import pytest

from tagweave.operators import vocab


def bpe_by_hand(chunks, merges):
    states = {c: list(c) for c in chunks}
    rules, made = [], set()
    while len(made) < merges:
        pairs = Counter()
        for c, s in states.items():
            for pair in zip(s, s[1:]):
                pairs[pair] += chunks[c]
        if not pairs:
            break
        a, b = min(pairs, key=lambda p: (-pairs[p], len(p[0] + p[1]), p[0] + p[1], p[0]))
        rules.append((a, b))
        made.add(a + b)
        for c, s in states.items():
            out, i = [], 0
            while i < len(s):
                step = 2 if s[i:i + 2] == [a, b] else 1
                out.append("".join(s[i:i + step]))
                i += step
            states[c] = out
    return rules


def frame(spark, chunks):
    return spark.createDataFrame(list(chunks.items()), "chunk string, count long")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merges_in_rounds_equal_one_at_a_time(spark, seed, monkeypatch):
    rng = random.Random(seed)
    letters = "ab" if seed == 3 else "abcdef"
    chunks = {"".join(rng.choices(letters, k=rng.randrange(1, 9))): rng.randrange(1, 9) for _ in range(60)}
    monkeypatch.setattr(vocab, "_PENDING", 7)
    monkeypatch.setattr(vocab, "_SAMPLE", 20)
    rules = vocab.train_bpe(frame(spark, chunks), 20)
    assert rules == bpe_by_hand(chunks, 20)
    assert rules[:8] == vocab.train_bpe(frame(spark, chunks), 8, batch=False)


@pytest.mark.parametrize("held", [6, 40])
def test_few_held_counts_change_nothing(spark, held, monkeypatch):
    """The driver may hold any number of pairs; beyond them it counts anew. Poor guesses cost rounds only."""
    rng = random.Random(held)
    chunks = {"".join(rng.choices("abcd", k=rng.randrange(2, 12))): rng.randrange(1, 4) for _ in range(50)}
    monkeypatch.setattr(vocab, "_SAMPLE", 5)
    assert vocab.train_bpe(frame(spark, chunks), 15, held=held) == bpe_by_hand(chunks, 15)


def test_the_driver_holds_a_bounded_number_of_pairs(spark, monkeypatch):
    """Also where the corpus begins with fewer pairs than are held and merges add the others."""
    rng = random.Random(3)
    chunks = {"".join(rng.choices("abcd", k=30)): rng.randrange(1, 9) for _ in range(60)}
    seen = []
    guesses = vocab._Sample.guesses
    monkeypatch.setattr(vocab._Sample, "guesses", lambda self, best, allowed, counts, many: seen.append(len(counts)) or guesses(self, best, allowed, counts, many))
    monkeypatch.setattr(vocab, "_GUESSES", 4)
    assert vocab.train_bpe(frame(spark, chunks), 24, held=20) == bpe_by_hand(chunks, 24)
    assert max(seen) <= 40


def test_merges_by_arrays(spark):
    """Runs of one symbol, chunks side by side, merges that make the symbols of later ones: all pair counts are those counted anew."""
    import pyarrow as pa
    words, counts = ["aaaa", "aaabaab", "a", "", "babab", "aab"], [3, 1, 4, 1, 5, 9]
    symbols = pa.array([list(w) for w in words], pa.list_(pa.string()))
    plain, names = [list(w) for w in words], {}
    laid = vocab._Laid(symbols, pa.array(counts), names)
    for left, right in [("a", "a"), ("aa", "aa"), ("aa", "b"), ("b", "a"), ("x", "y"), ("ba", "b")]:
        before = bpe_pairs(plain, counts)
        plain = [vocab._merged(p, left, right) for p in plain]
        wanted = {k: n for k, n in ((k, bpe_pairs(plain, counts).get(k, 0) - before.get(k, 0)) for k in {*before, *bpe_pairs(plain, counts)}) if n}
        changed = []
        laid.merge(left, right, changed)
        pairs, sums = vocab._summed(changed)
        assert dict(zip(zip(*(c.to_pylist() for c in vocab._named(pairs, names))), sums.tolist())) == wanted
        assert laid.symbols().to_pylist() == plain


def bpe_pairs(states, counts):
    out = {}
    for symbols, n in zip(states, counts):
        for pair in zip(symbols, symbols[1:]):
            out[pair] = out.get(pair, 0) + n
    return out


def test_lookups_by_the_index_find_every_chunk(spark, monkeypatch):
    """With every round answered from the index, and with symbols of control characters, which are letters like others."""
    rng = random.Random(5)
    chunks = {"".join(rng.choices("a\x01\x02b😀e\u0301", k=rng.randrange(1, 9))): rng.randrange(1, 9) for _ in range(40)}
    monkeypatch.setattr(vocab, "_SCAN", 0)
    assert vocab.train_bpe(frame(spark, chunks), 15) == bpe_by_hand(chunks, 15)


def test_two_hundred_merges_of_the_corpus(spark):
    chunks = {r.chunk: r["count"] for r in vocab.chunk_counts(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)).collect()}
    assert vocab.train_bpe(frame(spark, chunks), 200) == bpe_by_hand(chunks, 200)


def test_chunks_end_at_marks_and_symbols(spark):
    df = spark.createDataFrame([("ab་cd (x) ab་",)], "text string")
    got = {r.chunk: r["count"] for r in vocab.chunk_counts(df, marks=("་",)).collect()}
    assert got == {"▁ab་": 2, "cd": 1, "▁": 1, "x": 1}


def test_characters_outside_the_alphabet_are_not_merged(spark):
    rules = vocab.train_bpe(frame(spark, {"abz": 9, "ab": 1}), 5, allowed=["a", "b"])
    assert rules == [("a", "b")]
