import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tagweave.operators import examples


def sequences(spark, n=40):
    rng = random.Random(3)
    return spark.createDataFrame([(i, 0, [2] + [rng.randrange(5, 500) for _ in range(rng.randrange(1, 150))] + [3])
                                  for i in range(n)], "doc_id int, seq_no long, tokens array<int>")


def test_masks(spark):
    df = sequences(spark)
    rows = examples.mask_tokens(df, 500).collect()
    chosen = kept = 0
    for r in rows:
        wanted = min(20, max(1, round(len(r.tokens) * 0.15)))
        assert 1 <= len(r.positions) <= wanted and r.positions == sorted(set(r.positions))
        assert all(r.tokens[p] == o and r.tokens[p] not in (2, 3) for p, o in zip(r.positions, r.originals))
        assert all(a == b for i, (a, b) in enumerate(zip(r.tokens, r.masked)) if i not in r.positions)
        chosen += len(r.positions)
        kept += sum(r.masked[p] == 4 for p in r.positions)
    assert 0.65 < kept / chosen < 0.95
    again = examples.mask_tokens(df.repartition(5), 500).collect()
    assert {r.doc_id: r.masked for r in rows} == {r.doc_id: r.masked for r in again}
    other = examples.mask_tokens(df, 500, seed=1).collect()
    assert {r.doc_id: r.masked for r in rows} != {r.doc_id: r.masked for r in other}


def masks_by_hand(key, tokens, special, seed, limits, ngram, prob, max_pred):
    """Positions by rank of the draws, one n-gram after the other."""
    def draw(*parts):
        return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)
    left = min(max_pred, max(1, round(len(tokens) * prob)), len(tokens))
    taken = set()
    for h, i in sorted((draw(key, i, f"{seed}-mask"), i) for i in range(len(tokens))):
        n = next((k for k, limit in enumerate(limits, 1) if h % 1_000_000 < limit), ngram)
        span = range(i, i + min(n, left))
        if left and span[-1] < len(tokens) and not taken & set(span) and not any(tokens[p] in special for p in span):
            taken |= set(span)
            left -= len(span)
    return sorted(taken)


@pytest.mark.parametrize("ngram,short,max_pred", [(3, False, 20), (3, True, 20), (1, False, 5), (5, False, 8)])
def test_masks_equal_one_ngram_after_the_other(spark, ngram, short, max_pred):
    df = sequences(spark).union(spark.createDataFrame([(90, 0, []), (91, 0, [2]), (92, 0, [7]), (93, 1, [2, 9, 3] * 60)],
                                                      "doc_id int, seq_no long, tokens array<int>"))
    limits = examples._length_limits(ngram, short)
    rows = examples.mask_tokens(df, 500, ngram=ngram, favor_short=short, max_pred=max_pred).collect()
    for r in rows:
        assert r.positions == masks_by_hand(f"{r.doc_id}|{r.seq_no}", r.tokens, (0, 2, 3, 4), 12345, limits, ngram, 0.15, max_pred)
        assert len(r.masked) == len(r.tokens)
    assert {r.doc_id for r in rows if not r.positions} == {90, 91}


def test_longer_grams_are_favoured_unless_told_otherwise(spark):
    df = sequences(spark, 200)
    def single(short):
        rows = examples.mask_tokens(df, 500, favor_short=short).collect()
        return sum(p - 1 not in r.positions and p + 1 not in r.positions for r in rows for p in r.positions)
    assert single(True) > single(False)


def test_windows_lose_nothing(spark):
    df = spark.createDataFrame([(d, i, list(range(100 * i, 100 * i + 7))) for d in range(3) for i in range(30)],
                               "doc_id int, line_no long, tokens array<int>").repartition(4)
    rows = examples.mlm_windows(df, 16, 0.5, 1, block=4).orderBy("doc_id", "seq_no", "half").collect()
    for d in range(3):
        mine = [r for r in rows if r.doc_id == d]
        assert [t for r in mine for t in r.tokens] == [t for i in range(30) for t in range(100 * i, 100 * i + 7)]
        assert all(0 < len(r.tokens) <= 16 for r in mine)
    assert any(r.half == 1 for r in rows)


def test_packing(spark):
    df = spark.createDataFrame([(0, i, [i] * 3, [str(i)] * 3) for i in range(5)],
                               "doc_id int, example_no long, tokens array<int>, labels array<string>")
    whole = examples.pack_examples(df, 4, block=2).orderBy("seq_no").collect()
    assert [r.tokens for r in whole] == [[0, 0, 0, 1, 1, 1], [2, 2, 2], [3, 3, 3, ], [4, 4, 4]]
    cut = examples.pack_examples(df, 4, whole=False, block=2).orderBy("seq_no").collect()
    assert [r.tokens for r in cut] == [[0, 0, 0, 1], [1, 1, 2, 2], [2, 3, 3, 3], [4, 4, 4]]
    assert cut[0].labels == ["0", "0", "0", "1"]


def test_padding(spark):
    df = spark.createDataFrame([([1, 2, 3], [7, 8, 9]), ([1], [7])], "tokens array<int>, label_ids array<int>")
    rows = examples.truncate_pad(df, 2).collect()
    assert tuple(rows[0]) == ([1, 2], [7, 8], [1, 1], [0, 0], 1)
    assert tuple(rows[1]) == ([1, 0], [7, -100], [1, 0], [0, 0], 0)


def test_walks_and_copies(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "word_idx int")
    assert sorted(map(tuple, examples.walks(df, 1, 3).collect())) == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (4, 0), (4, 1)]
    assert examples.dupe(df, 4).count() == 20


def test_piece_labels(spark):
    df = spark.createDataFrame([(0, [5, 6], "N")], "word_pos int, tokens array<int>, tag string")
    assert [r.label for r in examples.word_piece_labels(df).orderBy("piece").collect()] == ["N", None]
    assert [r.label for r in examples.word_piece_labels(df, True).orderBy("piece").collect()] == ["N", "[MASK]"]
    nested = spark.createDataFrame([([[5, 6], [7], []], ["N", "V", "X"])], "tokens array<array<int>>, tags array<string>")
    assert tuple(examples.spread_labels(nested).first()) == ([5, 6, 7], ["N", "[MASK]", "V"])


def test_pairs(spark):
    df = spark.createDataFrame([(d, i, [i]) for d in range(20) for i in range(4)], "doc_id int, seg_no int, tokens array<int>")
    rows = examples.sentence_order_pairs(df).collect()
    assert len(rows) == 60 and {r.is_swapped for r in rows} == {0, 1}
    for r in rows:
        a, b = (r.second, r.first) if r.is_swapped else (r.first, r.second)
        assert (a, b) == ([r.seg_no], [r.seg_no + 1])


def test_label_map(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("[MASK]",), (None,)], "label string")
    rows = examples.build_label_map(df, extra=["[MASK]", "UNK"]).orderBy("label_id").collect()
    assert [tuple(r) for r in rows] == [(0, "a"), (1, "b"), (2, "[MASK]"), (3, "UNK")]
    assert df.filter(F.col("label").isNull()).count() == 1
