import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagweave.operators import joins, metrics, stats
from tagweave.operators.tags import IGNORED


@pytest.fixture
def pairs():
    rng = random.Random(11)
    return [(rng.choice([0, 1, 2, 4]), rng.choice([0, 1, 2, 5])) for _ in range(300)]


def by_hand(pairs, label):
    tp = sum(t == p == label for t, p in pairs)
    truth, predicted = sum(t == label for t, _ in pairs), sum(p == label for _, p in pairs)
    precision, recall = tp / predicted if predicted else 0.0, tp / truth if truth else 0.0
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    return precision, recall, f1, truth


@pytest.mark.parametrize("swap", [False, True])
def test_per_label_and_weighted(spark, pairs, swap):
    df = spark.createDataFrame(pairs, "label int, pred int")
    confusion = metrics.confusion_counts(df)
    labels = spark.range(0, 7).select(F.col("id").cast("int").alias("label"))
    pairs = [(p, t) for t, p in pairs] if swap else pairs
    want = {i: by_hand(pairs, i) for i in range(7)}
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in
           metrics.prf_per_label(confusion, labels, swap=swap).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i]) for i in want)
    assert sum(v[3] for v in got.values()) == len(pairs)
    weighted = metrics.prf_weighted(confusion, swap).first()
    for k, name in enumerate(("precision", "recall", "f1")):
        assert weighted[name] == pytest.approx(sum(v[k] * v[3] for v in want.values()) / len(pairs))


def test_report_shares(spark):
    rows = [(0, 0, 6), (1, 1, 3), (6, 6, 11)]
    confusion = spark.createDataFrame(rows, "label int, pred int, count long")
    labels = spark.createDataFrame([(i,) for i in range(9)], "label int")
    report = metrics.metrics_report(metrics.prf_per_label(confusion, labels), {0: "N", 1: "V", 6: "[MASK]"})
    got = {r.label_id: r for r in metrics.sorted_report(report).collect()}
    assert list(got)[:3] == [6, 0, 1]
    assert got[6].support_share == 11 / 20 and got[0].support_share == 6 / 9 and got[3].tag == metrics.NO_NAME
    assert metrics.report_totals(report).first().f1 == pytest.approx(1.0)


def sequences(spark, data):
    rows = [(e, i, lab, pred) for e, (labels, preds) in data.items() for i, (lab, pred) in enumerate(zip(labels, preds))]
    return spark.createDataFrame(rows, "example_id string, pos long, label int, pred int").repartition(3)


def test_word_accuracy(spark):
    data = {"a": ([4, 1, 4, 2, 4], [1, 1, 4, 2, 9]), "b": ([1, 4, 4, 3], [1, 4, 4, 0])}
    rows = sequences(spark, data)
    assert tuple(metrics.word_accuracy(rows, 4, block=2).first()) == (2, 4, 0.5)
    assert tuple(metrics.word_accuracy(rows, 4, faithful=True, block=2).first()) == (2, 3, 2 / 3)


def test_ffill(spark):
    data = {"a": ([4, 4, 1, 4, 2, 4, 4], [0] * 7), "masks": ([4, 4], [0, 0]), "padded": ([1, -100, -100], [0] * 3)}
    got = {}
    for r in metrics.ffill_labels(sequences(spark, data), 4, block=2).orderBy("example_id", "pos").collect():
        got.setdefault(r.example_id, []).append(r.label)
    assert got == {"a": [IGNORED, IGNORED, 1, 1, 2, 2, 2], "masks": [IGNORED] * 2, "padded": [1, -100, -100]}


def test_char_coverage(spark):
    counts = spark.createDataFrame([("a", 90), ("b", 6), ("c", 3), ("d", 1)], "char string, count long")
    chosen = lambda share: sorted(r.char for r in stats.char_coverage(counts, share).collect())
    assert chosen(0.9) == ["a"] and chosen(0.95) == ["a", "b"] and chosen(1.0) == list("abcd")


def test_shares_by_part(spark):
    df = spark.createDataFrame([("x", 1), ("x", 3), ("y", 5)], "p string, support long")
    assert sorted(r.support_share for r in stats.support_share(df, part=["p"]).collect()) == [0.25, 0.75, 1.0]


def test_scopes_by_a_plain_loop(spark):
    rng = random.Random(3)
    rows = []
    for e in range(30):
        for i in range(rng.randint(0, 12)):
            n = rng.randint(1, 3)
            labels = [rng.choice("ab")] + ["m"] * (n - 1)
            rows.append((f"e{e}", i, rng.choice(["p", "q", "r", "s", "t", None]), list(range(n)),
                         [rng.choice("abm") for _ in range(n)], labels, e % 5 == 0))
    rows = [r for r in rows if not r[6] or r[2] in ("p", "q")]
    schema = "example_id string, word_pos int, key string, tokens array<int>, predictions array<string>, labels array<string>, t boolean"
    known = {r[2] for r in rows if r[6]}
    want, met = Counter(), set()
    for e, _, key, _, preds, labels, trained in rows:
        if trained:
            continue
        first = (e, key) not in met
        met.add((e, key))
        for pair in zip(labels, preds):
            want["all", *pair] += 1
            if key in known:
                want["seen", *pair] += 1
            elif first:
                want["unseen", *pair] += 1
    df = spark.createDataFrame(rows, schema).repartition(5)
    counts = metrics.scoped_confusion(joins.occurrence_counts(df, F.col("t")))
    assert {(r.scope, r.label, r.pred): r["count"] for r in counts.collect()} == want
    empty = joins.occurrence_counts(df.filter("false"), F.col("t"))
    assert metrics.scoped_confusion(empty).count() == 0
    labels = metrics.labels_of_scopes(spark.createDataFrame([("a",), ("z",)], "label string"))
    per = {(r.scope, r.label): r.support for r in metrics.prf_per_label(counts, labels, by="scope").collect()}
    assert len(per) == 6 and per["unseen", "z"] == 0
    assert per["seen", "a"] == sum(v for (s, l, _), v in want.items() if (s, l) == ("seen", "a"))


def test_scopes_read_their_input_once(spark, tmp_path):
    schema = "example_id string, word_pos int, key string, tokens array<int>, predictions array<string>, labels array<string>, t boolean"
    spark.createDataFrame([("e", 0, "w", [1], ["a"], ["b"], False)], schema).write.parquet(str(tmp_path / "w"))
    words = spark.read.parquet(str(tmp_path / "w"))
    plan = metrics.scoped_confusion(joins.occurrence_counts(words, F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan
