import random

import pytest

from tagweave.operators import joins, tags


@pytest.fixture
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", i) for i in range(500)] + [(None, 900)]
    return spark.createDataFrame(rows, "k string, i int").repartition(6)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_both_ways_of_a_lookup_agree(spark, skewed, how):
    dimension = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "k string, v int")
    small = joins.attach(skewed, dimension, ["k"], how, salt_by=["i"])
    large = joins.attach(skewed, dimension, ["k"], how, salt_by=["i"], max_rows=1)
    assert "Broadcast" in small._jdf.queryExecution().sparkPlan().toString()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, small.collect()), key=key) == sorted(map(tuple, large.select(small.columns).collect()), key=key)


def test_size_counts_rows_and_text(spark):
    rows, size = joins.measured_size(spark.createDataFrame([("a" * 100,), ("b",)], "k string"))
    assert rows == 2 and size >= 101


def test_map_tags(spark):
    words = spark.createDataFrame([(0, i, t) for i, t in enumerate("abcde")], "doc_id int, pos int, tag string")
    one, two = {"a": "X", "b": "Y", "c": "unk"}, {"X": "x", "unk": "u"}
    got = {r.pos: r.tag for r in tags.map_tags(words, one, two).collect()}
    assert [got[i] for i in range(5)] == [two.get(one.get(t, "unk"), "unk") for t in "abcde"]


def test_rare_tags_are_not_the_looked_up_side(spark, monkeypatch):
    """They may be as many as the rows; the tags above the limit are few."""
    rows = ["many"] * 5 + [None] * 4 + ["PUNCT"] + [f"rare{i // 2}" for i in range(300)]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(rows)], "doc_id int, unit_pos int, tag string")
    sizes, attach = [], tags.attach
    monkeypatch.setattr(tags, "attach", lambda big, dimension, *a, **k: sizes.append(dimension.count()) or attach(big, dimension, *a, **k))
    got = {r.unit_pos: r.tag for r in tags.replace_rare(df, 4).collect()}
    assert [got[i] for i in range(len(rows))] == ["many"] * 5 + [None] * 4 + ["PUNCT"] + ["unk"] * 300
    assert sizes == [1]
    given = spark.createDataFrame([("rare1", 2), ("many", 5)], "tag string, count long")
    assert tags.replace_rare(df, 4, counts=given).filter("tag = 'unk'").count() == 2


def test_rare_limit_is_inclusive_and_punct_is_kept(spark):
    rows = ["many"] * 101 + ["edge"] * 100 + ["PUNCT"] * 3
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(rows)], "doc_id int, unit_pos int, tag string")
    counts = {r.tag: r["count"] for r in tags.replace_rare(df, 100).groupBy("tag").count().collect()}
    assert counts == {"many": 101, "unk": 100, "PUNCT": 3}
    counts = {r.tag: r["count"] for r in tags.replace_rare(df, 199, "UNK", protect=()).groupBy("tag").count().collect()}
    assert counts == {"UNK": 204}


def test_split_tagged(spark):
    items = ["a|N", "a", "a|b|c", "|N", "a|", ""]
    df = spark.createDataFrame([(i,) for i in items], "item string")
    assert [(r.word, r.tag) for r in tags.split_tagged(df).collect()] == [("a", "N"), ("", "N"), ("a", "")]


def test_labels_that_upper_case_alike(spark):
    df = spark.createDataFrame([("e", 0, "n"), ("e", 1, "N"), ("e", 2, "zz")], "example_id string, pos int, label string")
    got = tags.normalise_labels(df, {0: "n", 1: "UNK", 2: "N"})
    assert [r.label_id for r in got.orderBy("pos").collect()] == [2, 2, 1]
    with pytest.raises(ValueError):
        tags.normalise_labels(df, {0: "n"})


def test_first_occurrence_of_new_words(spark):
    test = spark.createDataFrame([("e1", 0, "new", [1]), ("e1", 1, "old", [2]), ("e1", 2, "new", [9]), ("e2", 5, "new", [3])],
                                 "example_id string, word_pos int, key string, tokens array<int>")
    train = spark.createDataFrame([("old",), ("other",)], "key string")
    got = joins.oov_occurrences(test, train)
    assert sorted(map(tuple, got.collect())) == [("e1", 0, "new", [1]), ("e2", 5, "new", [3])]


def test_tokens_of_the_test_set_only(spark):
    test = spark.createDataFrame([("e", 0, 1), ("e", 1, 2), ("e", 2, 1)], "example_id string, pos int, token int")
    train = spark.createDataFrame([("f", 0, 2)], "example_id string, pos int, token int")
    assert [r.pos for r in joins.filter_test_only_tokens(test, train).orderBy("pos").collect()] == [0, 2]


def test_occurrences_to_tokens(spark):
    df = spark.createDataFrame([("e", 3, "5 6", [5, 6], ["A", "B"], ["A", "[MASK]"])],
                               "example_id string, word_pos int, key string, tokens array<int>, predictions array<string>, labels array<string>")
    rows = joins.explode_occurrences(df).select("piece", "token", "prediction", "label").collect()
    assert [tuple(r) for r in rows] == [(0, 5, "A", "A"), (1, 6, "B", "[MASK]")]


def test_universe_and_sets(spark):
    a = spark.createDataFrame([("b",), ("a",), ("b",)], "label string")
    b = spark.createDataFrame([("c",), ("a",)], "pred string")
    assert [r.label for r in joins.label_universe(a, b).collect()] == ["a", "b", "c"]
    assert [r.label for r in joins.only_in(a, b).collect()] == ["b"]
    assert [r.label for r in joins.in_both(a, b).collect()] == ["a"]
