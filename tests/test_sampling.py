import pytest
from pyspark.sql import functions as F

from tagweave.operators import sampling


def rows(spark, n=1000, parts=4):
    return spark.range(n).select(F.col("id").alias("example_id")).repartition(parts)


def ids(df):
    return {r.example_id for r in df.collect()}


@pytest.mark.parametrize("bits", [15, 4, 1])
@pytest.mark.parametrize("wanted", [0, 1, 137, 999, 1000, 5000])
def test_exactly_as_many_as_wanted(spark, monkeypatch, bits, wanted):
    """With few bits the limit lies inside a bucket and inside one of its parts."""
    monkeypatch.setattr(sampling, "_LEVEL_BITS", bits)
    df = rows(spark)
    got = ids(df.filter(sampling.smallest(df, "example_id", 5, wanted)))
    order = [r.example_id for r in df.orderBy(sampling.order_hash("example_id", 5)).collect()]
    assert got == set(order[:wanted])


def test_two_scans_and_none_while_the_plan_is_built(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    df = rows(spark).mapInPandas(counted, "example_id long")
    half = sampling.split_exact(df, 0.5, 1)
    assert read.value == 0
    assert half.filter("split = 'test'").count() == 500
    assert read.value == 3 * 1000  # two to find the limit, one for the rows themselves


@pytest.mark.parametrize("wanted", [1, 3, 9])
def test_copies_of_a_key_are_refused(spark, wanted):
    df = spark.createDataFrame([(1,)] * 10, "example_id long")
    with pytest.raises(Exception, match="not unique"):
        df.filter(sampling.smallest(df, "example_id", 0, wanted)).collect()
    assert df.filter(sampling.smallest(df, "example_id", 0, 10)).count() == 10


def test_nothing_to_choose_from(spark):
    assert sampling.sample_lines(spark.createDataFrame([], "doc_id long, line_no long"), 3).count() == 0


def test_exact_split(spark):
    df = rows(spark, 1009)
    split = sampling.split_exact(df, 0.1, 3)
    parts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert parts == {"test": 100, "train": 909}
    again = sampling.split_exact(rows(spark, 1009, 1), 0.1, 3)
    assert ids(split.filter("split = 'test'")) == ids(again.filter("split = 'test'"))
    assert sampling.split_exact(df, 0).filter("split = 'test'").count() == 0
    named = sampling.split_exact(df, 0.5, test=rows(spark, 7))
    assert named.filter("split = 'test'").count() == 7 and named.count() == 1016


def test_bernoulli_split_is_stable_and_whole(spark):
    one = sampling.split_bernoulli(rows(spark, 5000, 1), 0.1, 1)
    many = sampling.split_bernoulli(rows(spark, 5000, 8), 0.1, 1)
    assert ids(one.filter("split = 'test'")) == ids(many.filter("split = 'test'"))
    assert 400 < one.filter("split = 'test'").count() < 600 and one.count() == 5000


def test_shuffle_keeps_all(spark):
    order = [r.example_id for r in sampling.shuffle_examples(rows(spark), 1).collect()]
    assert sorted(order) == list(range(1000)) and order != sorted(order)
