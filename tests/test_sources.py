import os

import pytest
from pyspark.sql import functions as F

from tagweave.operators import runs, tags
from tagweave.session import CHECKPOINT_CONF, shared_dir
from tagweave.sources import store, text


def write(folder, name, content):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as out:
        out.write(content)


def test_line_order_survives_small_splits(spark, tmp_path):
    """Splits of a few bytes: a file is read by many tasks, and tails of files share tasks."""
    want = {}
    for f in range(5):
        lines = [f"f{f}-{i}" + "x" * (i % 7) for i in range(40 + 13 * f)]
        lines[3] = "   "
        write(tmp_path, f"d{f}.txt", "\n".join(lines) + "\n")
        want[f"d{f}.txt"] = [s for s in lines if s.strip()]
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = text.load_lines(spark, str(tmp_path) + "/*.txt")
        assert df.rdd.getNumPartitions() > 20
        rows = df.orderBy("doc_id", "line_no").collect()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    got = {}
    for r in rows:
        got.setdefault(os.path.basename(r.doc_id), []).append(r.line)
    assert got == want
    assert len({(r.doc_id, r.line_no) for r in rows}) == len(rows)


def test_tagged_corpus_to_units(spark, tmp_path):
    write(tmp_path, "a-horizontal.txt", "ka་|n bad x|y|z pa|v\n\nma་|n །|PUNCT\n")
    items = text.load_tagged_corpus(spark, str(tmp_path) + "/*-horizontal.txt")
    words = tags.split_tagged(items)
    assert [(r.word, r.tag) for r in words.orderBy("line_no", "idx").collect()] == [
        ("ka་", "n"), ("pa", "v"), ("ma་", "n"), ("།", "PUNCT")]
    units = runs.build_units(words, order=("line_no", "idx")).orderBy("unit_pos").collect()
    assert [(u.word, u.tag) for u in units] == [("ka་", "n"), ("pama་", "v+n"), ("།", "PUNCT")]


def test_strip_and_merge(spark, tmp_path):
    write(tmp_path, "x.txt", " \t a b  \n\n")
    write(tmp_path, "y.txt", "c")
    assert sorted(r.line for r in text.load_lines(spark, str(tmp_path)).collect()) == ["a b", "c"]
    assert text.merge_files(spark, str(tmp_path) + "/*.txt").count() == 3


def test_tag_map(spark, tmp_path):
    write(tmp_path, "map.txt", '[("(n.a|n.b)", "NOUN"),\n ("v", "VERB"), ("(n.b)", "OTHER")]')
    got = {r.source_tag: r.target_tag for r in text.load_tag_map(spark, str(tmp_path / "map.txt")).collect()}
    assert got == {"n.a": "NOUN", "n.b": "OTHER", "v": "VERB"}


def test_examples_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2], "train"), ("b", [3], "test")], "example_id string, tokens array<int>, split string")
    path = str(tmp_path / "set")
    store.save_examples(df, path)
    assert store.load_examples(spark, path).count() == 2
    assert [r.example_id for r in store.load_examples(spark, path, "test").collect()] == ["b"]


def test_only_missing_shards_are_built(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 3)], "shard string, v int")
    store.build_missing_shards(df.filter("shard = 's1'"), out, lambda d: d)
    done = store.build_missing_shards(df, out, lambda d: d.withColumn("v", F.col("v") * 10))
    assert sorted((r.shard, r.v) for r in done.collect()) == [("s1", 1), ("s1", 2), ("s2", 30)]
    assert store.build_missing_shards(df, out, lambda d: d.withColumn("v", F.lit(0))).count() == 3


def test_a_shard_without_rows_is_built_once(spark, tmp_path):
    out, calls = str(tmp_path / "out"), []
    df = spark.createDataFrame([("full", 1), ("empty", -1), ("empty", -2)], "shard string, v int")

    def build(rows):
        calls.append(sorted({r.shard for r in rows.collect()}))
        return rows.filter("v > 0")

    for _ in range(2):
        assert [tuple(r) for r in store.build_missing_shards(df, out, build).select("shard", "v").collect()] == [("full", 1)]
    assert calls == [["empty", "full"], []]
    assert {r.shard: r.rows for r in store.built_shards(spark, out).collect()} == {"full": 1, "empty": 0}
    assert store.build_missing_shards(df.filter("false"), str(tmp_path / "none"), build).count() == 0


def test_a_run_that_was_cut_off_is_done_again(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a/b c", 1), ("s2", 2), ("s2", 3), ("s3", 4)], "shard string, v int")
    store.build_missing_shards(df.filter("v = 1"), out, lambda d: d)
    failing = F.when(F.col("v") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("v"))
    with pytest.raises(Exception, match="lost"):
        store.build_missing_shards(df, out, lambda d: d.withColumn("v", failing.cast("int")))
    assert [r.shard for r in store.built_shards(spark, out).collect()] == ["a/b c"]
    # half of two shards is there, but they are not in the log
    df.filter("v IN (2, 4)").write.partitionBy("shard").mode("append").parquet(out)
    shards = store.build_missing_shards(df, out, lambda d: d.filter("shard <> 's3'"))
    assert sorted((r.shard, r.v) for r in shards.collect()) == [("a/b c", 1), ("s2", 2), ("s2", 3)]
    assert {r.shard: r.rows for r in store.built_shards(spark, out).collect()} == {"a/b c": 1, "s2": 2, "s3": 0}
    assert store.damaged_shards(spark, out).count() == 0
    df.filter("v = 2").write.partitionBy("shard").mode("append").parquet(out)
    assert [tuple(r) for r in store.damaged_shards(spark, out).collect()] == [("s2", 2, 3)]


def test_shards_by_number_and_rows_without_shard(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "part int, v string")
    with pytest.raises(ValueError):
        store.build_missing_shards(df, str(tmp_path / "a"), lambda d: d, "part")
    named = df.filter("part IS NOT NULL")
    for _ in range(2):
        rows = store.build_missing_shards(named, str(tmp_path / "b"), lambda d: d, "part")
        assert sorted((r.part, r.v) for r in rows.collect()) == [(1, "x"), (2, "y")]


def test_shard_names(spark):
    row = spark.createDataFrame([("/x/part.one.txt",)], "p string").select(
        store.shard_name(F.col("p"), 128).alias("a"), store.shard_name(F.col("p"), 128, 5).alias("b")).first()
    assert tuple(row) == ("part-maxseq-128", "part-maxseq-128-5")


def test_named_shared_folder_comes_first(spark, tmp_path):
    class Conf:
        def get(self, key, default=None):
            return str(tmp_path) if key == CHECKPOINT_CONF else default

    class Named:
        conf, sparkContext = Conf(), spark.sparkContext

    assert shared_dir(Named()) == str(tmp_path)
    assert shared_dir(spark) != str(tmp_path)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    import pytest
    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        with pytest.raises(ValueError, match=CHECKPOINT_CONF):
            shared_dir(SimpleNamespace(conf=conf, sparkContext=context))
