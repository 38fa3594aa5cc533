"""Saved example sets and shard-wise builds."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.operators.joins import drop_matching, keep_matching
from tagweave.session import settle

#: Log of finished shards below the output folder; readers pass over names with an underscore.
_LOG = "_built"


def save_examples(df: DataFrame, path: str, split: str = "split") -> None:
    """Write the whole set, one partition per split; a large split stays in many files."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def load_examples(spark: SparkSession, path: str, part: str | None = None, split: str = "split") -> DataFrame:
    """The whole set, or one split of it (only its folder is read)."""
    examples = spark.read.parquet(path)
    return examples if part is None else examples.filter(F.col(split) == part)


def shard_name(path: Column, max_seq: int, seed: int | None = None) -> Column:
    """`<stem>-maxseq-<n>[-<seed>]`; the stem is the file name up to its first dot."""
    file_name = F.element_at(F.split(path, "/"), -1)
    suffix = f"-maxseq-{max_seq}" + ("" if seed is None else f"-{seed}")
    return F.concat(F.element_at(F.split(file_name, r"\."), 1), F.lit(suffix))


def _files(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(context._jsc.hadoopConfiguration())


def _shard_folders(spark: SparkSession, out: str, shard: str) -> dict[str, str]:
    """The partition folders of `out` by the shard they hold, finished or not; an unreadable folder is an error."""
    where, system = _files(spark, out)
    folders = [f.getPath() for f in system.listStatus(where) if f.isDirectory()] if system.exists(where) else []
    held = {f.getName(): f.toString() for f in folders if f.getName().startswith(f"{shard}=")}
    return {unquote(name.removeprefix(f"{shard}=")): path for name, path in held.items()}


def built_shards(spark: SparkSession, out: str, shard: str = "shard", kind: T.DataType = T.StringType()) -> DataFrame:
    """(shard, rows) of the finished shards of `out`, from its log; none if there is no log.

    A shard is in the log once all its rows were written, so one without rows is finished with 0 and one that was
    cut off is not there, whatever its folder holds.
    """
    where, system = _files(spark, f"{out}/{_LOG}")
    schema = T.StructType([T.StructField(shard, kind), T.StructField("rows", T.LongType()),
                           T.StructField("at", T.TimestampType())])
    log = spark.read.schema(schema).parquet(where.toString()) if system.exists(where) else spark.createDataFrame([], schema)
    return log.groupBy(shard).agg(F.max_by("rows", "at").alias("rows"))


def damaged_shards(spark: SparkSession, out: str, shard: str = "shard") -> DataFrame:
    """(shard, rows, found) of the shards that the log has with other numbers of rows than their files.

    Counts come from the footers of the files; shards that are not in the log do not count as damaged.
    """
    known = built_shards(spark, out, shard)
    files = spark.read.schema(T.StructType([T.StructField(shard, T.StringType())])).parquet(out)
    found = files.groupBy(shard).agg(F.count(F.lit(1)).alias("found"))
    both = known.join(found, shard, "left").select(shard, "rows", F.coalesce("found", F.lit(0)).alias("found"))
    return both.filter("rows <> found")


def build_missing_shards(df: DataFrame, out: str, build: Callable[[DataFrame], DataFrame],
                         shard: str = "shard") -> DataFrame:
    """Build the shards that `out` does not hold yet and return the rows of all finished ones.

    Inputs of finished shards are dropped before `build` runs; which these are says a log beside the data
    (`built_shards`), not the folders. What a run that was cut off left of other shards is removed first, the shards
    are written, counted, and only then entered in the log, so any run can be repeated after any failure. Rows are
    rebalanced by shard for writing, which the adaptive planner splits again where one shard is large. Every row has
    a shard (else a ValueError). Two runs must not build the same shard at once.
    """
    spark, kind = df.sparkSession, df.schema[shard].dataType
    done = settle(built_shards(spark, out, shard, kind).select(shard))
    wanted = settle(drop_matching(df.select(shard).distinct(), done, [shard]))
    if not wanted.filter(F.col(shard).isNull()).isEmpty():
        raise ValueError(f"rows without {shard}")
    folders = _shard_folders(spark, out, shard)
    listed = spark.createDataFrame(list(folders.items()), f"`{shard}` string, path string")
    for left in keep_matching(listed, wanted.select(F.col(shard).cast("string").alias(shard)), [shard]).collect():
        where, system = _files(spark, left["path"])
        system.delete(where, True)

    built = build(keep_matching(df, wanted, [shard]))
    (built.hint("rebalance", F.col(shard))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(out))
    data = [f for f in built.schema.fields if f.name != shard]
    rows = spark.read.schema(T.StructType([*data, T.StructField(shard, kind)])).parquet(out)
    counts = keep_matching(rows.select(shard), wanted, [shard]).groupBy(shard).agg(F.count(F.lit(1)).alias("rows"))
    (wanted.join(counts, shard, "left").select(shard, F.coalesce("rows", F.lit(0)).alias("rows"), F.current_timestamp().alias("at"))
     .write.mode("append").parquet(f"{out}/{_LOG}"))
    return keep_matching(rows, built_shards(spark, out, shard, kind), [shard])


def repartition(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """n partitions, by the given keys or evenly."""
    return df.repartition(n, *keys)
