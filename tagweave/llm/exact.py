"""Exact dedup by a stream with keyed state on disk.

Files of a table are read as a stream. Its state has one entry for each digest, held in RocksDB with its log in the
checkpoint folder, and never expires: the digest, the stable identifier of the row that stays, the place of that
row's content (file and row number), and how many rows came. A later run with the same checkpoint goes on from
there with the files added since. A digest alone decides nothing: the whole text of every row that hits an
entry is compared with the content at the entry's place, and rows that differ are regrouped by their texts.
Only DataFrame functions are used.

Defined cases: a null text is the empty text; among equal texts the greatest key stays, null being the least key,
and of rows that share key and text the one at the last place; texts are equal when all their bytes are; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import text_of
from tagweave.operators.joins import attach
from tagweave.session import scratch_path, settle

#: What one micro-batch reads at most, so that its shuffle stays bounded however much waits.
BATCH_BYTES = 1 << 40
#: Rows of one digest that meet in one task; a larger group is dealt over several.
GROUP_ROWS = 512
_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # else each partition's store takes 4 MB of disk for its log of files before it holds anything
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _pattern(path: str) -> str:
    """A stream wants a folder or a pattern; a pattern that matches this one path serves for files as well."""
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def _rows(source: DataFrame, key: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Key, whole text, digest and place of every row."""
    place = source.metadataColumn("_metadata")
    file = F.regexp_replace(place["file_path"], "^file:/+", "file:/")
    return source.select(F.col(f"`{key}`").alias("key"), text_of(text).alias("text"), digest(text_of(text)).alias("digest"),
                         file.alias("file"), place["row_index"].alias("row"))


def observe(spark: SparkSession, path: str, checkpoint: str, key: str = "doc_id", text: str = "text",
            digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES) -> None:
    """Take all files of `path` that this checkpoint has not seen yet into its state."""
    with _settings(spark, _STATE):
        files = (spark.readStream.schema(spark.read.parquet(_pattern(path)).schema)
                 .option("maxBytesPerTrigger", str(batch_bytes)).parquet(_pattern(path)))
        entries = (_rows(files, key, text, digest).groupBy("digest")
                   .agg(F.max(F.struct("key", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n")))
        run = (entries.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
        run.awaitTermination()


def entries(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state: digest, key and place of the row that stays, number of rows."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("key.digest"), F.col("value.max.key").alias("keep_id"), F.col("value.max.file").alias("keep_file"),
                        F.col("value.max.row").alias("keep_row"), F.col("value.count").alias("group_size"))


def _parts() -> Column:
    return F.ceil(F.col("group_size") / GROUP_ROWS).cast("int")


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("file", "row"), F.coalesce(parts, F.lit(1))).cast("int")


def _unequal(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests under which the whole texts are not all the same."""
    repeated = groups.filter("group_size > 1").withColumn("parts", _parts())
    texts = attach(rows, repeated, ["digest"], "inner", salt_by=["file", "row"])
    stays = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    hits = texts.filter(~stays).select("digest", "text", _part(F.col("parts")).alias("part"))
    kept = texts.filter(stays).select("digest", F.col("text").alias("kept_text"),
                                      F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = hits.join(kept, ["digest", "part"], "left")
    return met.filter(~F.col("text").eqNullSafe(F.col("kept_text"))).select("digest").distinct()


def _by_text(rows: DataFrame, torn: DataFrame) -> DataFrame:
    """Groups of the rows under unequal digests, by the texts themselves."""
    rows = attach(rows, torn, ["digest"], "left_semi", salt_by=["file", "row"])
    classes = rows.groupBy("digest", "text").agg(F.max(F.struct("key", "file", "row")).alias("keep"),
                                                 F.count(F.lit(1)).alias("group_size"))
    classes = classes.select("digest", "text", F.col("keep.key").alias("keep_id"), F.col("keep.file").alias("keep_file"),
                             F.col("keep.row").alias("keep_row"), "group_size")
    return attach(rows, classes, ["digest", "text"], "inner", salt_by=["file", "row"], settled=True)


def dedup(spark: SparkSession, path: str, checkpoint: str | None = None, key: str = "doc_id", text: str = "text",
          digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """`key`, `keep_id`, `group_size`, `kept`, `digest`, `file`, `row` for every row of a Parquet table.

    `checkpoint` names the folder of the stream's state; a run with the folder of an earlier one reads only new
    files into the state and decides on all rows. Files may be added in between, not changed or removed. `digest`
    may be any function of the text: one that gives different texts the same value costs time, not correctness.
    """
    checkpoint = checkpoint or scratch_path(spark, "seen")
    observe(spark, path, checkpoint, key, text, digest)
    groups = settle(entries(spark, checkpoint))
    rows = _rows(spark.read.parquet(_pattern(path)), key, text, digest)
    torn = settle(_unequal(rows, groups))

    # a group of very many rows meets its entry in several tasks
    crowded = groups.filter(F.col("group_size") > GROUP_ROWS).select("digest", _parts().alias("parts"))
    dealt = attach(rows.drop("text"), crowded, ["digest"], salt_by=["file", "row"]).withColumn("part", _part(F.col("parts")))
    found = groups.withColumn("part", F.explode(F.sequence(F.lit(0), _parts() - 1)))
    columns = ["key", "digest", "file", "row", "keep_id", "keep_file", "keep_row", "group_size"]
    decided = dealt.join(found, ["digest", "part"]).select(*columns)
    if torn.limit(1).count():
        decided = attach(decided, torn, ["digest"], "left_anti", salt_by=["file", "row"]).unionByName(
            _by_text(rows, torn).select(*columns))
    kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    return decided.select("key", "keep_id", "group_size", kept.alias("kept"), "digest", "file", "row")


def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document with the document that stays for its text, over the whole table."""
    found = dedup(spark, f"{folder}/documents.parquet")
    return found.select(F.col("key").alias("doc_id"), "keep_id", "group_size", "kept",
                        F.lower(F.hex("digest")).alias("text_sha256"))
