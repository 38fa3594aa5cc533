"""Session settings and shared scratch space."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
PARTITIONS_CONF = "spark.sql.shuffle.partitions"
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # joins deal rows by all their keys, but for queries over `fixtures.keyed` tables
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
    # whole texts and their pieces go to Python in batches of bounded size, not of 10,000 rows of any size
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    BATCH_CONF: "10000",
}
_shipped: dict[str, str] = {}
_folders: set[str] = set()
_raised: dict[str, tuple[str, str]] = {}


def get_spark(app: str = "tagweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs here rely on; `conf` uses `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session made elsewhere and make the package known to its workers."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    before, raised = _raised.pop(spark.sparkContext.applicationId, ("", ""))
    if raised and spark.conf.get(PARTITIONS_CONF) == raised:
        spark.conf.set(PARTITIONS_CONF, before)
    ship_package(spark)
    shared_dir(spark)
    return spark


def at_least_partitions(spark: SparkSession, wanted: int) -> None:
    """No fewer shuffle partitions than `wanted` until the next `prepare`; the planner joins those that stay small."""
    now = spark.conf.get(PARTITIONS_CONF)
    if wanted > int(now):
        before, _ = _raised.get(spark.sparkContext.applicationId, (now, ""))
        _raised[spark.sparkContext.applicationId] = before, str(wanted)
        spark.conf.set(PARTITIONS_CONF, str(wanted))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only if it is unset.

    The setting is read from the session first. Where nothing is configured a fresh temporary folder is made and
    remembered as the checkpoint folder if all runs in one process (tests); on a cluster that is an error, as
    executors do not share their own disks.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    context = spark.sparkContext
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if not current:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tagweave-"))
        current = context.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the folder of this application in the shared one, removed at its end."""
    folder = os.path.join(shared_dir(spark), f"tagweave-{spark.sparkContext.applicationId}")
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(clear, spark, folder)
    return os.path.join(folder, f"{name}-{uuid.uuid4().hex}")


def clear(spark: SparkSession, folder: str) -> None:
    """Remove an application's intermediate tables, while its context still runs."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    where = context._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver runs from."""
    context = spark.sparkContext
    if _shipped.get("app") == context.applicationId:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tagweave-code-"), package.name), "zip",
                                  root_dir=package.parent, base_dir=package.name)
    context.addPyFile(archive)
    _shipped["app"] = context.applicationId


def settle(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write an intermediate result to a shared table and read it back.

    Cuts lineage and makes a later size check and the join that follows it see the same rows. `codec` compresses the
    files otherwise than the session says, such as zstd for whole texts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "settled")
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)
