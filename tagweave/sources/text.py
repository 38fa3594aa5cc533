"""Readers for plain and tagged text files."""

from __future__ import annotations

import ast
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW_BITS = (1 << 33) - 1


def raw_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All lines of all files as (doc_id, line_no, line), read split by split.

    `line_no` grows along a file and is unique in it, but has gaps: it is the byte offset of the
    split the line was read from plus the line's position in the reading task. A split of full size
    is alone in its task and holds fewer lines than bytes, so the next split of the file starts above
    it. No file is held in one row or one task.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("doc_id"),
        (F.col("_metadata.file_block_start") + row).alias("line_no"),
        F.col("value").alias("line"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def load_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines without surrounding space; empty ones are dropped."""
    return raw_lines(spark, path).withColumn("line", strip(F.col("line"))).filter(F.col("line") != "")


def merge_files(spark: SparkSession, pattern: str | Sequence[str]) -> DataFrame:
    """All files of a glob as one corpus of lines, as they are."""
    return raw_lines(spark, pattern)


def tagged_items(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines of `word|tag word|tag` to one row per item: (doc_id, line_no, idx, item)."""
    return lines.select("doc_id", "line_no", F.posexplode(F.split(F.col(line), " ")).alias("idx", "item"))


def load_tagged_corpus(spark: SparkSession, pattern: str | Sequence[str]) -> DataFrame:
    """Items of a tagged corpus; blank lines are skipped. Order is (doc_id, line_no, idx)."""
    lines = raw_lines(spark, pattern)
    return tagged_items(lines.filter(strip(F.col("line")) != ""))


def parse_tag_map(text: str) -> dict[str, str]:
    """`[("(a|b)", "X"), ...]` to {a: X, b: X}; a later pair for the same tag wins."""
    pairs = ast.literal_eval(text.replace("\n", "").replace(" ", ""))
    mapping: dict[str, str] = {}
    for sources, target in pairs:
        mapping.update(dict.fromkeys(sources.strip("(").strip(")").split("|"), target))
    return mapping


def load_tag_map(spark: SparkSession, path: str) -> DataFrame:
    """A tag-map file as (source_tag, target_tag). The file is a short list kept by hand."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    return spark.createDataFrame(list(parse_tag_map(text).items()), "source_tag string, target_tag string")
