"""Counts, rates, vocabularies and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions.labels import token_key


def value_counts(df: DataFrame, column: str, ascending: bool = False, sort: bool = True) -> DataFrame:
    """Frequency of each value, most frequent first unless `ascending`; ties by value."""
    counts = df.groupBy(column).count()
    return sort_counts(counts, column, "count", ascending) if sort else counts


def sort_counts(df: DataFrame, label: str, by: str = "count", ascending: bool = False) -> DataFrame:
    return df.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), F.col(label))


def top(df: DataFrame, n: int, by: str, label: str, ascending: bool = False) -> DataFrame:
    """The first n rows of a sorted report."""
    return sort_counts(df, label, by, ascending).limit(n)


def tag_rate(df: DataFrame, tag: str, column: str = "tag") -> DataFrame:
    """Count, total and fraction of one tag in a single pass."""
    hits = F.count_if(F.col(column) == tag)
    total = F.count(F.lit(1))
    return df.agg(hits.alias("hits"), total.alias("total"), (hits / total).alias("rate"))


def coverage(counts: DataFrame, min_count: int, count: str = "count") -> DataFrame:
    """How many values are counted more than `min_count` times and what share of rows they cover.

    `lost` is the share of values below `min_count`, which a rarity filter would take away.
    """
    frequent, rare = F.col(count) > min_count, F.col(count) < min_count
    total = F.sum(count)
    return counts.agg(
        F.count_if(frequent).alias("frequent_values"),
        F.count(F.lit(1)).alias("all_values"),
        (F.coalesce(F.sum(F.when(frequent, F.col(count))), F.lit(0)) / total).alias("covered"),
        (F.coalesce(F.sum(F.when(rare, F.col(count))), F.lit(0)) / total).alias("lost"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def distinct_count(df: DataFrame, column: str, out: str = "values") -> DataFrame:
    """Exact number of distinct values; reduced by value first, so no set grows in one task."""
    return distinct_values(df, column).agg(F.count(F.lit(1)).alias(out))


def vocabulary(words: DataFrame, tokens: str = "tokens", key: str = "key") -> DataFrame:
    """Distinct words; the key of a word is its token ids joined with a space."""
    return words.select(token_key(F.col(tokens)).alias(key)).distinct()


def word_length_histogram(vocab: DataFrame, key: str = "key", by: str = "characters") -> DataFrame:
    """Histogram of word length, shortest first: `characters` of the key, or `tokens` in it."""
    length = F.length(key) if by == "characters" else F.size(F.split(F.col(key), " "))
    return vocab.groupBy(length.alias("length")).count().orderBy("length")


def count_rows(df: DataFrame, out: str = "rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(out))


def split_sizes(df: DataFrame, tokens: str = "tokens", split: str = "split") -> DataFrame:
    """Examples and tokens per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("examples"),
                                 F.sum(F.size(tokens).cast("long")).alias("tokens"))


def char_counts(df: DataFrame, text: str | Column = "text") -> DataFrame:
    column = F.col(text) if isinstance(text, str) else text
    chars = df.select(F.explode(F.split(column, "")).alias("char"))
    return chars.filter(F.col("char") != "").groupBy("char").count()


def char_coverage(counts: DataFrame, share: float = 0.99995) -> DataFrame:
    """The smallest set of characters that covers `share` of all occurrences.

    Most frequent first, ties by character. The windows below see one row per distinct character, at
    most the 1,114,112 code points there are.
    """
    order = Window.orderBy(F.col("count").desc(), "char").rowsBetween(Window.unboundedPreceding, -1)
    running = counts.select("char", "count", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("before"),
                            F.sum("count").over(Window.partitionBy()).alias("total"))
    return running.filter(F.col("before") < F.lit(share) * F.col("total")).select("char", "count")


def support_share(metrics: DataFrame, support: str = "support", part: Sequence[str] = (),
                  out: str = "support_share") -> DataFrame:
    """Support over the total of its part. `metrics` is a report with one row per label and part."""
    total = F.sum(support).over(Window.partitionBy(*part))
    return metrics.withColumn(out, F.when(total > 0, F.col(support) / total))
