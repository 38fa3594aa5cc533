"""Reproducible splits, samples and shuffles.

Every choice hangs on a hash of the row's key and a seed, so a recomputed task, another partitioning
or another cluster gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LEVEL_BITS = 15
_HASH_BITS = 60


def order_hash(key: str | Sequence[str], seed: int | str) -> Column:
    """A 60-bit number from the md5 of the key columns and the seed."""
    key = [key] if isinstance(key, str) else list(key)
    return text_hash(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def text_hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, _HASH_BITS // 4), 16, 10).cast("long")


def coin(key: str | Sequence[str], seed: int | str, share: float) -> Column:
    """True for about `share` of the keys, in steps of a millionth."""
    return order_hash(key, seed) % 1_000_000 < int(round(share * 1_000_000))


def split_bernoulli(df: DataFrame, frac: float = 0.1, seed: int = 0, key: str | Sequence[str] = "example_id",
                    out: str = "split") -> DataFrame:
    """Each example goes to `test` with probability `frac`, independently of the others."""
    return df.withColumn(out, F.when(coin(key, seed, frac), "test").otherwise("train"))


def smallest(df: DataFrame, key: str | Sequence[str], seed: int, wanted: int | Callable[[Column], Column]) -> Column:
    """A condition that holds for exactly `wanted` rows, those of the smallest hash.

    `wanted` is a number or a function of the row count (as a column). Nothing runs while the plan is built: the
    limit is a scalar subquery of two scans of the key columns. The first counts the rows by the leading bits of
    their hash, at most 2^15 counts a task, which bounds the rank of every hash; the second orders what is left, one
    bucket of 2^15, in as many parts. What it holds, n / 2^15 keys of n rows, is sorted in parts of n / 2^30 and passed
    on as one row per part. No row of `df` is moved, and the result is a plain filter. The key must be unique: where
    copies of a key stand on both sides of the limit, the query ends with an error.
    """
    key = [key] if isinstance(key, str) else list(key)
    h, n, before = order_hash(key, seed), F.col("__n"), F.col("__upto") - F.col("__n")
    wide, fine = _HASH_BITS - _LEVEL_BITS, _HASH_BITS - 2 * _LEVEL_BITS
    at = F.struct(h.alias("h"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(key)])

    def upto(part: str) -> Column:
        # at most 2^15 rows
        return F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, 0))

    counts = df.groupBy(F.shiftright(h, wide).alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    total = F.sum(n).over(Window.partitionBy())
    goal = wanted(total) if callable(wanted) else F.lit(wanted)
    ranked = counts.select("__b", "__n", upto("__b").alias("__upto"), F.least(goal.cast("long"), total).alias("__goal"))
    band = ranked.filter((before < F.col("__goal")) & (F.col("__upto") >= F.col("__goal"))).select(
        F.struct(F.col("__b").alias("b"), (F.col("__goal") - before).alias("rest"))).scalar()

    parts = df.filter(F.shiftright(h, wide) == band["b"]).groupBy(F.shiftright(h, fine).alias("__b")).agg(
        F.sort_array(F.collect_list(at)).alias("__keys"), F.first(band["rest"]).alias("__rest"))
    placed = parts.withColumn("__n", F.size("__keys").cast("long")).withColumn("__upto", upto("__b"))
    rest = (F.col("__rest") - before).cast("int")  # the place in its part of the last row wanted
    last, following = F.get("__keys", rest - 1), F.get("__keys", rest)
    copied = F.raise_error(F.lit(f"{key} is not unique, so no exact number of rows can be chosen by it"))
    limit = placed.filter((rest > 0) & (rest <= n)).select(F.when(last == following, copied.cast(_type(df, key))).otherwise(last))
    return F.coalesce(at <= limit.scalar(), F.lit(False))


def _type(df: DataFrame, key: list[str]) -> T.StructType:
    return T.StructType([T.StructField("h", T.LongType()),
                         *[T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(key)]])


def split_exact(df: DataFrame, frac: float = 0.1, seed: int = 0, key: str | Sequence[str] = "example_id",
                test: DataFrame | None = None, out: str = "split") -> DataFrame:
    """Test gets exactly int(frac * n) rows; none if frac <= 0; a given test set overrides both."""
    if test is not None:
        return df.withColumn(out, F.lit("train")).unionByName(test.withColumn(out, F.lit("test")))
    if frac <= 0:
        return df.withColumn(out, F.lit("train"))
    chosen = smallest(df, key, seed, lambda n: F.floor(F.lit(float(frac)) * n))
    return df.withColumn(out, F.when(chosen, "test").otherwise("train"))


def sample_lines(df: DataFrame, n: int, seed: int = 0, key: str | Sequence[str] = ("doc_id", "line_no")) -> DataFrame:
    """Exactly n random rows (all, if there are fewer)."""
    return df.filter(smallest(df, key, seed, n))


def shuffle_examples(df: DataFrame, seed: int = 0, key: str | Sequence[str] = "example_id") -> DataFrame:
    """All rows in an order given by the hash; a range-partitioned sort."""
    key = [key] if isinstance(key, str) else list(key)
    return df.orderBy(order_hash(key, seed), *key)
