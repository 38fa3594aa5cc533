"""Lookups and set joins that stay whole under skew.

One side of these joins is a dimension: a tag map, a set of rare tags, a vocabulary difference. Its
size is measured before a broadcast is asked for. Beyond the bound the join shuffles, with the rows
of the big side spread over several buckets per key and the dimension repeated once per bucket, so a
key that holds a third of all rows is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.session import settle

BROADCAST_BYTES = 32 << 20
BROADCAST_ROWS = 500_000
SALT = 32


def measured_size(df: DataFrame) -> tuple[int, int]:
    """Row count and a byte estimate from the values themselves, in one aggregate."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    fixed = 16 * (len(df.columns) + 1)
    text = F.lit(0)
    for name in strings:
        text = text + F.coalesce(F.octet_length(name), F.lit(0))
    for name in arrays:
        text = text + 16 * F.coalesce(F.size(name), F.lit(0))
    rows, chars = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0))).first()
    return rows, rows * fixed + chars


def attach(big: DataFrame, dimension: DataFrame, on: Sequence[str], how: str = "left",
           salt_by: Sequence[str] = (), settled: bool = False, max_bytes: int = BROADCAST_BYTES,
           max_rows: int = BROADCAST_ROWS, salt: int = SALT) -> DataFrame:
    """Join `big` with a dimension that has one row per key.

    `settled` writes the dimension to a shared table first; use it when computing it is costly, as
    it is read twice (size check and join). `salt_by` names columns that tell the rows of `big`
    apart; they decide the bucket on the shuffled path.
    """
    on = list(on)
    if settled:
        dimension = settle(dimension)
    rows, size = measured_size(dimension)
    if rows <= max_rows and size <= max_bytes:
        return big.join(F.broadcast(dimension), on, how)
    spread = big.withColumn("__salt", F.pmod(F.xxhash64(*(salt_by or big.columns)), F.lit(salt)).cast("int"))
    copies = dimension.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return spread.join(copies, [*on, "__salt"], how).drop("__salt")


def keep_matching(big: DataFrame, keys: DataFrame, on: Sequence[str], **options) -> DataFrame:
    """Rows of `big` whose key is among `keys` (distinct)."""
    return attach(big, keys.select(*on), on, "left_semi", **options)


def drop_matching(big: DataFrame, keys: DataFrame, on: Sequence[str], **options) -> DataFrame:
    return attach(big, keys.select(*on), on, "left_anti", **options)


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both with the sides they are on (`__a`, `__b`).

    One aggregate over the union: rows are reduced where they are read and no raw row meets another in a join.
    Columns go by position, nulls are equal.
    """
    yes, no = F.lit(True), F.lit(False)
    both = a.select("*", yes.alias("__a"), no.alias("__b")).union(b.select("*", no, yes))
    return both.groupBy(*[F.col(f"`{c}`") for c in a.columns]).agg(F.bool_or("__a").alias("__a"), F.bool_or("__b").alias("__b"))


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of `a` that are not in `b`; both sides are reduced before they meet."""
    return _sides(a, b).filter(~F.col("__b")).drop("__a", "__b")


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both; reduced before they meet."""
    return _sides(a, b).filter(F.col("__a") & F.col("__b")).drop("__a", "__b")


def label_universe(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """The sorted union of the labels seen and the labels predicted (one column each)."""
    return labels.distinct().union(predictions.distinct()).distinct().orderBy(labels.columns[0])


def zip_predictions(predictions: DataFrame, labels: DataFrame,
                    on: Sequence[str] = ("example_id", "pos")) -> DataFrame:
    """Pair predictions with labels by position."""
    return predictions.join(labels, list(on))


def filter_test_only_tokens(test_rows: DataFrame, train_rows: DataFrame, token: str = "token",
                            salt_by: Sequence[str] = ("example_id", "pos")) -> DataFrame:
    """Rows of the test set whose token occurs in no training row."""
    new = only_in(test_rows.select(token), train_rows.select(token))
    return keep_matching(test_rows, new, [token], salt_by=salt_by, settled=True)


def oov_occurrences(test_words: DataFrame, train_vocab: DataFrame, example: str = "example_id",
                    word: str = "key", position: str = "word_pos") -> DataFrame:
    """For each example and each of its words that training never saw: the first occurrence.

    `test_words` has one row per word (example, word_pos, key, and what else is wanted, such as token
    and label arrays). The first occurrence is an aggregate, so no pair of word and example is formed
    that does not exist. `train_vocab` holds the training words in its `word` column.
    """
    new = only_in(test_words.select(word), train_vocab.select(word))
    rest = [c for c in test_words.columns if c not in (example, word, position)]
    kept = keep_matching(test_words, new, [word], salt_by=[example, position], settled=True)
    firsts = kept.groupBy(example, word).agg(F.min(F.struct(position, *rest)).alias("__first"))
    return firsts.select(example, F.col(f"__first.{position}").alias(position), word,
                       *[F.col(f"__first.{c}").alias(c) for c in rest])


def occurrence_counts(words: DataFrame, trained: Column, example: str = "example_id", word: str = "key",
                      position: str = "word_pos",
                      values: Sequence[str] = ("tokens", "predictions", "labels")) -> DataFrame:
    """How often each test word comes with the same values, and whether training saw it.

    `trained` says which rows are training ones; they only tell which words were seen (null: a test row).
    Returns one row per word and values: `n` occurrences, `n_first` of them the first of their word in an example,
    and `seen`. The input is read once and nothing is joined: of the training rows one per word is left before the
    first shuffle, and the windows run over counts, so neither a word nor an example that holds a third of all rows
    is a large group. Positions are unique in an example; null words and values are values like others.
    """
    trained = F.coalesce(trained, F.lit(False))
    rows = words.select(F.col(word), trained.alias("__trained"),
                        *[F.when(~trained, F.col(c)).alias(c) for c in (example, position, *values)])
    places = rows.groupBy("__trained", example, word, *values).agg(
        F.min(position).alias("__at"), F.count(F.lit(1)).alias("n"))
    earliest = F.min("__at").over(Window.partitionBy("__trained", example, word))
    counts = places.withColumn("__first", (F.col("__at") == earliest).cast("long")).groupBy(
        "__trained", word, *values).agg(F.sum("n").alias("n"), F.sum("__first").alias("n_first"))
    seen = F.max("__trained").over(Window.partitionBy(word))
    return counts.withColumn("seen", seen).filter(~F.col("__trained")).select(word, *values, "n", "n_first", "seen")


def explode_occurrences(occurrences: DataFrame, tokens: str = "tokens", predictions: str = "predictions",
                        labels: str = "labels", keep: Sequence[str] = ("example_id", "word_pos", "key")) -> DataFrame:
    """Occurrences to one row per token with its prediction and label."""
    zipped = F.arrays_zip(F.col(tokens).alias("token"), F.col(predictions).alias("prediction"),
                          F.col(labels).alias("label"))
    return occurrences.select(*keep, F.posexplode(zipped).alias("piece", "__z")).select(
        *keep, "piece", "__z.token", "__z.prediction", "__z.label")
