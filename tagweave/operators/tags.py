"""Projections, filters and tag lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.joins import attach
from tagweave.operators.runs import PUNCT

UNKNOWN = "unk"
RARE = "UNK"
IGNORED = -100
OK = "ok"
BAD = "bad"


def split_tagged(df: DataFrame, item: str = "item") -> DataFrame:
    """`word|tag` items to `word`, `tag`; items without exactly one bar are dropped."""
    parts = F.split(F.col(item), r"\|")
    rest = [c for c in df.columns if c != item]
    return df.filter(F.size(parts) == 2).select(
        *rest, parts.getItem(0).alias("word"), parts.getItem(1).alias("tag"))


def as_map(df: DataFrame, mapping: DataFrame | Mapping, key: str, value: str, types: str) -> DataFrame:
    """A caller's dict as a two-column DataFrame; a DataFrame is taken as it is."""
    if isinstance(mapping, DataFrame):
        return mapping.select(key, value)
    return df.sparkSession.createDataFrame(list(mapping.items()), types)


def map_tags(df: DataFrame, first: DataFrame | Mapping[str, str], second: DataFrame | Mapping[str, str],
             default: str = UNKNOWN, tag: str = "tag", salt_by: Sequence[str] = ("doc_id", "pos")) -> DataFrame:
    """Two lookups in a row; a miss gives `default`, which the second lookup looks up too.

    The two maps are composed before they meet the corpus, so the rows are joined once.
    """
    types = "source_tag string, target_tag string"
    one, two = (as_map(df, m, "source_tag", "target_tag", types) for m in (first, second))
    last = two.select(F.col("source_tag").alias("target_tag"), F.col("target_tag").alias("__mapped"))
    composed = one.join(last, "target_tag", "left").select(
        F.col("source_tag").alias(tag), F.coalesce("__mapped", F.lit(default)).alias("__mapped"))
    # what a miss in the first map becomes: the default, looked up in the second map
    missed = df.sparkSession.createDataFrame([(default,)], "target_tag string").join(
        last, "target_tag", "left").select(F.coalesce("__mapped", "target_tag").alias("__missed"))
    fallback = missed.first()[0]
    mapped = attach(df, composed, [tag], salt_by=salt_by)
    return mapped.withColumn(tag, F.coalesce("__mapped", F.lit(fallback))).drop("__mapped").select(*df.columns)


def rare_values(counts: DataFrame, max_count: int, value: str = "tag", count: str = "count",
                protect: Sequence[str] = ()) -> DataFrame:
    rare = counts.filter(F.col(count) <= max_count)
    if protect:
        rare = rare.filter(~F.col(value).isin(*protect))
    return rare.select(value)


def replace_rare(df: DataFrame, max_count: int = 100, replacement: str = UNKNOWN, tag: str = "tag",
                 counts: DataFrame | None = None, protect: Sequence[str] = (PUNCT,),
                 salt_by: Sequence[str] = ("doc_id", "unit_pos")) -> DataFrame:
    """Tags seen at most `max_count` times become `replacement`; protected tags stay.

    `counts` (columns tag, count) may come from elsewhere; else they are taken from `df`, and the tags that are not rare
    are looked up: there is at most one for every `max_count` rows, while rare ones may be as many as the rows.
    """
    if counts is None:
        common = keep_frequent(df.groupBy(tag).count(), max_count).select(tag, F.lit(True).alias("__common"))
        marked = attach(df, common, [tag], salt_by=salt_by, settled=True)
        stays = F.col("__common").isNotNull() | F.col(tag).isNull()
        if protect:
            stays = stays | F.col(tag).isin(*protect)
        return marked.withColumn(tag, F.when(stays, F.col(tag)).otherwise(F.lit(replacement))).select(*df.columns)
    rare = rare_values(counts, max_count, tag, "count", protect).withColumn("__rare", F.lit(True))
    marked = attach(df, rare, [tag], salt_by=salt_by, settled=True)
    return marked.withColumn(tag, F.when(F.col("__rare"), F.lit(replacement)).otherwise(F.col(tag))).select(
        *df.columns)


def only_tag(df: DataFrame, tag: str, column: str = "tag") -> DataFrame:
    return df.filter(F.col(column) == tag)


def drop_tag(df: DataFrame, tag: str, column: str = "tag") -> DataFrame:
    return df.filter(F.col(column) != tag)


def drop_unaligned(df: DataFrame, status: str = "status") -> DataFrame:
    return df.filter(F.col(status) == OK)


def unaligned(df: DataFrame, status: str = "status") -> DataFrame:
    return df.filter(F.col(status) != OK)


def upper_label_ids(label_map: DataFrame) -> DataFrame:
    """Ids by upper-cased label; of labels that upper-case alike the one with the highest id wins."""
    return label_map.groupBy(F.upper("label").alias("label")).agg(F.max("label_id").alias("label_id"))


def normalise_labels(df: DataFrame, label_map: DataFrame | Mapping[int, str], label: str = "label",
                     out: str = "label_id", default: str = RARE,
                     salt_by: Sequence[str] = ("example_id", "pos")) -> DataFrame:
    """Upper-case labels and look up their ids; an unknown label gets the id of `default`."""
    ids = upper_label_ids(as_map(df, label_map, "label_id", "label", "label_id int, label string"))
    found = ids.filter(F.col("label") == default.upper()).select("label_id").first()
    if found is None:
        raise ValueError(f"the label map has no {default!r}")
    dimension = ids.select(F.col("label").alias("__label"), F.col("label_id").alias("__id"))
    joined = attach(df.withColumn("__label", F.upper(F.col(label))), dimension, ["__label"], salt_by=salt_by)
    return joined.withColumn(out, F.coalesce("__id", F.lit(found[0]))).drop("__label", "__id")


def drop_ignored(df: DataFrame, ignore: int = IGNORED, label: str = "label") -> DataFrame:
    return df.filter(F.col(label) != ignore)


def keep_supported(metrics: DataFrame, support: str = "support") -> DataFrame:
    return metrics.filter(F.col(support) > 0)


def select_labels(metrics: DataFrame, labels: Sequence, label: str = "label") -> DataFrame:
    return metrics.filter(F.col(label).isin(*labels))


def keep_frequent(counts: DataFrame, min_count: int, count: str = "count") -> DataFrame:
    """Values counted more than `min_count` times."""
    return counts.filter(F.col(count) > min_count)


def skip_empty_examples(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    return df.filter(F.size(tokens) > 0)


def explode_examples(df: DataFrame, arrays: Mapping[str, str] | None = None) -> DataFrame:
    """Nested examples to one row per token: pos and one column per array (`{source: name}`)."""
    arrays = dict(arrays or {"tokens": "token", "texts": "text", "tags": "tag"})
    rest = [c for c in df.columns if c not in arrays]
    zipped = F.arrays_zip(*[F.col(source).alias(name) for source, name in arrays.items()])
    return df.select(*rest, F.posexplode(zipped).alias("pos", "__item")).select(
        *rest, "pos", *[F.col(f"__item.{name}").alias(name) for name in arrays.values()])


def map_labels(df: DataFrame, mapping: DataFrame | Mapping, column: str, out: str,
               types: str = "label_id int, label string", salt_by: Sequence[str] = ("example_id", "pos")) -> DataFrame:
    """Ids to labels or back: a left lookup of `column` in a two-column map."""
    key, value = (field.split()[0] for field in types.split(","))
    dimension = as_map(df, mapping, key, value, types).select(
        F.col(key).alias(column), F.col(value).alias(out))
    return attach(df, dimension, [column], salt_by=salt_by)
