"""Grouping ordered rows into runs: units, sections, words.

A run ends at a row whose close flag is set. Runs left open at the end of their group are dropped
before anything is collected, so a document that never closes costs no memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.operators.scan import BLOCK, running, running_sums

PUNCT = "PUNCT"
MASK = "[MASK]"
WORD_END = "[WORD_END]"
TSHEG = "་"


def ordered(order: Sequence[str], *values: Column) -> Column:
    """Collect `values` of a group in `order`, as an array of structs `v0, v1, ...`."""
    fields = [v.alias(f"v{i}") for i, v in enumerate(values)]
    # sort_array compares natively; array_sort would interpret a comparator per pair
    return F.sort_array(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)],
                                                *fields)))


def number_runs(df: DataFrame, part: str, order: Sequence[str], closes: Column,
                run_id: str = "run_id", keep_open: bool = False, block: int | None = BLOCK) -> DataFrame:
    """Add `run_id`, the number of closed runs before a row; rows of an open last run are dropped.

    The long form keeps one row per input row and so has no limit on the length of a run.
    """
    summed = running_sums(df, part, order, {run_id: closes.cast("int")}, totals=True, block=block)
    if not keep_open:
        summed = summed.filter(F.col(run_id) < F.col(f"{run_id}_total"))
    return summed.drop(f"{run_id}_total")


def build_units(df: DataFrame, mark: str = TSHEG, part: str = "doc_id", order: Sequence[str] = ("pos",),
                punct: str = PUNCT, block: int | None = BLOCK) -> DataFrame:
    """Join consecutive words into units, each ending with a word that ends in `mark`.

    A `punct` word first ends the open unit and then stands alone. Tags of a unit are joined with
    `+`. Output: part, unit_pos (order key of the first word), section_pos (closed sections before
    it), word, tag. A unit of empty words only that punctuation cuts off is dropped.
    """
    is_punct = F.col("tag") == F.lit(punct)
    closes = is_punct | F.coalesce(F.col("word").endswith(mark), F.lit(False))
    summed = running_sums(df, part, order,
                          {"__closed": closes.cast("int"), "__section": is_punct.cast("int")},
                          totals=True, block=block)
    kept = summed.filter(F.col("__closed") < F.col("__closed_total"))
    # a punctuation row starts a new unit as well as ending one
    run = F.col("__closed") + F.col("__section") + is_punct.cast("int")
    items = ordered(order, F.col("word"), F.col("tag"))
    units = kept.groupBy(part, run.alias("__run"), F.col("__section").alias("section_pos")).agg(
        items.alias("__items"))
    first = F.col("__items")[0]
    position = first.getField("o0") if len(order) == 1 else F.struct(
        *[first.getField(f"o{i}").alias(o) for i, o in enumerate(order)])
    out = units.select(
        part, position.alias("unit_pos"), "section_pos",
        F.array_join(F.col("__items.v0"), "").alias("word"),
        F.array_join(F.col("__items.v1"), "+").alias("tag"))
    return out.filter((F.col("word") != "") | (F.col("tag") == punct))


def build_sections(units: DataFrame, part: str = "doc_id", order: Sequence[str] = ("unit_pos",),
                   punct: str = PUNCT, section: str | None = None, block: int | None = BLOCK) -> DataFrame:
    """Join units into sections, each closed by a `punct` unit; an open last section is dropped.

    Output: part, section_pos, words array, tags array. With `section` the section number is read
    from that column (as `build_units` leaves it) and no second running sum is needed; a section then
    counts as closed when it holds a `punct` unit.
    """
    if section is None:
        rows = number_runs(units, part, order, F.col("tag") == punct, "section_pos", block=block)
    else:
        rows = units.withColumn("section_pos", F.col(section))
    grouped = rows.groupBy(part, "section_pos").agg(
        ordered(order, F.col("word"), F.col("tag")).alias("__items"),
        F.bool_or(F.col("tag") == punct).alias("__done"))
    return grouped.filter("__done").select(
        part, "section_pos", F.col("__items.v0").alias("words"), F.col("__items.v1").alias("tags"))


def drop_punct_only(sections: DataFrame, punct: str = PUNCT) -> DataFrame:
    """Drop sections whose only tag is `punct`."""
    return sections.filter(F.array_distinct("tags") != F.array(F.lit(punct)))


def flatten_sections(df: DataFrame, part: str = "doc_id", order: Sequence[str] = ("pos",),
                     punct: str = PUNCT, block: int | None = BLOCK) -> DataFrame:
    """Sections straight from words, as (part, section_pos, items array<struct<word,tag>>).

    Sections of punctuation only are dropped; the others keep their number.
    """
    rows = section_rows(df, part, order, punct, block)
    return rows.groupBy(part, "section_pos").agg(
        ordered(order, F.struct("word", "tag")).alias("__items")).select(
        part, "section_pos", F.col("__items.v0").alias("items"))


def section_rows(df: DataFrame, part: str = "doc_id", order: Sequence[str] = ("pos",),
                 punct: str = PUNCT, block: int | None = BLOCK) -> DataFrame:
    """Long form of `flatten_sections`: the words with their section number.

    A section has exactly one `punct` word, its last. It is punctuation only when the word before
    closed a section too, or there is none.
    """
    is_punct = F.col("tag") == F.lit(punct)
    rows = running(df, part, order, sums={"section_pos": is_punct.cast("int")},
                   lasts={"__before": F.coalesce(is_punct, F.lit(False))}, totals=True, block=block)
    alone = F.coalesce(is_punct, F.lit(False)) & F.coalesce("__before", F.lit(True))
    return rows.filter((F.col("section_pos") < F.col("section_pos_total")) & ~alone).drop(
        "section_pos_total", "__before")


def regroup_words(df: DataFrame, part: str = "example_id", order: Sequence[str] = ("pos",),
                  token: str = "token", label: str = "label", mask: str = MASK,
                  word_end: str = WORD_END, block: int | None = BLOCK) -> DataFrame:
    """Token labels back to words: mask rows are skipped, a word ends at a `word_end` label.

    The word's tag is the sorted set of the `+` parts of its labels without `word_end`. Output: part,
    word_pos, tokens, tag. A word still open at the end is dropped.
    """
    parts = F.split(F.col(label), r"\+")
    rows = number_runs(df.filter(F.col(label) != mask), part, order,
                       F.array_contains(parts, word_end), "word_pos", block=block)
    grouped = rows.groupBy(part, "word_pos").agg(
        ordered(order, F.col(token), F.col(label)).alias("__items"))
    all_parts = F.split(F.array_join(F.col("__items.v1"), "+"), r"\+")
    tags = F.sort_array(F.array_remove(F.array_distinct(all_parts), word_end))
    return grouped.select(part, "word_pos", F.col("__items.v0").alias("tokens"),
                          F.array_join(tags, "+").alias("tag"))


def words_from_tags(df: DataFrame, part: str = "example_id", order: Sequence[str] = ("pos",),
                    token: str = "token", label: str = "label", mask: str = MASK,
                    keep_head: bool = False, block: int | None = BLOCK) -> DataFrame:
    """Tagger output to words: every non-mask label starts one.

    Output: part, word_pos (from 1), tokens, tag. `keep_head` also gives word 0, the tokens before
    the first start, with tag ''; it is there, and empty, when the first label starts a word.
    """
    starts = (F.col(label) != mask).cast("int")
    rows = running_sums(df, part, order, {"word_pos": starts}, inclusive=True, block=block)
    words = rows.filter(F.col("word_pos") > 0).groupBy(part, "word_pos").agg(
        ordered(order, F.col(token), F.col(label)).alias("__items")).select(
        part, "word_pos", F.col("__items.v0").alias("tokens"), F.col("__items.v1")[0].alias("tag"))
    if not keep_head:
        return words
    head = rows.groupBy(part).agg(F.max("word_pos").alias("__words"))
    before = rows.filter(F.col("word_pos") == 0).groupBy(part).agg(
        ordered(order, F.col(token)).alias("__items"))
    empty = F.slice(F.array(F.lit(None).cast(df.schema[token].dataType)), 1, 0)
    heads = head.filter("__words > 0").join(before, part, "left").select(
        part, F.lit(0).cast("long").alias("word_pos"),
        F.coalesce(F.col("__items.v0"), empty).alias("tokens"), F.lit("").alias("tag"))
    # without any start all tokens form one item with an empty tag
    only = head.filter("__words = 0").join(before, part).select(
        part, F.lit(0).cast("long").alias("word_pos"), F.col("__items.v0").alias("tokens"),
        F.lit("").alias("tag"))
    return words.unionByName(heads).unionByName(only)
