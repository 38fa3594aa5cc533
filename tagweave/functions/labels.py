"""Column helpers for labels and nested token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def join_tags(tags: Column) -> Column:
    return F.array_join(tags, "+")


def split_tags(tag: Column) -> Column:
    return F.split(tag, r"\+")


def bar_view(items: Column) -> Column:
    """An array shown in the corpus's `a|b|c` form."""
    return F.array_join(items, "|")


def split_bar(text: Column) -> Column:
    return F.split(text, r"\|")


def label_set(labels: Column) -> Column:
    """Upper-cased, distinct, sorted labels joined with `+`."""
    return F.array_join(F.sort_array(F.array_distinct(F.transform(labels, F.upper))), "+")


def token_key(tokens: Column) -> Column:
    """The text key of a token array: its ids joined with a space."""
    return F.array_join(tokens.cast("array<string>"), " ")


def argmax(scores: Column) -> Column:
    """Index of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def strip_ends(items: Column) -> Column:
    """All but the first and the last item."""
    return F.slice(items, 2, F.greatest(F.size(items) - 2, F.lit(0)))


def total_size(nested: Column) -> Column:
    """Number of inner items of an array of arrays."""
    return F.size(F.flatten(nested))


def first_index(items: Column, value: Column) -> Column:
    """Zero-based index of the first equal item, null if there is none."""
    at = F.array_position(items, value)
    return F.when(at > 0, (at - 1).cast("int"))
