"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.session import ship_package

#: Characters of text that a Python task holds as separate words at one time.
CHUNK_CHARS = 1_000_000

_leave: dict[str, Callable[[], None]] = {}
_inside: list[str] = []


def on_leave(name: str, clear: Callable[[], None]) -> None:
    """What a Python worker lets go when it turns from operator `name` to another one."""
    _leave[name] = clear


def enter(name: str) -> None:
    """Called where a task of operator `name` starts: a worker that served another one gives its memory back."""
    if _inside and _inside[-1] != name:
        for other, clear in _leave.items():
            if other != name:
                clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)
    _inside[:] = [name]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text of a row; null is the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def kept_fields(df: DataFrame, keep: Sequence[str], *new: T.StructField) -> T.StructType:
    """Schema of the kept columns followed by new ones, which win over kept ones of the same name."""
    names = {f.name.lower() for f in new}
    return T.StructType([T.StructField(f.name, f.dataType, True) for k in keep for f in [df.schema[k]]
                         if k.lower() not in names] + list(new))


def chunks(batches: Iterator[pa.RecordBatch], column: str,
           limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut record batches so that one piece holds about `limit` characters, one row at least."""
    for whole in batches:
        for first in range(0, whole.num_rows, 500):
            batch = whole.slice(first, 500)
            texts = batch.column(column).to_pylist()
            start = size = 0
            for i, text in enumerate(texts):
                if size and size + len(text) > limit:
                    yield batch.slice(start, i - start), texts[start:i]
                    start, size = i, 0
                size += len(text)
            if start < len(texts):
                yield batch.slice(start), texts[start:]


class Recent:
    """Values of keys used lately: at most `size`, in a young and an old half.

    When the young half is full it becomes the old one; what is used again moves back to the young half.
    """

    def __init__(self, size: int):
        self.half = max(size // 2, 1)
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        """Those of the keys that are not known; the others are in the young half afterwards."""
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}
        young, old, out = self.young, self.old, []
        for key in keys:
            if key not in young:
                if key in old:
                    young[key] = old[key]
                else:
                    out.append(key)
        return out


def groups(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of one key after the other, as arrays by column, from rows sorted by the key (whole numbers)."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if held:
            rows = {n: np.concatenate([held[n], rows[n]]) for n in rows}
        changed = np.zeros(len(rows[key[0]]) - 1, bool)
        for name in key:
            changed |= rows[name][1:] != rows[name][:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist()]
        for a, b in itertools.pairwise(cuts):
            yield {n: values[a:b] for n, values in rows.items()}
        held = {n: values[cuts[-1]:] for n, values in rows.items()}
    if held:
        yield held


def together(parts: list[list[np.ndarray]], names: Sequence[str]) -> pa.RecordBatch:
    """Rows gathered part by part, as one record batch."""
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=list(names))
