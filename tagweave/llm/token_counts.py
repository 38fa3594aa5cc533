"""Token counts by a two-tier lookup where the text is read.

First tier: a compact table from the frequent pre-tokens of the corpus to their numbers of tokens, broadcast to
all workers. Each task counts the pre-tokens of all its documents and hands on its most frequent ones, merged as a
tree of bounded summaries; no pre-token is shuffled by key. Second tier: pre-tokens that miss are encoded once by
the library and kept in a bounded cache per worker. What the table holds changes the time only, never a count.
"""

from __future__ import annotations

import functools
import os
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from tagweave.llm.bpe import tokenizer_file
from tagweave.llm.common import Recent, chunks, enter, kept_fields, on_leave, table, text_of
from tagweave.llm.pretokens import added_tokens, load, splitter
from tagweave.session import ship_package

#: Entries of the broadcast table, and of each summary on the way to it.
FREQUENT = 32_768
#: Longest pre-token (characters) that enters the table.
LONGEST = 64
#: Entries of the cache of one worker, and of a running count before its rare half goes.
CACHED = 240_000
CONTEXT = 1024


class Counted:
    """Numbers of tokens of pieces of text, for one tokenizer file."""

    def __init__(self, content: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        specials = added_tokens(load(content))
        self.split = splitter(specials)
        self._library = Tokenizer.from_str(content)
        self._library.no_truncation()
        self._library.no_padding()
        self._library.encode_special_tokens = True
        self._library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._cache = Recent(CACHED)

    def lengths(self, pieces: list, frequent: dict[str, int]) -> np.ndarray:
        missing = self._cache.missing({p for p in set(pieces) if p not in frequent})
        first, second = frequent.get, self._cache.young
        if missing:
            texts = [p for p in missing if isinstance(p, str)]
            coded = self._library.encode_batch(texts, add_special_tokens=False)
            second.update((p, len(c.ids)) for p, c in zip(texts, coded))
            second.update((p, 1) for p in missing if not isinstance(p, str))  # added tokens
        return np.fromiter((first(p) or second[p] for p in pieces), np.int64, len(pieces))

    def counts(self, texts: list[str], frequent: dict[str, int]) -> list[int]:
        totals, held, owners = np.zeros(len(texts), np.int64), [], []

        def flush() -> None:
            if held:
                starts = np.cumsum([0, *(n for _, n in owners[:-1])])
                np.add.at(totals, [o for o, _ in owners], np.add.reduceat(self.lengths(held, frequent), starts))
                held.clear()
                owners.clear()

        for i, text in enumerate(texts):
            for block in self.split(text):
                if block:
                    held.extend(block)
                    owners.append((i, len(block)))
                if len(held) > 150_000:
                    flush()
        flush()
        return totals.tolist()


@functools.lru_cache(maxsize=2)
def counter(content: str) -> Counted:
    return Counted(content)


@functools.lru_cache(maxsize=1)
def _as_table(names: tuple[str, ...], lengths: bytes) -> dict[str, int]:
    return dict(zip(names, np.frombuffer(lengths, np.uint8).tolist()))


on_leave("token counts", lambda: (counter.cache_clear(), _as_table.cache_clear()))


def _most(counts: Counter, size: int) -> Counter:
    return counts if len(counts) <= size else Counter(dict(counts.most_common(size)))


def frequent_pretokens(docs: DataFrame, content: Broadcast, text: str = "text",
                       size: int = FREQUENT) -> tuple[tuple[str, ...], bytes]:
    """The frequent pre-tokens of all texts and their numbers of tokens, one byte each."""
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("token counts")
        split, seen = counter(content.value).split, Counter()
        for _, texts in chunks(batches, "text"):
            for t in texts:
                for block in split(t):
                    seen.update(block)
            if len(seen) > CACHED:
                seen = _most(seen, CACHED // 2)
        best = [(p, n) for p, n in _most(seen, size).items() if isinstance(p, str) and len(p) <= LONGEST]
        if best:
            names, numbers = zip(*best)
            yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string())),
                                              pa.array([numbers], pa.list_(pa.int64()))], names=["p", "n"])

    def merge(a: Counter, b: Counter) -> Counter:
        a.update(b)
        return _most(a, size)

    parts = docs.select(text_of(text).alias("text")).mapInArrow(summary, "p array<string>, n array<long>")
    merged = parts.rdd.map(lambda row: Counter(dict(zip(row.p, row.n)))).treeAggregate(Counter(), merge, merge, 3)
    names = tuple(sorted(merged))
    lengths = counter(content.value).lengths(list(names), {}) if names else np.zeros(0, np.int64)
    return names, lengths.astype(np.uint8).tobytes()  # at most 64 characters of 4 bytes, less than 256 tokens


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", keep: Sequence[str] = ("doc_id",),
                 into: str = "n_tokens", size: int = FREQUENT) -> DataFrame:
    """The columns `keep` and `into`, the number of tokens of each whole text, one row per row of `docs`.

    `tokenizer` is the path of a byte-level BPE file on the driver. Nothing is added around a text; added tokens
    inside it count as one. A null text has none, as the empty text. Repeated rows and rows with null keys are
    counted like any other; a kept column called like `into` gives way. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship_package(spark)
    content = tokenizer_file(spark, tokenizer)
    frequent = spark.sparkContext.broadcast(frequent_pretokens(docs, content, text, size))
    schema = kept_fields(docs, keep, T.StructField(into, T.LongType(), False))
    carried = [n for n in schema.names if n != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("token counts")
        model, known = counter(content.value), _as_table(*frequent.value)
        for batch, texts in chunks(batches, "__text"):
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in carried], pa.array(model.counts(texts, known), pa.int64())],
                names=[*carried, into])

    return docs.select(*[F.col(f"`{n}`") for n in carried], text_of(text).alias("__text")).mapInArrow(run, schema)


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", F.octet_length(text_of("text")).cast("long").alias("n_bytes"))
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "n_bytes"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > CONTEXT).alias("over_limit"))
