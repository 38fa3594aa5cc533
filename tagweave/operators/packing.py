"""Packing the lines of documents into pretraining sequences, greedily and in parallel.

A sequence takes lines while they fit; where it ends depends on where it began, so openings form a chain through
each document. For every line the next opening, if one stood there, is a binary search over running sums. Blocks of
consecutive tokens follow these jumps on their own, by pointer doubling on arrays: first for every line at which a
block can be entered, at most one sequence's worth, which leaves one short table of entries and exits; doubling on that
table gives each block its true entry; then the blocks mark their openings. A document of any length is many
blocks, and no task holds more than one of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.operators.batches import whole_groups
from tagweave.operators.joins import attach, keep_matching
from tagweave.operators.runs import ordered
from tagweave.operators.sampling import coin, order_hash
from tagweave.operators.scan import BLOCK, running_sums
from tagweave.session import settle

#: Tokens of one block.
BLOCK_TOKENS = 1 << 16


def _jumps(rows: pa.Table, firsts: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line: the last line of a sequence that opens there, and the line after it (the row count where none).

    Groups are laid one after the other with a gap that no sequence spans, so one search serves them all.
    """
    at, size, target = (rows.column(c).to_numpy() for c in ("at", "size", "target"))
    n = len(at)
    group = np.cumsum(np.isin(np.arange(n), firsts)) - 1
    lasts = np.append(firsts[1:], n) - 1
    spans = at[lasts] + size[lasts] - at[firsts] + gap
    place = at - at[firsts][group] + (np.cumsum(spans) - spans)[group]
    last = np.maximum(np.searchsorted(place + size, place + target, "right") - 1, np.arange(n))
    following = last + 1
    outside = (following >= n) | (group[np.minimum(following, n - 1)] != group)
    return last, np.where(outside, n, following)


def _exits(part: str, budget: int, block: int):
    """For each line at which a block may be entered: where the chain leaves the block, and its last opening in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, firsts in whole_groups(batches, [part, "blk"]):
            last, following = _jumps(rows, firsts, budget + 1)
            at, size, blk = (rows.column(c).to_numpy() for c in ("at", "size", "blk"))
            inside = np.append(at // block == blk, False)
            # a line whose next opening lies outside points at itself; doubling ends there
            to = np.where(inside[following], following, np.arange(len(at)))
            while True:
                beyond = to[to]
                if (beyond == to).all():
                    break
                to = beyond
            enter = inside[:-1] & (at - blk * block < budget)
            yield pa.RecordBatch.from_arrays(
                [rows.column(part).filter(pa.array(enter)).combine_chunks(), pa.array(blk[enter]), pa.array(at[enter]),
                 pa.array((at[last] + size[last])[to][enter]), pa.array(at[to][enter])],
                names=[part, "blk", "entry", "leaves", "opened"])
    return run


def _marked(part: str, budget: int):
    """Add to each line the opening of its sequence."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, firsts in whole_groups(batches, [part, "blk"]):
            _, to = _jumps(rows, firsts, budget + 1)
            at, n = rows.column("at").to_numpy(), rows.num_rows
            entry = rows.column("entry").to_pandas().to_numpy()
            opens = np.append(at == entry, False)
            to = np.append(to, n)
            while (to[:n] < n).any():
                opens[to[opens.nonzero()[0]]] = True
                to = to[to]
            opens[n] = False
            latest = np.maximum.accumulate(np.where(opens[:n], np.arange(n), -1))
            start = np.zeros(n, np.int64)
            start[firsts] = firsts
            known = latest >= np.maximum.accumulate(start)
            before = rows.column("opened").to_pandas().fillna(-1).to_numpy().astype(np.int64)
            seq = np.where(known, at[np.maximum(latest, 0)], before)
            kept = rows.drop_columns(["blk", "entry", "opened", "target", "size"]).append_column("seq_at", pa.array(seq))
            yield from kept.to_batches()
    return run


def _entries(rows: DataFrame, part: str, budget: int, block: int) -> DataFrame:
    """(part, blk, entry, opened): where each block but the first of a document is entered, and what was opened before."""
    halo = rows.filter((F.col("blk") > 0) & (F.col("at") - F.col("blk") * block < budget)).withColumn("blk", F.col("blk") - 1)
    both = rows.unionByName(halo).repartition(part, "blk").sortWithinPartitions(part, "blk", "at")
    kind = rows.schema[part].dataType.simpleString()
    exits = settle(both.mapInArrow(_exits(part, budget, block), f"`{part}` {kind}, blk long, entry long, leaves long, opened long"))
    jump = exits.select(part, "blk", "entry", (F.col("blk") + 1).alias("to_blk"), F.col("leaves").alias("to_entry"))
    reached = exits.filter("blk = 0 and entry = 0").select(part, "blk", "entry")
    top, span = exits.agg(F.max("blk")).first()[0] or 0, 1
    while span <= top:
        more = reached.join(jump, [part, "blk", "entry"]).select(part, F.col("to_blk").alias("blk"), F.col("to_entry").alias("entry"))
        reached = settle(reached.union(more).distinct())
        further = jump.select(part, F.col("blk").alias("to_blk"), F.col("entry").alias("to_entry"),
                              F.col("to_blk").alias("__blk"), F.col("to_entry").alias("__entry"))
        jump = settle(jump.join(further, [part, "to_blk", "to_entry"]).select(
            part, "blk", "entry", F.col("__blk").alias("to_blk"), F.col("__entry").alias("to_entry")))
        span *= 2
    return exits.join(reached, [part, "blk", "entry"], "left_semi").select(
        part, (F.col("blk") + 1).alias("blk"), F.col("leaves").alias("entry"), "opened")


def pack_lines(df: DataFrame, budget: int, short_prob: float = 0.1, seed: int = 0, part: str = "doc_id",
               order: Sequence[str] = ("line_no",), tokens: str = "tokens", block: int = BLOCK,
               block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Lines with the sequence they belong to: (part, at, tokens, seq_at), both places in tokens from the document's start.

    A sequence takes lines while they fit into its target: `budget` tokens, or for a share of the openings a number
    from 2 to `budget` that a hash of the opening draws. Its first line it takes in any case. Lines longer than the budget are cut
    into pieces, lines without tokens left out; no token is lost. `part` must not be null.
    """
    if budget < 2 or budget >= block_tokens:
        raise ValueError(f"a sequence holds from 2 to {block_tokens - 1} tokens")
    cut = df.filter(F.size(tokens) > 0).select(part, *order, F.posexplode(F.transform(
        F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(budget)), lambda a: F.slice(tokens, a + 1, budget))).alias("piece", "tokens"))
    placed = running_sums(cut, part, (*order, "piece"), {"at": F.size("tokens")}, block=block)
    draw = order_hash([part, "at"], f"{seed}-target") % (budget - 1) + 2
    target = F.when(coin([part, "at"], f"{seed}-short", short_prob), draw).otherwise(F.lit(budget).cast("long"))
    rows = settle(placed.select(part, "at", "tokens", F.size("tokens").cast("long").alias("size"), target.alias("target"),
                                F.expr(f"at div {block_tokens}").alias("blk")))
    several = settle(rows.filter("blk > 0").select(part).distinct())
    if several.limit(1).count():
        long = keep_matching(rows.drop("tokens"), several, [part], salt_by=["at"])
        entered = attach(rows, _entries(settle(long), part, budget, block_tokens), [part, "blk"], salt_by=["at"], settled=True)
    else:
        entered = rows.withColumn("opened", F.lit(None).cast("long")).withColumn("entry", F.lit(None).cast("long"))
    entered = entered.withColumn("entry", F.when(F.col("blk") == 0, F.lit(0)).otherwise(F.col("entry")).cast("long"))
    schema = T.StructType([rows.schema[c] for c in (part, "at", "tokens")] + [T.StructField("seq_at", T.LongType())])
    inputs = entered.select(part, "at", "tokens", "size", "target", "blk", "entry", "opened")
    return inputs.repartition(part, "blk").sortWithinPartitions(part, "blk", "at").mapInArrow(_marked(part, budget), schema)


def _framed(first: Column, second: Column, begin: int, end: int) -> tuple[Column, Column]:
    """[CLS] A [SEP] B [SEP] and its segment ids; without B, [CLS] A [SEP]."""
    def ids(*values: int) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<int>")
    alone = F.size(second) == 0
    tokens = F.concat(ids(begin), first.cast("array<int>"), ids(end))
    return (F.when(alone, tokens).otherwise(F.concat(tokens, second.cast("array<int>"), ids(end))),
            F.when(alone, F.array_repeat(F.lit(0), F.size(first) + 2)).otherwise(F.concat(
                F.array_repeat(F.lit(0), F.size(first) + 2), F.array_repeat(F.lit(1), F.size(second) + 1))))


def pretraining_sequences(df: DataFrame, max_seq: int = 128, pairs: bool = True, short_prob: float = 0.1, seed: int = 0,
                          part: str = "doc_id", order: Sequence[str] = ("line_no",), tokens: str = "tokens",
                          begin: int = 2, end: int = 3, **options) -> DataFrame:
    """Sequences of at most `max_seq` ids: (part, seq_at, input_ids, segment_ids, is_swapped).

    With `pairs` a sequence is cut between two of its lines, or inside its only line, at a place that a hash draws; the two
    segments are swapped for half of the sequences. A sequence of a single token is one segment. Without `pairs`
    every sequence is one segment, never swapped.
    """
    lines = pack_lines(df, max_seq - (3 if pairs else 2), short_prob, seed, part, order, tokens, **options)
    seqs = lines.groupBy(part, "seq_at").agg(ordered(("at",), F.col("tokens")).alias("i")).select(
        part, "seq_at", F.col("i.v0").alias("lines"))
    if not pairs:
        flat = seqs.withColumn("a", F.flatten("lines")).withColumn("b", F.slice("a", 1, 0)).withColumn("is_swapped", F.lit(0))
    else:
        count, whole = F.size("lines"), F.flatten("lines")
        draw = order_hash([part, "seq_at"], f"{seed}-cut")
        # tokens before the cut: whole lines if there are several
        ahead = F.size(F.flatten(F.slice("lines", 1, (draw % F.greatest(count - 1, F.lit(1)) + 1).cast("int"))))
        inside = (draw % F.greatest(F.size(whole) - 1, F.lit(1)) + 1).cast("int")
        halves = seqs.select(part, "seq_at", whole.alias("all"), F.when(count > 1, ahead).otherwise(inside).alias("cut"))
        halves = halves.select(part, "seq_at", F.slice("all", F.lit(1), F.col("cut")).alias("a"),
                               F.slice("all", F.col("cut") + 1, F.size("all")).alias("b"))
        flat = halves.withColumn("is_swapped", (coin([part, "seq_at"], f"{seed}-order", 0.5) & (F.size("b") > 0)).cast("int"))
    turned = F.col("is_swapped") == 1
    ready = flat.select(part, "seq_at", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"),
                        F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), "is_swapped")
    input_ids, segment_ids = _framed(F.col("a"), F.col("b"), begin, end)
    return ready.select(part, "seq_at", input_ids.alias("input_ids"), segment_ids.alias("segment_ids"), "is_swapped")
