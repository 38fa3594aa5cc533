"""Spans of words and tokens in a section, and labels from their overlap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.operators.batches import whole_groups
from tagweave.operators.runs import MASK, WORD_END
from tagweave.operators.scan import BLOCK, running, running_sums
from tagweave.operators.tags import BAD, OK

SECTION = ("doc_id", "section_pos")
#: Characters of a section that one block holds.
WIDTH = 1 << 14


def word_spans(df: DataFrame, section: Sequence[str] = SECTION, order: Sequence[str] = ("pos",),
               word: str = "word", block: int | None = BLOCK) -> DataFrame:
    """Half-open character spans [start, end) of the words in the joined section."""
    size = F.length(word)
    rows = running_sums(df, section, order, {"start": size}, block=block)
    return rows.withColumn("end", F.col("start") + size)


def token_spans(pieces: DataFrame, section: Sequence[str] = SECTION, order: Sequence[str] = ("idx",),
                piece: str = "value", block: int | None = BLOCK) -> DataFrame:
    """Spans of token pieces, from their running length; the piece is the token's own text."""
    return word_spans(pieces, section, order, piece, block)


def fixed_pieces(sections: DataFrame, width: int = 4, section: Sequence[str] = SECTION,
                 text: str = "text") -> DataFrame:
    """Cut the text of each section into pieces of `width` characters: (section, idx, value, start, end).

    Where the pieces are all of one width their spans are known as they are cut; `token_spans` finds the spans of any pieces.
    A text is run through once, however long it is.
    """
    values = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{int(width)}}}"), F.lit(0))
    cut = sections.select(*section, F.posexplode(values).alias("idx", "value")).withColumn("idx", F.col("idx").cast("long"))
    return cut.withColumn("start", F.col("idx") * width).withColumn("end", F.col("start") + F.length("value"))


def _overlapping(section: Sequence[str], rest: Sequence[str], word_end: str):
    """Labels of the tokens of a block from its words: one search over sorted places serves all blocks of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, firsts in whole_groups(batches, [*section, "__blk"]):
            start, end = rows.column("__start").to_numpy(), rows.column("__end").to_numpy()
            is_word = rows.column("__word").to_numpy(zero_copy_only=False)
            group = np.zeros(len(start), np.int64)
            group[firsts[1:]] = 1
            group = np.cumsum(group)
            # blocks are laid one after the other, so that spans of different ones never meet
            low, high = np.minimum.reduceat(start, firsts), np.maximum.reduceat(end, firsts)
            room = high - low + 2
            shift = np.cumsum(room) - room - low
            words, tokens = np.flatnonzero(is_word), np.flatnonzero(~is_word)
            if not len(tokens):
                continue
            ws, we = start[words] + shift[group[words]], end[words] + shift[group[words]]
            ts, te = start[tokens] + shift[group[tokens]], end[tokens] + shift[group[tokens]]
            # words that can touch a token stand between the first that reaches beyond its start and the last that begins by its end
            first = np.searchsorted(np.maximum.accumulate(we), ts, "right") if len(words) else np.zeros(len(ts), np.int64)
            count = np.maximum(np.searchsorted(ws, te, "right") - first, 0)
            token = np.repeat(np.arange(len(tokens)), count)
            word = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            over = (ws[word] < te[token]) & (we[word] > ts[token])
            ends = (we[word] > ts[token]) & (we[word] <= te[token])
            tags = rows.column("__tag").take(pa.array(words)).combine_chunks().dictionary_encode()
            names = [word_end, *(t for t in tags.dictionary.to_pylist() if t is not None)]
            order = sorted(set(names))
            place = np.array([order.index(n) for n in names], np.int64)
            code = tags.indices.fill_null(-2).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            over &= code[word] > 0  # a word without a tag gives no label
            pairs = np.unique(np.concatenate([
                token[over] * len(order) + place[code[word[over]]], token[ends] * len(order) + place[0]]).astype(np.int64))
            sizes = np.bincount(pairs // len(order), minlength=len(tokens))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            found = pa.ListArray.from_arrays(offsets, pa.array(order, pa.string()).take(pa.array(pairs % len(order))))
            kept = rows.select([*section, *rest]).take(pa.array(tokens)).combine_chunks()
            yield from kept.append_column("__labels", found).to_batches()
    return run


def label_tokens_by_overlap(tokens: DataFrame, words: DataFrame, section: Sequence[str] = SECTION,
                            idx: str = "idx", width: int = WIDTH, mask: str = MASK,
                            word_end: str = WORD_END, longest: int | None = None) -> DataFrame:
    """Give every token the tags of the words it overlaps, and `word_end` if a word ends in it.

    One shuffle, or none where tokens and words come dealt alike by a column of the section (`fixtures.keyed`): sections
    are cut into blocks of `width` characters; a token goes to the block it starts in, a word to all blocks it touches
    and to the one before if it starts near a border, and a sweep over the sorted spans of a block gives its labels,
    however long the section is. Tokens longer than half a block go to all blocks they touch and
    are gathered by a second shuffle; where `longest` says that there are none, that part of the plan is left out.
    Labels are upper-cased, distinct, sorted and joined with `+`; a token without a match gets `mask`.
    """
    section = list(section)
    reach = width // 2
    if longest is not None and longest > reach:
        longest = None
    rest = [c for c in tokens.columns if c not in section]
    blocks = T.StructType([T.StructField(c, tokens.schema[c].dataType) for c in [*section, *rest]])
    schema = T.StructType([*blocks.fields, T.StructField("__labels", T.ArrayType(T.StringType()))])
    spans = words.select(*section, F.col("start").cast("long").alias("__start"), F.col("end").cast("long").alias("__end"),
                         F.upper("tag").alias("__tag"), F.lit(True).alias("__word"))
    places = tokens.select(*section, *rest, F.col("start").cast("long").alias("__start"), F.col("end").cast("long").alias("__end"),
                           F.lit(False).alias("__word"))

    def block(place: str) -> Column:
        return F.expr(f"({place}) div {int(width)}")

    def swept(pieces: DataFrame, near: DataFrame) -> DataFrame:
        columns = [*section, *rest, "__blk", "__start", "__end", "__word", "__tag"]
        both = pieces.unionByName(near, allowMissingColumns=True).select(*columns)
        # the window gathers and sorts the rows of a block, and moves none where both sides lie together by key already
        inside = Window.partitionBy(*section, "__blk").orderBy("__start", "__end")
        return both.withColumn("__nth", F.row_number().over(inside)).mapInArrow(
            _overlapping(section, rest, word_end), schema)

    touched = F.explode(F.sequence(block(f"greatest(__start - {reach}, 0)"), block("__end")))
    short = places if longest is not None else places.filter(F.col("__end") - F.col("__start") <= reach)
    labelled = swept(short.withColumn("__blk", block("__start")), spans.withColumn("__blk", touched))
    if longest is None:
        whole = F.explode(F.sequence(block("__start"), block("__end")))
        long = places.filter(F.col("__end") - F.col("__start") > reach).withColumn("__blk", whole)
        apart = swept(long, spans.withColumn("__blk", whole)).groupBy(*section, *rest).agg(
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("__labels")))).alias("__labels"))
        labelled = labelled.unionByName(apart)
    keep = [c for c in rest if c != idx]
    return labelled.select(*section, idx, *keep, F.when(F.size("__labels") > 0, F.array_join("__labels", "+")).otherwise(
        F.lit(mask)).alias("label"))


def align_pieces(pieces: DataFrame, words: DataFrame, section: Sequence[str] = SECTION,
                 order: Sequence[str] = ("idx",), block: int | None = BLOCK) -> DataFrame:
    """Assign pieces to words where each word ends at the end of a piece.

    `pieces` and `words` carry start and end in the same section text. Adds `word_idx` (from 0) and
    `status`: a section is bad when a word is empty or ends inside a piece. Pieces after the last word
    keep the next index. Pieces and words are laid together by their ends, words first, and scanned twice; nothing
    is joined.
    """
    section = list(section)
    along = ["__at", "__piece", *order]
    ends = _laid_by_end(pieces, words, section, order, block)
    # a section is good if every place where words end is one where pieces end
    counted = running_sums(ends, section, along, {
        "word_idx": F.col("__hit").cast("int"), "__left": _left_over(), "__words": 1 - F.col("__piece")}, totals=True, block=block)
    return counted.filter((F.col("__piece") == 1) & (F.col("__words_total") > 0)).select(
        *pieces.columns, "word_idx", F.when(F.col("__left_total") == 0, OK).otherwise(BAD).alias("status"))


def _laid_by_end(pieces: DataFrame, words: DataFrame, section: Sequence[str], order: Sequence[str], block: int | None) -> DataFrame:
    """Words and pieces (`__piece` 0 and 1) of a section by their ends, words first; `__hit` says that a piece ends with a
    word, `__first` that a row is the first of its kind at its end."""
    at = F.coalesce(F.col("end").cast("long"), F.lit(0)).alias("__at")
    empty = ~F.coalesce(F.col("end") > F.col("start"), F.lit(False))
    laid = pieces.withColumn("__end", F.col("end")).select("*", at, F.lit(1).alias("__piece"), F.lit(False).alias("__empty")).unionByName(
        words.select(*section, F.col("end").alias("__end"), at, F.lit(0).alias("__piece"), empty.alias("__empty")), allowMissingColumns=True)
    is_piece = F.col("__piece") == 1
    ends = running(laid, section, ["__at", "__piece", *order], block=block,
                   lasts={"__word_end": F.when(~is_piece, F.col("__end")), "__piece_end": F.when(is_piece, F.col("__end"))})
    before = F.when(is_piece, F.col("__piece_end")).otherwise(F.col("__word_end"))
    return ends.withColumn("__hit", F.coalesce(is_piece & (F.col("__word_end") == F.col("__end")), F.lit(False))).withColumn(
        "__first", F.coalesce(before < F.col("__end"), F.lit(True))).drop("__word_end", "__piece_end")


def _left_over() -> Column:
    """What rows of `_laid_by_end` add to a number that is 0 for sections in which words end only where pieces do. Empty words add
    more than all pieces could take away."""
    place = F.when(F.col("__first") & (F.col("__piece") == 0), 1).when(F.col("__first") & F.col("__hit"), -1).otherwise(0)
    return place.cast("long") + F.when(F.col("__empty"), F.lit(1 << 40)).otherwise(F.lit(0))


def alignment_status(words: DataFrame, pieces: DataFrame, section: Sequence[str] = SECTION, block: int | None = BLOCK) -> DataFrame:
    """(section, words, status) without the piece rows."""
    section = list(section)
    ends = _laid_by_end(pieces.select(*section, "end"), words, section, (), block)
    return ends.groupBy(*section).agg(
        F.sum(1 - F.col("__piece")).alias("words"), F.sum(_left_over()).alias("__left")).filter("words > 0").select(
        *section, "words", F.when(F.col("__left") == 0, OK).otherwise(BAD).alias("status"))
