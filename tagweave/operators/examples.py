"""Training examples: labels per piece, packing, padding, masking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.operators.runs import MASK, ordered
from tagweave.operators.sampling import coin, order_hash, text_hash
from tagweave.operators.scan import BLOCK, running_sums
from tagweave.operators.tags import IGNORED


def word_piece_labels(words: DataFrame, use_mask: bool = False, tokens: str = "tokens", tag: str = "tag",
                      mask: str = MASK) -> DataFrame:
    """One row per piece of a word: the first gets the word's label, the others `mask` or null.

    A null label is the ignored one (`IGNORED` once labels become ids).
    """
    rest = [c for c in words.columns if c not in (tokens, tag)]
    other = F.lit(mask) if use_mask else F.lit(None).cast("string")
    return words.select(*rest, tag, F.posexplode(tokens).alias("piece", "token")).select(
        *rest, "piece", "token", F.when(F.col("piece") == 0, F.col(tag)).otherwise(other).alias("label"))


def spread_labels(examples: DataFrame, tokens: str = "tokens", tags: str = "tags", mask: str = MASK,
                  out: str = "labels") -> DataFrame:
    """Flat tokens and labels of an example of words: a word's tag, then `mask` for its other tokens."""
    def spread(pair: Column) -> Column:
        return F.transform(pair.getField("w"), lambda _, i: F.when(i == 0, pair.getField("t")).otherwise(F.lit(mask)))
    zipped = F.arrays_zip(F.col(tokens).alias("w"), F.col(tags).alias("t"))
    rest = [c for c in examples.columns if c not in (tokens, tags)]
    return examples.select(*rest, F.flatten(tokens).alias(tokens),
                           F.flatten(F.transform(zipped, spread)).alias(out))


def pack_examples(df: DataFrame, max_len: int, part: str = "doc_id", order: Sequence[str] = ("example_no",),
                  tokens: str = "tokens", labels: str = "labels", whole: bool = True,
                  block: int = BLOCK) -> DataFrame:
    """Join the examples of a part into long sequences: (part, seq_no, tokens, labels).

    An example belongs to the sequence its first token falls in, so it stays whole and the last one
    of a sequence may run over `max_len`. With `whole=False` sequences are cut at exactly `max_len`.
    """
    placed = running_sums(df, part, order, {"__at": F.size(tokens)}, block=block)
    if not whole:
        zipped = F.arrays_zip(F.col(tokens).alias("t"), F.col(labels).alias("l"))
        placed = placed.select(part, "__at", F.posexplode(zipped).alias("__i", "__z")).select(
            part, (F.col("__at") + F.col("__i")).alias("__at"), F.array("__z.t").alias(tokens),
            F.array("__z.l").alias(labels))
        order = ("__at",)
    grouped = placed.groupBy(part, F.floor(F.col("__at") / max_len).alias("seq_no")).agg(
        ordered(order, F.col(tokens), F.col(labels)).alias("__items"))
    return grouped.select(part, "seq_no", F.flatten(F.col("__items.v0")).alias(tokens),
                          F.flatten(F.col("__items.v1")).alias(labels))


def walks(words: DataFrame, dupe_count: int = 0, dupe_offset: int = 3, index: str = "word_idx") -> DataFrame:
    """`dupe_count + 1` passes over the words; pass k starts `k * dupe_offset` words in."""
    passes = words.withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(dupe_count))))
    return passes.filter(F.col(index) >= F.col("walk") * dupe_offset)


def truncate_pad(df: DataFrame, max_len: int = 128, pad: int = 0, ignore: int = IGNORED,
                 tokens: str = "tokens", labels: str = "label_ids") -> DataFrame:
    """Equal-length model inputs: long sequences are cut, short ones padded; `cut` is the number of tokens left out."""
    missing = F.greatest(F.lit(max_len) - F.size(tokens), F.lit(0))
    kept = F.least(F.lit(max_len), F.size(tokens))
    def fill(items: Column, filler: int, kind: str) -> Column:
        return F.concat(F.slice(items, 1, max_len), F.array_repeat(F.lit(filler).cast(kind), missing))
    rest = [c for c in df.columns if c not in (tokens, labels)]
    return df.select(
        *rest,
        fill(F.col(tokens), pad, "int").alias("input_ids"),
        fill(F.col(labels), ignore, "int").alias("label_ids"),
        F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), missing)).alias("attention_mask"),
        F.array_repeat(F.lit(0), max_len).alias("token_type_ids"),
        F.greatest(F.size(tokens) - max_len, F.lit(0)).alias("cut"))


def build_label_map(df: DataFrame, label: str = "label", extra: Sequence[str] = ()) -> DataFrame:
    """Distinct labels numbered in order, `extra` ones after them: (label_id, label).

    The window runs over the distinct labels only, the outputs of one model.
    """
    seen = df.select(F.col(label).alias("label")).filter(F.col("label").isNotNull()).distinct().select(
        F.lit(0).alias("__late"), "label")
    if extra:
        added = df.sparkSession.createDataFrame([(i + 1, e) for i, e in enumerate(extra)],
                                                "__late int, label string")
        seen = seen.filter(~F.col("label").isin(*extra)).unionByName(added)
    number = F.row_number().over(Window.orderBy("__late", "label")) - 1
    return seen.select(number.cast("int").alias("label_id"), "label")


def dupe(df: DataFrame, factor: int = 4) -> DataFrame:
    """The same rows `factor` times, told apart by column `dupe` (from 1)."""
    return df.withColumn("dupe", F.explode(F.sequence(F.lit(1), F.lit(factor))))


def mlm_windows(df: DataFrame, max_seq: int = 128, short_seq_prob: float = 0.1, seed: int = 0,
                part: str = "doc_id", order: Sequence[str] = ("line_no",), tokens: str = "tokens",
                block: int = BLOCK) -> DataFrame:
    """Pack the tokenised lines of a document into sequences of at most `max_seq` tokens.

    A share of the sequences is cut in two at a random place, so that short ones occur; no token is
    lost. Output: part, seq_no, half (0 or 1), tokens.
    """
    placed = running_sums(df, part, order, {"__at": F.size(tokens)}, block=block)
    rows = placed.select(part, "__at", F.posexplode(tokens).alias("__i", "token")).select(
        part, (F.col("__at") + F.col("__i")).alias("at"), "token")
    rows = rows.withColumn("seq_no", F.floor(F.col("at") / max_seq))
    # the cut depends on the sequence, so it is drawn once per sequence after grouping
    seqs = rows.groupBy(part, "seq_no").agg(ordered(("at",), F.col("token")).alias("__items")).select(
        part, "seq_no", F.col("__items.v0").alias("tokens"))
    size = F.size("tokens")
    cut = (F.lit(2) + order_hash([part, "seq_no"], f"{seed}-cut") % max(1, max_seq - 3)).cast("int")
    short = coin([part, "seq_no"], f"{seed}-short", short_seq_prob) & (cut < size)
    whole = F.array(F.struct(F.lit(0).alias("half"), F.col("tokens").alias("tokens")))
    halves = F.array(F.struct(F.lit(0).alias("half"), F.slice("tokens", 1, cut).alias("tokens")),
                     F.struct(F.lit(1).alias("half"), F.slice("tokens", cut + 1, size).alias("tokens")))
    return seqs.select(part, "seq_no", F.explode(F.when(short, halves).otherwise(whole)).alias("__s")).select(
        part, "seq_no", "__s.half", "__s.tokens")


def sentence_order_pairs(segments: DataFrame, seed: int = 0, part: str = "doc_id", number: str = "seg_no",
                         tokens: str = "tokens") -> DataFrame:
    """Each segment with the one after it, swapped or not by a hash coin.

    The neighbour is found by an equi join on (part, number + 1); `number` must be gapless.
    """
    after = segments.select(part, (F.col(number) - 1).alias(number), F.col(tokens).alias("__next"))
    pairs = segments.select(part, number, F.col(tokens).alias("__this")).join(after, [part, number])
    swapped = coin([part, number], f"{seed}-order", 0.5)
    return pairs.select(
        part, number,
        F.when(swapped, F.col("__next")).otherwise(F.col("__this")).alias("first"),
        F.when(swapped, F.col("__this")).otherwise(F.col("__next")).alias("second"),
        swapped.cast("int").alias("is_swapped"))


def _length_limits(ngram: int, favor_short: bool) -> list[int]:
    """Limits in millionths below which a draw means a length of 1, 2, ...; lengths weigh 1/n or the other way round."""
    weights = [1 / n for n in range(1, ngram + 1)]
    if not favor_short:
        weights.reverse()
    return [round(1_000_000 * sum(weights[:n]) / sum(weights)) for n in range(1, ngram)]


def mask_places(tokens: Column, key: Column, special_ids: Sequence[int] = (0, 2, 3, 4), prob: float = 0.15,
                max_pred: int = 20, ngram: int = 3, favor_short: bool = False, seed: int = 12345) -> Column:
    """Places to predict, rising: array<int>.

    Every place draws a number from the key; it ranks the n-gram that starts there and, by its remainder, gives the
    length. N-grams are taken by rank while any of the wanted places are left: one that overlaps a taken one or holds
    a special id gives way, one that is longer than what is left is cut to it. An n-gram ends with its sequence.
    """
    size = F.size(tokens)
    wanted = F.least(F.lit(max_pred), F.greatest(F.lit(1), F.bround(size * F.lit(prob)).cast("int")), size)
    draw = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        text_hash(F.concat_ws("|", key, i.cast("string"), F.lit(f"{seed}-mask"))).alias("h"), i.alias("i")))

    def length(h: Column) -> Column:
        out = F.lit(ngram)
        for n, limit in reversed(list(enumerate(_length_limits(ngram, favor_short), 1))):
            out = F.when(h % 1_000_000 < limit, n).otherwise(out)
        return out

    ranked = F.sort_array(draw)  # compares natively; array_sort would interpret a comparator per pair
    start = F.struct(wanted.alias("left"), F.array().cast("array<int>").alias("taken"))

    def step(state: Column, gram: Column) -> Column:
        last = gram["i"] + F.least(length(gram["h"]), state["left"]) - 1
        free = (state["left"] > 0) & (last < size) & ~F.exists(state["taken"], lambda t: (t >= gram["i"]) & (t <= last))
        if special_ids:
            free = free & ~F.exists(F.slice(tokens, gram["i"] + 1, F.greatest(last - gram["i"] + 1, F.lit(1))),
                                    lambda t: t.isin(*special_ids))
        return F.when(free, F.struct((state["left"] - (last - gram["i"] + 1)).alias("left"),
                                     F.concat(state["taken"], F.sequence(gram["i"], last)).alias("taken"))).otherwise(state)

    # nearly always the first n-grams fill all places; the others are looked at only where they do not
    first = 2 * max_pred
    some = F.aggregate(F.slice(ranked, 1, first), start, step)
    rest = F.slice(ranked, first + 1, F.greatest(size, F.lit(1)))
    taken = F.transform(F.array(some), lambda s: F.when(s["left"] > 0, F.aggregate(rest, s, step)["taken"]).otherwise(s["taken"]))
    return F.when(size > 0, F.sort_array(taken[0])).otherwise(F.array().cast("array<int>"))


def mask_tokens(df: DataFrame, vocab_size: int, mask_id: int = 4, special_ids: Sequence[int] = (0, 2, 3, 4),
                prob: float = 0.15, max_pred: int = 20, ngram: int = 3, favor_short: bool = False,
                seed: int = 12345, key: Sequence[str] = ("doc_id", "seq_no"), tokens: str = "tokens") -> DataFrame:
    """Choose places to predict and hide them: adds `masked`, `positions` and `originals`.

    About `prob` of the tokens, at most `max_pred`, in n-grams of up to `ngram` (see `mask_places`). Of the
    chosen ones 80% become the mask id, 10% a random id and 10% stay. Special ids are never chosen. Everything is
    drawn by hashes of the key, the place and the seed, in columns.
    """
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    held = df.withColumn("__name", name).withColumn("positions", mask_places(
        F.col(tokens), F.col("__name"), special_ids, prob, max_pred, ngram, favor_short, seed))

    def hidden(place: Column) -> Column:
        draw = text_hash(F.concat_ws("|", F.col("__name"), place.cast("string"), F.lit(f"{seed}-hide")))
        other = F.shiftright(draw, 8) % vocab_size
        return F.when(draw % 10 < 8, mask_id).when(draw % 10 == 8, other.cast("int")).otherwise(F.get(tokens, place))

    # the map is bound to a name of its own: it would else be built again for every place
    new = F.map_from_arrays("positions", F.transform("positions", hidden))
    masked = F.transform(F.array(new), lambda m: F.transform(tokens, lambda t, i: F.coalesce(F.element_at(m, i), t).cast("int")))
    return held.select(
        *df.columns, masked[0].alias("masked"), "positions",
        F.transform("positions", lambda p: F.get(tokens, p).cast("int")).alias("originals"))
