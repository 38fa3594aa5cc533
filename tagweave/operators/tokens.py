"""Encoding text with a subword model as an Arrow-batched job.

The model travels with the job and is opened once per Python worker. Texts are cut into parts (control tokens, after
marks, between digit and comma, at spaces) as a column; the parts of a batch are encoded in one call. No stand-in
characters are put into a text, so no text can be mistaken for one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from tagweave.functions.text import MARKS, TSHEG, TSHEG_BSTAR, clean_text, literal
from tagweave.operators.tags import BAD, OK

UNDERLINE = "▁"
# Control tokens in the order of their ids after <pad> (0) and <unk> (1).
CONTROL = ("[CLS]", "[SEP]", "[MASK]")

#: Words of at most 64 characters whose ids a worker keeps, and arrays of at most 64 ids whose texts it keeps.
KNOWN = 1 << 17

_open: dict[str, object] = {}
_known: dict[tuple, tuple[dict[str, int], pa.ListArray]] = {}
_texts: dict[str, dict[bytes, str]] = {}
_NO_IDS = pa.array([()], pa.list_(pa.int32()))


@dataclass(frozen=True)
class Encoding:
    """How to encode: see `encode`."""

    marks: Sequence[str] = ()
    by_space: bool = False
    specials: Sequence[str] = field(default=CONTROL)
    lower: bool = False
    squeeze: bool = True
    keep_accents: bool = True
    wrap: bool = False
    max_length: int | None = None

    def key(self) -> tuple:
        """What tells two ways of encoding apart."""
        return (tuple(self.marks), self.by_space, tuple(self.specials), self.lower, self.squeeze, self.keep_accents, self.wrap,
                self.max_length)


class SubwordModel:
    """A SentencePiece model as bytes, shared with all workers and opened once in each.

    The bytes are one vocabulary file, a few megabytes at most.
    """

    def __init__(self, spark: SparkSession, content: bytes):
        self.name = hashlib.md5(content).hexdigest()
        self.shared = spark.sparkContext.broadcast(content)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SubwordModel:
        """From a model file on any file system Spark reads."""
        return cls(spark, bytes(spark.read.format("binaryFile").load(path).first()["content"]))

    def processor(self):
        if self.name not in _open:
            import sentencepiece as spm
            _open[self.name] = spm.SentencePieceProcessor(model_proto=self.shared.value)
        return _open[self.name]

    def inside(self):
        """The same model for a part inside a text: no underline put before it, no space taken away."""
        name = self.name + "-inside"
        if name not in _open:
            import sentencepiece as spm
            from sentencepiece import sentencepiece_model_pb2 as pb
            content = pb.ModelProto.FromString(self.shared.value)
            content.normalizer_spec.add_dummy_prefix = content.normalizer_spec.remove_extra_whitespaces = False
            _open[name] = spm.SentencePieceProcessor(model_proto=content.SerializeToString())
        return _open[name]


def cuts(text: Column, specials: Sequence[str] = CONTROL, marks: Sequence[str] = (), by_space: bool = False) -> Column:
    """The parts of a text that are encoded on their own, in order: array<string>.

    Control tokens stand alone, a mark ends a part, a comma after a digit stands alone, and with `by_space` so does
    every space. Glued together the parts are the text.
    """
    if any(m in s for s in specials for m in [*marks, " "]):
        raise ValueError("a control token may not hold a mark or a space")
    places = [side.format(literal(s)) for s in specials for side in ("(?<={})", "(?={})")]
    places += [f"(?<={literal(m)})" for m in marks]
    places += [r"(?<=\p{Nd})(?=,)", r"(?<=\p{Nd},)", *(["(?<= )", "(?= )"] if by_space else [])]
    return F.array_remove(F.split(text, "|".join(places)), "")


def _parts(text: Column, options: Encoding) -> Column:
    """The parts of a cleaned text, lower-cased if asked for; control tokens stay as they are."""
    parts = cuts(clean_text(text, False, options.squeeze, options.keep_accents), options.specials, options.marks, options.by_space)
    if options.lower:
        parts = F.transform(parts, lambda p: F.when(p.isin(*options.specials), p).otherwise(F.lower(p)))
    return parts


def _id_lists(model: SubwordModel, options: Encoding, rows: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
    """Ids of the parts of each row: flat ids, their number per row, and the text of those that are no known piece, by place."""
    bare, by_space, specials = model.inside(), options.by_space, frozenset(options.specials)
    unknown, underline = bare.unk_id(), bare.PieceToId(UNDERLINE)
    if not by_space and all(len(row) == 1 and row[0] not in specials for row in rows):
        # words of one part each, all of known pieces: nothing to look at part by part
        coded = bare.encode([" " + row[0] for row in rows], out_type=int, num_threads=1) if rows else []
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter(chain.from_iterable(coded), np.int32, sizes.sum())
        if not (ids == unknown).any():
            return ids, sizes, {}
    # the parts of all texts in one call; only the first part of a text opens with an underline
    wanted = [" " * (n == 0 and not by_space) + part for row in rows for n, part in enumerate(row)
              if part not in specials and not (by_space and part == " ")]
    coded = bare.encode(wanted, out_type=int, num_threads=1) if wanted else []
    found, lists, sizes, odd, at, nth = iter(coded), [], np.zeros(len(rows), np.int64), {}, 0, 0
    for r, row in enumerate(rows):
        start, gap = at, False
        for part in row:
            if by_space and part == " ":
                gap = True
                continue
            if part in specials:
                more, names = [bare.PieceToId(part)], [part]
            else:
                more, names = next(found), None
                if unknown in more:
                    names = bare.encode(wanted[nth], out_type=str, num_threads=1)
                    more = bare.PieceToId(names)
                nth += 1
            if gap and at > start and more:
                if underline == unknown:
                    odd[at] = UNDERLINE
                lists.append([underline])
                at += 1
            gap = False
            if names:
                odd.update((at + n, name) for n, (i, name) in enumerate(zip(more, names)) if i == unknown)
            lists.append(more)
            at += len(more)
        sizes[r] = at - start
    return np.fromiter(chain.from_iterable(lists), np.int32, at), sizes, odd


def _piece_names(model: SubwordModel) -> pa.Array:
    """The pieces of a model by id."""
    name = model.name + "-pieces"
    if name not in _open:
        processor = model.processor()
        _open[name] = pa.array([processor.IdToPiece(i) for i in range(processor.GetPieceSize())], pa.string())
    return _open[name]


def _finished(model: SubwordModel, options: Encoding, rows: Sequence[Sequence[str]]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Ids and pieces of each row, cut and wrapped as asked for, and how many a row lost."""
    ids, sizes, odd = _id_lists(model, options, rows)
    pieces = _piece_names(model).take(pa.array(ids))
    if odd:
        named = pieces.to_pylist()
        for at, name in odd.items():
            named[at] = name
        pieces = pa.array(named, pa.string())
    lost = np.zeros(len(sizes), np.int64)
    if options.max_length is not None or options.wrap:
        ends = np.cumsum(sizes)
        starts, kept = ends - sizes, sizes
        if options.max_length is not None:
            lost = np.maximum(sizes - (options.max_length - (2 if options.wrap else 0)), 0)
            kept = sizes - lost
        edge = 1 if options.wrap else 0
        sizes = kept + 2 * edge
        ends = np.cumsum(sizes)
        # places of the ids that stay; the two behind the last are the ids put around a row
        place = np.arange(sizes.sum()) + np.repeat(starts - edge - (ends - sizes), sizes)
        if edge:
            place[(ends - sizes)], place[ends - 1] = len(ids), len(ids) + 1
            processor = model.processor()
            ids = np.append(ids, [processor.PieceToId("[CLS]"), processor.PieceToId("[SEP]")]).astype(np.int32)
            pieces = pa.concat_arrays([pieces, pa.array(["[CLS]", "[SEP]"], pa.string())])
        ids, pieces = ids[place], pieces.take(pa.array(place))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return (pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(offsets, pieces), lost)


def encoded(text: Column, model: SubwordModel, options: Encoding = Encoding()) -> Column:
    """Column struct<tokens array<int>, pieces array<string>, cut int>; see `encode`."""
    @arrow_udf("tokens array<int>, pieces array<string>, cut int")
    def run(parts: pa.Array) -> pa.Array:
        ids, pieces, lost = _finished(model, options, [row or [] for row in parts.to_pylist()])
        return pa.StructArray.from_arrays([ids, pieces, pa.array(lost, pa.int32())], ["tokens", "pieces", "cut"])

    return run(_parts(text, options))


def encode(df: DataFrame, model: SubwordModel, text: str = "text",
           options: Encoding = Encoding()) -> DataFrame:
    """Add `tokens` (ids), `pieces` and `cut`, the number of tokens that truncation left out.

    `options`: `marks` keeps pieces from spanning a mark; `by_space` puts the underline only between
    space-separated parts; `specials` are never cut; `wrap` adds the begin and end ids; `max_length` truncates.
    """
    done = df.withColumn("__e", encoded(F.col(text), model, options))
    return done.select(*df.columns, "__e.tokens", "__e.pieces", "__e.cut")


def decoded(tokens: Column, model: SubwordModel) -> Column:
    """Text of an id array; equal arrays of a batch are decoded once, and a worker keeps the texts of the last `KNOWN` short ones."""
    @arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        processor, known = model.processor(), _texts.setdefault(model.name, {})
        if len(known) > KNOWN:
            known.clear()
        # arrays of ids as strings of bytes, so that equal ones are found without a Python object for each
        ends = 4 * ids.offsets.to_numpy().astype(np.int64)
        raw = pa.py_buffer(ids.values.to_numpy(zero_copy_only=False).astype(np.int32))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), raw]).dictionary_encode()
        rows = coded.dictionary.to_pylist()
        new = [row for row in rows if row not in known]
        fresh = dict(zip(new, processor.Decode([np.frombuffer(row, np.int32).tolist() for row in new], num_threads=1) if new else []))
        texts = [fresh[row] if row in fresh else known[row] for row in rows]
        known.update((row, text) for row, text in fresh.items() if len(row) <= 256)
        at = pa.array(coded.indices.to_numpy(), mask=ids.is_null().to_numpy(zero_copy_only=False))
        return pa.array(texts, pa.string()).take(at)
    return run(tokens)


def decoded_words(words: Column, model: SubwordModel) -> Column:
    """Text of each word of an array of id arrays."""
    @pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        processor = model.processor()
        return rows.map(lambda row: processor.Decode([word.tolist() for word in row], num_threads=1) if len(row) else [])
    return run(words)


def decode(df: DataFrame, model: SubwordModel, tokens: str = "tokens", out: str = "text") -> DataFrame:
    return df.withColumn(out, decoded(F.col(tokens), model))


def encode_words(df: DataFrame, model: SubwordModel, word: str = "word", options: Encoding = Encoding(marks=MARKS)) -> DataFrame:
    """Each row with the `tokens` of its word; no row is moved.

    A worker encodes a word once and keeps the ids of the last `KNOWN` short words, so neither the distinct words of the
    corpus nor a word that is a third of all rows meet in one place. Only words in which something may be cut or
    cleaned are taken apart as a column. Null and empty words have no tokens.
    """
    apart = "(?U)[\\s," + "".join(literal(c) for c in sorted({s[0] for s in options.specials} | set("".join(options.marks)))) + "]"
    whole = F.lit(options.keep_accents and not options.lower) & ~F.col(word).rlike(apart)

    @arrow_udf("array<int>")
    def run(words: pa.Array, parts: pa.Array) -> pa.Array:
        # the ids of the known words lie in one array, the first of them those of no word; `known` has their places
        known, stored = _known.get(key := (model.name, options.key()), ({}, _NO_IDS))
        if len(known) > KNOWN:
            known, stored = {}, _NO_IDS
        coded = words.dictionary_encode()
        names, at = coded.dictionary.to_pylist(), coded.indices.fill_null(len(coded.dictionary)).to_numpy()
        place = np.array([known.get(name, -1) if name else 0 for name in names] + [0], np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            first = np.zeros(len(names) + 1, np.int64)
            first[at[::-1]] = np.arange(len(at))[::-1]
            taken = parts.take(pa.array(first[new])).to_pylist()
            # words that are not taken apart come first, in a call of their own
            apart_here = np.array([row is not None for row in taken])
            new = new[np.argsort(apart_here, kind="stable")]
            parted = [row for row in taken if row is not None]
            ids = pa.concat_arrays([_finished(model, options, rows)[0] for rows in (
                [[names[n]] for n in new[:len(new) - len(parted)].tolist()], parted)])
            # short words first, as only they stay
            short = np.array([len(names[n]) <= 64 for n in new.tolist()])
            order = np.argsort(~short, kind="stable")
            place[new[order]] = len(stored) + np.arange(len(new))
            every = pa.concat_arrays([stored, ids.take(pa.array(order))])
            stay = new[order][:short.sum()]
            known.update(zip((names[n] for n in stay.tolist()), place[stay].tolist()))
            stored = pa.concat_arrays([every.slice(0, len(stored) + len(stay))])
        else:
            every = stored
        _known[key] = known, stored
        return every.take(pa.array(place[at]))

    return df.select("*", run(F.col(word), F.when(~whole, _parts(F.col(word), options))).alias("tokens"))


def _joined(flat: pa.Array, upto: np.ndarray, sizes: np.ndarray) -> Callable[[int], bytes]:
    """The strings of a row joined, as bytes: they stand one after the other in the array."""
    _, offsets, data = flat.cast(pa.string()).buffers()
    ends = np.frombuffer(offsets, np.int32)[flat.offset:] if len(flat) else np.zeros(1, np.int32)
    raw = memoryview(data) if data is not None else memoryview(b"")
    return lambda row: bytes(raw[ends[upto[row] - sizes[row]]:ends[upto[row]]])


def align_tokens(sections: DataFrame, model: SubwordModel, options: Encoding = Encoding(marks=MARKS), words: str = "words",
                 old: str = TSHEG_BSTAR, new: str = TSHEG) -> DataFrame:
    """Encode the joined words of a section and hand the tokens out to the words.

    A word takes the pieces up to its end; pieces after the last word are ignored. `tokens` is an array of id arrays,
    one per word, null with status bad where a word is empty or ends inside a piece.
    """
    @arrow_udf("tokens array<array<int>>, status string")
    def match(ids: pa.Array, pieces: pa.Array, targets: pa.Array) -> pa.Array:
        flat, wanted = pieces.flatten(), targets.flatten()
        n_parts, n_words = (pc.fill_null(pc.list_value_length(c), 0).to_numpy().astype(np.int64) for c in (pieces, targets))
        part_to, word_to = np.cumsum(n_parts), np.cumsum(n_words)
        part_row, word_row = (np.repeat(np.arange(len(n)), n) for n in (n_parts, n_words))
        sizes, lengths = (pc.utf8_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (wanted, flat))
        opens = (part_to - n_parts)[n_parts > 0]
        lengths[opens] -= pc.starts_with(flat.take(pa.array(opens)), UNDERLINE).to_numpy(zero_copy_only=False)
        # the sections are laid one after the other, so that one search finds the piece in which each word ends
        ends, stops = (np.cumsum(c) - np.repeat(np.concatenate([[0], np.cumsum(c)])[to - n], n)
                       for c, to, n in ((lengths, part_to, n_parts), (sizes, word_to, n_words)))
        room = np.zeros(len(n_parts), np.int64)
        np.maximum.at(room, part_row, ends + 2)
        np.maximum.at(room, word_row, stops + 2)
        shift = np.cumsum(room) - room
        ends, stops = ends + shift[part_row], stops + shift[word_row]
        at = np.searchsorted(ends, stops)
        met = (sizes > 0) & (np.append(ends, -1)[at] == stops)
        good = np.bincount(word_row[~met], minlength=len(n_words)) == 0
        whole, text = _joined(flat, part_to, n_parts), _joined(wanted, word_to, n_words)
        mark = UNDERLINE.encode()
        for row in np.flatnonzero(good):
            good[row] = whole(row).removeprefix(mark).replace(mark, b" ").startswith(text(row))
        begins = np.append(0, at + 1)[:len(at)]
        opens = (word_to - n_words)[n_words > 0]
        begins[opens] = (part_to - n_parts)[n_words > 0]
        begins, at = begins[good[word_row]], at[good[word_row]]
        many = at - begins + 1
        upto = np.cumsum(many)
        place = np.arange(many.sum()) + np.repeat(begins - upto + many, many)
        inner = pa.ListArray.from_arrays(pa.array(np.append(0, upto), pa.int32()), ids.flatten().take(pa.array(place)))
        outer = pa.array(np.append(0, np.cumsum(np.where(good, n_words, 0))), pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(outer, inner, mask=pa.array(~good)),
                                           pa.array(np.where(good, OK, BAD), pa.string())], ["tokens", "status"])

    unified = F.transform(words, lambda w: F.replace(w, F.lit(old), F.lit(new)))
    coded = sections.withColumn("__words", unified).withColumn(
        "__e", encoded(F.array_join("__words", ""), model, options))
    done = coded.withColumn("__m", match("__e.tokens", "__e.pieces", "__words"))
    return done.select(*sections.columns, "__m.tokens", "__m.status")


def segment_words(lines: DataFrame, segment: Callable[[list[str]], list[str]], line: str = "line") -> DataFrame:
    """Run the caller's word segmenter on batches of lines; one row per word of its space-joined answers."""
    rest = [f for f in lines.schema.fields if f.name != line]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "__words array<string>"])

    def run(batches):
        for batch in batches:
            out = batch.drop(columns=[line])
            out["__words"] = [answer.split(" ") for answer in segment(list(batch[line]))]
            yield out

    return lines.mapInPandas(run, schema).select(
        *[f.name for f in rest], F.posexplode("__words").alias("word_pos", "word"))
