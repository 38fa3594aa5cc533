"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

The encoding of a word is fixed by the last token of each of its prefixes: the last token `t` of a prefix is
the one whose rest, the prefix without `t`, ends in a token that stays apart from `t`. Distinct new words of
a chunk form a trie; it is walked depth first (its words in sorted order, with one stack of last tokens for
the current path), so a shared prefix is computed once. The tokens that end at a place are known by the longest
piece of a token that ends there (`Place`), which each byte of a word moves on. Encodings of words are kept in a
bounded cache per Python worker. Each document is encoded where it is read: nothing is shuffled, and a round trip
decodes in the worker that encoded.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.common import Recent, chunks, enter, kept_fields, on_leave, table, text_of
from tagweave.llm.pretokens import Special, added_tokens, byte_letters, load, splitter
from tagweave.session import ship_package

#: Words whose encodings one Python worker keeps.
CACHED_WORDS = 240_000
#: Pairs of tokens whose verdict one Python worker keeps.
CACHED_PAIRS = 300_000
#: Steps from a place in a word to the next that one Python worker keeps.
CACHED_STEPS = 400_000
#: Bytes of a tokenizer file that may be broadcast.
MODEL_BYTES = 64 << 20


class Place(dict):
    """Where a walk stands in a word: the longest first part of a token that ends there, and the next place by byte.

    `ends` are the tokens that end there, the longest first, with their lengths.
    """
    __slots__ = ("model", "piece", "ends")

    def __init__(self, model: Encoder, piece: bytes):
        self.model, self.piece = model, piece
        suffixes = ((model.ids.get(piece[i:]), len(piece) - i) for i in range(len(piece)))
        self.ends = tuple((token, size) for token, size in suffixes if token is not None)

    def __missing__(self, byte: int) -> Place:
        piece = self.piece + bytes([byte])
        while piece not in self.model.firsts:
            piece = piece[1:]
        model, self[byte] = self.model, self.model.place(piece)
        model.steps += 1
        return self[byte]


class Encoder:
    """The tables of one tokenizer file and the walk over the trie of words."""

    def __init__(self, content: str):
        model = load(content)
        letters = byte_letters()
        vocab = model["model"]["vocab"]
        self.specials = added_tokens(model)
        spelled = {token: bytes(map(letters.__getitem__, token)) for token in vocab}
        self.ids = {spelled[token]: i for token, i in vocab.items()}
        self.spell = {i: spelled[token] for token, i in vocab.items()}
        self.spell |= {i: content.encode() for content, i in self.specials.items()}
        #: All first parts of tokens; single bytes are among them whether they are tokens or not.
        self.firsts = {token[:i] for token in self.ids for i in range(len(token) + 1)} | {bytes([b]) for b in range(256)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.merges = {}
        for rank, (left, right) in enumerate(pairs):
            self.merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self._made = self._find_parts()
        self.split = splitter(self.specials)
        self._apart: dict[int, bool] = {}
        self._words = Recent(CACHED_WORDS)
        self._places: dict[bytes, Place] = {}
        self.steps = 0

    def place(self, piece: bytes) -> Place:
        """The place after `piece`, one of `firsts`."""
        found = self._places.get(piece)
        if found is None:
            found = self._places[piece] = Place(self, piece)
        return found

    def merged(self, spelling: bytes) -> list[int]:
        """The encoding by the definition: the lowest merge first, the leftmost of equal ones."""
        parts = [self.ids[spelling[i:i + 1]] for i in range(len(spelling))]
        while len(parts) > 1:
            ranked = [(self.merges[pair][0], i) for i, pair in enumerate(itertools.pairwise(parts))
                      if pair in self.merges]
            if not ranked:
                break
            at = min(ranked)[1]
            parts[at:at + 2] = [self.merges[parts[at], parts[at + 1]][1]]
        return parts

    def _find_parts(self) -> dict[int, tuple[int, int, int]] | None:
        """The merge of each token: its rank and two parts.

        None if the file makes a token in two ways or before its parts: then pairs are tried by the definition.
        """
        made: dict[int, tuple[int, int, int]] = {}
        for (left, right), (rank, token) in self.merges.items():
            if token in made or any(made[p][0] > rank for p in (left, right) if p in made):
                return None
            made[token] = rank, left, right
        return made

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that its first (1) or last (2) bytes pass through while a token is merged.

        Each comes with the rank of the merge that takes it up (none for the token itself).
        """
        steps, until = [], float("inf")
        while True:
            steps.append((token, until))
            if token not in self._made:
                return steps
            until, token = self._made[token][0], self._made[token][side]

    def apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay as they are when their bytes are encoded together.

        They do not if a merge over their border comes before both of its parts are taken up elsewhere.
        """
        if self._made is None:
            return self.merged(self.spell[left] + self.spell[right]) == [left, right]
        firsts = self._edge(right, 1)
        for a, until in self._edge(left, 2):
            for b, limit in firsts:
                merge = self.merges.get((a, b))
                if merge is not None and merge[0] < until and merge[0] <= limit:
                    return False
        return True

    def walk(self, words: Iterable[bytes]) -> Iterator[tuple[int, ...]]:
        """Encodings of sorted words: a depth-first walk over their trie.

        `last[d]`, `size[d]` and `places[d]` are the last token, its length and the place at depth d of the current
        path. Going from one word to the next keeps the states of their shared prefix.
        """
        if len(self._apart) > CACHED_PAIRS:
            self._apart.clear()
        if self.steps > CACHED_STEPS:
            self.forget_places()
        last, size, places, path = [-1], [0], [self.place(b"")], b""
        verdicts = self._apart
        for word in words:
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1:], size[shared + 1:], places[shared + 1:]
            depth, place = shared, places[shared]
            for byte in word[shared:]:
                depth += 1
                place = place[byte]
                places.append(place)
                for token, length in place.ends:
                    if length < depth:
                        pair = last[depth - length] << 24 | token
                        stays = verdicts.get(pair)
                        if stays is None:
                            stays = verdicts[pair] = self.apart(last[depth - length], token)
                        if not stays:
                            continue
                    last.append(token)
                    size.append(length)
                    break
            path, at, out = word, len(word), []
            while at:
                out.append(last[at])
                at -= size[at]
            yield tuple(reversed(out))

    def forget_places(self) -> None:
        """Let the places go; they hold each other, so they are taken apart."""
        for place in self._places.values():
            place.clear()
        self._places.clear()
        self.steps = 0

    def encodings(self, pieces: list) -> list[tuple[int, ...]]:
        """The encoding of each piece, in order."""
        new = self._words.missing(set(pieces))
        known = self._words.young
        if new:
            known.update((p, (self.specials[p.content],)) for p in new if isinstance(p, Special))
            spelled = sorted((p.encode(), p) for p in new if isinstance(p, str))
            known.update(zip((p for _, p in spelled), self.walk(s for s, _ in spelled)))
        return list(map(known.__getitem__, pieces))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many belong to each text."""
        counts, parts, held, owners = np.zeros(len(texts), np.int64), [], [], []

        def flush() -> None:
            if held:
                coded = self.encodings(held)
                lengths = np.fromiter(map(len, coded), np.int64, len(coded))
                parts.append(np.fromiter(itertools.chain.from_iterable(coded), np.int32, int(lengths.sum())))
                np.add.at(counts, [o for o, _ in owners],
                          np.add.reduceat(lengths, np.cumsum([0, *(n for _, n in owners[:-1])])))
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
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), counts


class Decoder:
    """The spellings of the tokens of one file."""

    def __init__(self, content: str):
        model = load(content)
        letters = byte_letters()
        named = {i: bytes(map(letters.__getitem__, token)) for token, i in model["model"]["vocab"].items()}
        named |= {i: content.encode() for content, i in added_tokens(model).items()}
        self.spell = [named.get(i, b"") for i in range(max(named) + 1)]
        self.decimal = list(map(str, range(len(self.spell))))

    def decode(self, ids: np.ndarray) -> str:
        """Bytes of the ids as text; ids that are not in the file are passed over, broken UTF-8 is replaced."""
        ids = ids[(ids >= 0) & (ids < len(self.spell))]
        return b"".join(map(self.spell.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def encoder(content: str) -> Encoder:
    return Encoder(content)


@functools.lru_cache(maxsize=1)
def decoder(content: str) -> Decoder:
    return Decoder(content)


on_leave("bpe", encoder.cache_clear)
on_leave("bpe decoder", decoder.cache_clear)


def tokenizer_file(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast value; its size does not depend on the corpus and is checked."""
    content = Path(path).read_text(encoding="utf-8")
    if len(content) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} characters")
    load(content)
    return spark.sparkContext.broadcast(content)


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def _encoded(batches: Iterator[pa.RecordBatch], model: Encoder, text: str, ids: str,
             carried: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Batches of the carried columns and the ids of each text."""
    for batch, texts in chunks(batches, text):
        found, counts = model.encode(texts)
        coded = pa.ListArray.from_arrays(_offsets(counts), pa.array(found))
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in carried] + [coded], names=[*carried, ids])


def _decoded(batches: Iterator[pa.RecordBatch], model: Decoder, ids: str, text: str,
             carried: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Batches of the carried columns and the text of each row's ids."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            texts = list(map(model.decode, _arrays(part.column(ids))))
            yield pa.RecordBatch.from_arrays([part.column(n) for n in carried] + [pa.array(texts, pa.string())],
                                             names=[*carried, text])


def _arrays(lists: pa.ListArray) -> Iterator[np.ndarray]:
    """The ids of each row, without null ones; those of a null row are none."""
    if lists.null_count or lists.values.null_count:
        none = np.zeros(0, np.int32)
        yield from (none if row.values is None else row.values.drop_null().to_numpy() for row in lists)
        return
    ids = lists.values.to_numpy()
    yield from (ids[a:b] for a, b in itertools.pairwise(lists.offsets.to_pylist()))


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids",
           keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Token ids of each whole text: the columns `keep` and `ids` (array of int), one row per row of `df`.

    `tokenizer` is the path of a byte-level BPE file on the driver. A null text has no ids, as the empty text.
    Repeated rows and rows with null keys are encoded like any other. Added tokens inside a text are encoded
    as such; none is put around it. A kept column that is called like `ids` gives way to the result; other
    columns of `df` are not looked at. An empty table gives an empty table.
    """
    spark = df.sparkSession
    ship_package(spark)
    content = tokenizer_file(spark, tokenizer)
    schema = kept_fields(df, keep, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False))
    carried = [n for n in schema.names if n != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe")
        yield from _encoded(batches, encoder(content.value), "__text", ids, carried)

    return df.select(*[F.col(f"`{n}`") for n in carried], text_of(text).alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded",
           keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The text of each row's ids: the columns `keep` and `text`.

    A null array is the empty text; null ids and ids the file does not hold are passed over. Added tokens are
    written out. Bytes that are no UTF-8 become U+FFFD.
    """
    spark = df.sparkSession
    ship_package(spark)
    content = tokenizer_file(spark, tokenizer)
    schema = kept_fields(df, keep, T.StructField(text, T.StringType(), False))
    carried = [n for n in schema.names if n != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe decoder")
        yield from _decoded(batches, decoder(content.value), "__ids", text, carried)

    source = df.select(*[F.col(f"`{n}`") for n in carried], F.col(f"`{ids}`").cast("array<int>").alias("__ids"))
    return source.mapInArrow(run, schema)


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: its number of tokens and digests of its ids and of the text they decode to.

    The steps of `encode` and `decode`, one after the other in the same Python worker: ids and decoded texts are held
    for a chunk of texts at a time and do not go through the JVM.
    """
    spark = docs.sparkSession
    ship_package(spark)
    content = tokenizer_file(spark, tokenizer)
    schema = kept_fields(docs, (key,), T.StructField("n_tokens", T.LongType(), False),
                         T.StructField("ids_sha256", T.StringType(), False),
                         T.StructField("decoded_sha256", T.StringType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe round trip")
        there, back = encoder(content.value), decoder(content.value)
        name = back.decimal.__getitem__
        for batch in _encoded(batches, there, "__text", "ids", ["__key"]):
            digests = [_sha256(",".join(map(name, ids.tolist())).encode()) for ids in _arrays(batch.column("ids"))]
            counted = batch.append_column("n_tokens", batch.column("ids").value_lengths().cast(pa.int64())).append_column(
                "ids_sha256", pa.array(digests, pa.string()))
            for decoded in _decoded(iter([counted]), back, "ids", "decoded", ["__key", "n_tokens", "ids_sha256"]):
                texts = pa.array([_sha256(t.encode()) for t in decoded.column("decoded").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*decoded.columns[:3], texts], names=schema.names)

    return docs.select(F.col(f"`{key}`").alias("__key"), text_of(text).alias("__text")).mapInArrow(run, schema)


def op5_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    return round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
