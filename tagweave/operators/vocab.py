"""Learning a subword vocabulary with Spark.

The corpus is reduced once to distinct chunks (space-separated words, optionally cut after marks)
with their counts. Adjacent pairs are counted over all chunks, weighted, and merged in rounds. An index from pairs to
chunks lets a round touch only the chunks that hold its pairs; it yields changes of counts, not counts.
"""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.text import literal, syllables
from tagweave.operators.joins import keep_matching
from tagweave.operators.stats import char_coverage
from tagweave.operators.tokens import CONTROL, UNDERLINE
from tagweave.session import settle

# Symbols that are always pieces of their own.
USER_SYMBOLS = ("(", ")", '"', "-", ".", "–", "£", "€")
#: Merges that are tried in one round, and that wait at most before the chunks are rewritten.
_GUESSES, _PENDING = 128, 128
#: An index from pairs to chunks is made for so many merges, still wanted, for each chunk of `_SCAN` that a scan reads.
_INDEXED = 16
#: Pairs whose counts the driver holds.
_HELD = 1 << 15
#: Chunks on which the driver tries merges, and leading pairs from which it starts.
_SAMPLE, _LEADING = 20_000, 4096
#: Where a round touches more than one chunk in so many, a scan of all is cheaper than a look-up.
_SCAN = 32
#: What stands between chunks that are laid one after the other.
_GAP = -1

Pair = tuple[str, str]


@dataclass(frozen=True)
class Piece:
    text: str
    score: float
    kind: str = "normal"


def syllable_vocab(lines: DataFrame, line: str = "line", **marks: str) -> DataFrame:
    """Distinct syllables of a corpus."""
    return lines.select(F.explode(syllables(F.col(line), **marks)).alias("syllable")).distinct()


def chunk_counts(df: DataFrame, text: str = "text", marks: Sequence[str] = (),
                 user_symbols: Sequence[str] = USER_SYMBOLS) -> DataFrame:
    """Distinct chunks with counts; a word starts with the underline sign.

    Chunks end after a mark, and at a user symbol, which is never part of a longer piece.
    """
    words = df.select(F.explode(F.split(F.col(text), r"(?U)\s+")).alias("w")).filter("w != ''")
    counted = words.groupBy("w").count()
    cut = "|".join([*(f"(?<={literal(m)})" for m in marks),
                    *(f"(?<={literal(u)})|(?={literal(u)})" for u in user_symbols)])
    marked = F.concat(F.lit(UNDERLINE), "w")
    parts = F.split(marked, cut) if cut else F.array(marked)
    chunks = counted.select(F.explode(parts).alias("chunk"), "count")
    return chunks.filter((F.col("chunk") != "") & ~F.col("chunk").isin(*user_symbols)).groupBy("chunk").agg(
        F.sum("count").alias("count"))


def alphabet(chunks: DataFrame, share: float = 1.0) -> DataFrame:
    """Characters of the chunks that cover `share` of all occurrences: (char, count)."""
    chars = chunks.select(F.explode(F.split("chunk", "")).alias("char"), "count").filter("char != ''")
    counts = chars.groupBy("char").agg(F.sum("count").alias("count"))
    return counts if share >= 1 else char_coverage(counts, share)


def initial_states(chunks: DataFrame) -> DataFrame:
    """Every chunk as the array of its characters."""
    return chunks.select(F.array_remove(F.split("chunk", ""), "").alias("symbols"), "count")


def pair_counts(states: DataFrame) -> DataFrame:
    """Weighted counts of adjacent symbols: (left, right, count)."""
    return _pairs(states).groupBy("left", "right").agg(F.sum("count").alias("count"))


def _pairs(states: DataFrame) -> DataFrame:
    """One row for each two adjacent symbols, with the other columns of the chunk."""
    listed = states.filter(F.size("symbols") > 1)
    rest = [c for c in states.columns if c != "symbols"]
    return listed.select(*rest, F.explode(F.arrays_zip(
        F.slice("symbols", 1, F.size("symbols") - 1).alias("left"),
        F.slice("symbols", 2, F.size("symbols")).alias("right"))).alias("p")).select(*rest, "p.left", "p.right")


def _merged(symbols: list[str], left: str, right: str) -> list[str]:
    """The symbols with every `left`, `right` joined, from left to right."""
    out, at, last = [], 0, len(symbols) - 1
    while at <= last:
        if symbols[at] == left and at < last and symbols[at + 1] == right:
            out.append(left + right)
            at += 2
        else:
            out.append(symbols[at])
            at += 1
    return out


class _Laid:
    """The symbols of a batch of chunks as numbers, one chunk after the other with a gap around each.

    `names` numbers the symbols by their text and grows; it may serve many batches.
    """

    def __init__(self, column: pa.ListArray, counts: pa.Array, names: dict[str, int]):
        flat = column.flatten().dictionary_encode()
        known = np.array([names.setdefault(name, len(names)) for name in flat.dictionary.to_pylist()], np.int64)
        sizes = pc.list_value_length(column).to_numpy().astype(np.int64)
        chunk = np.repeat(np.arange(len(sizes)), sizes)
        self.codes = np.full(len(chunk) + len(sizes) + 1, _GAP, np.int64)
        self.codes[np.arange(len(chunk)) + chunk + 1] = known[flat.indices.to_numpy()]
        self.weights = np.append(np.repeat(counts.to_numpy(), sizes + 1), 0)
        self.names = names

    def pairs(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that begin at these places, as one number each, and how often each stands in the corpus."""
        starts = starts[(self.codes[starts] != _GAP) & (self.codes[starts + 1] != _GAP)]
        return self.codes[starts] << 32 | self.codes[starts + 1], self.weights[starts]

    def merge(self, left: str, right: str, changed: list[tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        """Join every `left`, `right` from left to right; `changed` gets the pairs that came and, with a minus, went."""
        a, b = self.names.get(left), self.names.get(right)
        if a is None or b is None:
            return
        at = np.flatnonzero((self.codes[:-1] == a) & (self.codes[1:] == b))
        if a == b and len(at):
            # of symbols that are all equal, every second place begins a pair
            opens = np.append(True, np.diff(at) != 1)
            run = at[opens][np.cumsum(opens) - 1]
            at = at[(at - run) % 2 == 0]
        if not len(at):
            return
        if changed is not None:
            pairs, counts = self.pairs(np.unique(np.concatenate([at - 1, at, at + 1])))
            changed.append((pairs, -counts))
        self.codes[at] = self.names.setdefault(left + right, len(self.names))
        kept = np.ones(len(self.codes), bool)
        kept[at + 1] = False
        # a chunk's weight stands at its symbols and at the gap before them
        self.codes, self.weights = self.codes[kept], self.weights[kept]
        if changed is not None:
            at -= np.arange(len(at))
            changed.append(self.pairs(np.unique(np.concatenate([at - 1, at]))))

    def symbols(self) -> pa.ListArray:
        gaps = np.flatnonzero(self.codes == _GAP)
        offsets = pa.array(gaps - np.arange(len(gaps)), pa.int32())
        texts = pa.array(list(self.names), pa.string()).take(pa.array(self.codes[self.codes != _GAP]))
        return pa.ListArray.from_arrays(offsets, texts)


def _summed(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each different number once, with the sum of its counts; those of sum 0 are left out."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    sums = np.zeros(len(pairs), np.int64)
    np.add.at(sums, place, np.concatenate([n for _, n in parts]))
    return pairs[sums != 0], sums[sums != 0]


def _named(pairs: np.ndarray, names: dict[str, int]) -> tuple[pa.Array, pa.Array]:
    """Left and right symbols of numbered pairs."""
    texts = pa.array(list(names), pa.string())
    return texts.take(pa.array(pairs >> 32)), texts.take(pa.array(pairs & 0xFFFFFFFF))


def _changes(before: list[str], after: list[str]) -> Iterator[tuple[Pair, int]]:
    for pair in itertools.pairwise(before):
        yield pair, -1
    for pair in itertools.pairwise(after):
        yield pair, 1


def _deltas(pending: Sequence[Pair], guesses: Sequence[Pair]):
    """What each of the guessed merges, one after the other, changes in the pair counts of the chunks of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        found: list[tuple[np.ndarray, np.ndarray]] = [_summed([]) for _ in guesses]
        for batch in batches:
            laid = _Laid(batch.column("symbols"), batch.column("count"), names)
            for pair in pending:
                laid.merge(*pair)
            for turn, pair in enumerate(guesses):
                changed: list[tuple[np.ndarray, np.ndarray]] = []
                laid.merge(*pair, changed)
                if changed:
                    found[turn] = _summed([found[turn], *changed])
        left, right = _named(np.concatenate([p for p, _ in found]), names)
        turns = np.repeat(np.arange(len(found), dtype=np.int32), [len(p) for p, _ in found])
        yield pa.RecordBatch.from_arrays([pa.array(turns), left, right, pa.array(np.concatenate([n for _, n in found]))],
                                         names=["step", "left", "right", "change"])
    return run


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted counts of the adjacent symbols of a task's chunks."""
    names: dict[str, int] = {}
    found = _summed([])
    for batch in batches:
        laid = _Laid(batch.column("symbols"), batch.column("count"), names)
        found = _summed([found, laid.pairs(np.arange(len(laid.codes) - 1))])
    yield pa.RecordBatch.from_arrays([*_named(found[0], names), pa.array(found[1])], names=["left", "right", "count"])


class _Sample:
    """The most frequent chunks, on which the driver tries merges ahead. They decide nothing: guesses that the counts
    of the whole corpus do not confirm are taken back."""

    def __init__(self, rows: list, total: int):
        self.states = [list(r["symbols"]) for r in rows]
        self.weights = [r["count"] for r in rows]
        self.scale = total / max(sum(self.weights), 1)
        self.holds: dict[Pair, set[int]] = defaultdict(set)
        for n, symbols in enumerate(self.states):
            for pair in itertools.pairwise(symbols):
                self.holds[pair].add(n)
        self.undo: list[list[tuple[int, list[str]]]] = []

    def merge(self, pair: Pair) -> dict[Pair, int]:
        changes: dict[Pair, int] = defaultdict(int)
        before = []
        for n in list(self.holds[pair]):
            symbols = self.states[n]
            after = _merged(symbols, *pair)
            if len(after) < len(symbols):
                before.append((n, symbols))
                self.states[n] = after
                for other, sign in _changes(symbols, after):
                    changes[other] += sign * self.weights[n]
                    if sign > 0:
                        self.holds[other].add(n)
        self.undo.append(before)
        return changes

    def guesses(self, best: list[tuple], allowed: Callable[[Pair], bool], counts: dict[Pair, int], many: int) -> list[Pair]:
        """The likely next merges, from the leading pairs and what they change in the sample."""
        self.undo, likely = [], dict(counts)
        heap = list(best)
        heapq.heapify(heap)
        out: list[Pair] = []
        while heap and len(out) < many:
            rank, pair = heapq.heappop(heap)
            if -rank[0] != likely.get(pair, 0) or rank[0] >= 0:
                continue
            if pair in out:
                break
            out.append(pair)
            for other, change in self.merge(pair).items():
                likely[other] = round(likely.get(other, 0) + change * self.scale)
                if likely[other] > 0 and allowed(other):
                    heapq.heappush(heap, (_rank(other, likely[other]), other))
            likely[pair] = 0
        return out

    def share(self) -> float:
        """Part of the sample that the guessed merges touch; the rarer chunks outside it are touched less."""
        touched = {n for before in self.undo for n, _ in before}
        return len(touched) / max(len(self.states), 1)

    def keep(self, steps: int) -> None:
        """Take back all but the first of the guessed merges."""
        for before in reversed(self.undo[steps:]):
            for n, symbols in before:
                self.states[n] = symbols
                for pair in itertools.pairwise(symbols):
                    self.holds[pair].add(n)
        self.undo = []


def _rank(pair: Pair, count: int) -> tuple:
    """Order of merging: most frequent first, then by shorter, then by smaller text."""
    text = pair[0] + pair[1]
    return -count, len(text), text, pair[0]


class _Corpus:
    """Distinct chunks as stored symbols, with an index from pairs to the chunks that hold them.

    Merges since the last rewrite are kept as a short list and applied when a chunk is read. A pair stands only in
    chunks that held, at the last rewrite, the pair of its inner ends, so the index of then serves until the next.
    The index is made when it is first asked for: the frequent pairs of the first rounds stand in most chunks.
    """

    def __init__(self, states: DataFrame):
        cores = states.sparkSession.sparkContext.defaultParallelism
        self.parts = max(cores, states.rdd.getNumPartitions())
        self.pending: list[Pair] = []
        self._store(states.repartition(self.parts).withColumn("id", F.monotonically_increasing_id()))

    def _store(self, states: DataFrame) -> None:
        self.states = settle(states)
        self.index: DataFrame | None = None
        self.ends: dict[str, tuple[str, str]] = {}

    def rewrite(self) -> None:
        pending = list(self.pending)

        def run(batches):
            names: dict[str, int] = {}
            for batch in batches:
                laid = _Laid(batch.column("symbols"), batch.column("count"), names)
                for pair in pending:
                    laid.merge(*pair)
                yield pa.RecordBatch.from_arrays([laid.symbols(), batch.column("count"), batch.column("id")],
                                                 names=["symbols", "count", "id"])
        self._store(self.states.select("symbols", "count", "id").mapInArrow(run, "symbols array<string>, count long, id long"))
        self.pending = []

    def accept(self, pairs: Sequence[Pair]) -> None:
        for left, right in pairs:
            # a text made in two ways has two kinds of ends; the rewrite that follows settles it
            self.ends[left + right] = self.ends.get(left, (left, left))[0], self.ends.get(right, (right, right))[1]
        self.pending += pairs

    def holding(self, guesses: Sequence[Pair], share: float, wanted: int) -> DataFrame:
        """Chunks that may hold one of the guessed pairs when its turn comes; all of them if a large share does, or if so
        few merges are still wanted that an index would cost more."""
        if share * _SCAN > 1 or (self.index is None and wanted < _INDEXED * _SCAN):
            return self.states
        if self.index is None:
            # sorted by pair, so that a look-up reads the row groups of its pairs
            self.index = settle(_pairs(self.states.drop("count")).distinct().repartitionByRange(self.parts, "left", "right")
                                .sortWithinPartitions("left", "right"))
        ends, inner = dict(self.ends), set()
        for left, right in guesses:
            inner.add((self.ends.get(left, (left, left))[1], self.ends.get(right, (right, right))[0]))
            self.ends[left + right] = self.ends.get(left, (left, left))[0], self.ends.get(right, (right, right))[1]
        self.ends = ends
        listed = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in sorted(inner)])
        here = F.col("left").isin(*sorted({a for a, _ in inner})) & F.array_contains(listed, F.struct("left", "right"))
        return keep_matching(self.states, self.index.filter(here).select("id").distinct(), ["id"], settled=True)

    def deltas(self, guesses: Sequence[Pair], share: float, wanted: int, floor: int) -> Iterator[dict[Pair, int]]:
        """Exact changes of the pair counts by each of the guessed merges in turn, but for rises up to `floor`.

        The rows are held as Arrow columns; those of one merge at a time become Python objects.
        """
        rows = self.holding(guesses, share, wanted).select("symbols", "count").mapInArrow(
            _deltas(list(self.pending), list(guesses)), "step int, left string, right string, change long")
        summed = rows.groupBy("step", "left", "right").agg(F.sum("change").alias("change")).filter(
            f"change < 0 OR change > {int(floor)}").toArrow().sort_by("step")
        ends = np.searchsorted(summed.column("step").to_numpy(), np.arange(len(guesses) + 1))
        for start, end in itertools.pairwise(ends.tolist()):
            left, right, change = (summed.column(c).slice(start, end - start).to_pylist() for c in ("left", "right", "change"))
            yield dict(zip(zip(left, right), change))

    def leading(self, held: int) -> tuple[dict[Pair, int], int]:
        """The most frequent pairs with their counts, and the count that no other pair exceeds (0 if these are all)."""
        sums = self.states.select("symbols", "count").mapInArrow(_pair_sums, "left string, right string, count long")
        top = sums.groupBy("left", "right").agg(F.sum("count").alias("count")).orderBy(
            F.col("count").desc(), "left", "right").limit(held).toArrow()
        counts = dict(zip(zip(*(top.column(c).dictionary_encode().to_pylist() for c in ("left", "right"))), top.column("count").to_pylist()))
        return counts, min(counts.values()) if len(counts) == held else 0


def train_bpe(chunks: DataFrame, merges: int, min_count: int = 1, allowed: Sequence[str] | None = None,
              batch: bool = True, held: int = _HELD) -> list[Pair]:
    """Merge rules in order, until they make `merges` different pieces.

    The most frequent pair comes first, ties by shorter, then smaller text. Exact: a round guesses the next merges
    on a bounded sample, and the chunks of the whole corpus that hold them say what each of them in turn changes in the
    pair counts. Guesses count as far as each is the most frequent pair after those before it; at least the first one
    is. The driver holds the counts of at most about `held` leading pairs, also while merges add new ones, and counts
    anew when these are used up.
    `batch=False` takes one merge a round. `allowed` restricts the alphabet.
    """
    letters = None if allowed is None else set(allowed)

    def usable(pair: Pair) -> bool:
        return letters is None or all(c in letters for c in pair[0] + pair[1])
    corpus = _Corpus(initial_states(chunks))
    counts, floor = corpus.leading(held)
    total = corpus.states.agg(F.sum("count")).first()[0] or 0
    sample = _Sample(corpus.states.orderBy(F.col("count").desc(), "symbols").limit(_SAMPLE if batch else 0).collect(), total)
    done: list[Pair] = []
    made: set[str] = set()
    many = _GUESSES if batch else 1
    while len(made) < merges:
        best = heapq.nsmallest(_LEADING, ((_rank(p, n), p) for p, n in counts.items() if n >= min_count and usable(p)))
        if floor and (not best or -best[0][0][0] <= floor):
            corpus.rewrite()
            counts, floor = corpus.leading(held)
            if floor and max(counts.values(), default=0) <= floor:
                held *= 2  # more pairs of one count than are held
                counts, floor = corpus.leading(held)
            continue
        if not best:
            break
        guesses = sample.guesses(best, usable, counts, min(many, merges - len(made))) if batch else [best[0][1]]
        heap, kept, again = best, 0, False
        heapq.heapify(heap)
        for pair, changes in zip(guesses, corpus.deltas(guesses, sample.share(), merges - len(made), floor)):
            while heap and -heap[0][0][0] != counts.get(heap[0][1], 0):
                heapq.heappop(heap)  # counted differently by now
            if not heap or heap[0][1] != pair or -heap[0][0][0] <= floor or len(heap) < _LEADING // 2 < len(counts) // 4:
                break
            text = pair[0] + pair[1]
            fresh = text not in made
            for other, change in changes.items():
                if other in counts or not floor or (fresh and text in other):
                    now = counts[other] = counts.get(other, 0) + change
                    if now <= 0:
                        del counts[other]
                    elif now >= min_count and usable(other):
                        heapq.heappush(heap, (_rank(other, now), other))
                elif change > 0:
                    again = True  # an old pair grew whose count is not held
            counts.pop(pair, None)
            made.add(text)
            kept += 1
            if again or not fresh or len(made) >= merges:
                again = again or not fresh
                break
        if not kept:
            raise RuntimeError(f"pair {guesses[0]} was not confirmed")
        done += guesses[:kept]
        sample.keep(kept)
        corpus.accept(guesses[:kept])
        many = min(2 * many, _GUESSES) if kept == len(guesses) else max(_GUESSES // 8, 2 * kept) if batch else 1
        if again or len(corpus.pending) >= _PENDING:
            corpus.rewrite()
        if again and floor:
            counts, floor = corpus.leading(held)
        elif len(counts) > 2 * held:
            # a pair comes with all its occurrences and then only loses some, so the rarer ones stay below this count
            floor = max(floor, heapq.nlargest(held + 1, counts.values())[-1])
            counts = {p: n for p, n in counts.items() if n > floor}
    return done


def bpe_pieces(chunks: DataFrame, size: int, coverage: float = 1.0, control: Sequence[str] = CONTROL,
               user_symbols: Sequence[str] = USER_SYMBOLS, batch: bool = True) -> list[Piece]:
    """A whole vocabulary of `size` pieces: specials, merged pieces in order, then characters."""
    chars = [r["char"] for r in alphabet(chunks, coverage).orderBy(F.col("count").desc(), "char").collect()]
    chars = [c for c in chars if c not in user_symbols]
    fixed = _fixed(control, user_symbols)
    room = size - len(fixed) - len(chars)
    if room < 0:
        raise ValueError(f"size {size} is below the {len(fixed) + len(chars)} specials and characters")
    rules = train_bpe(chunks, room, allowed=None if coverage >= 1 else chars, batch=batch)
    merged = list(dict.fromkeys(left + right for left, right in rules))
    ranked = [*merged, *chars]
    return [*fixed, *(Piece(text, -float(i)) for i, text in enumerate(ranked))]


def _fixed(control: Sequence[str], user_symbols: Sequence[str]) -> list[Piece]:
    return [Piece("<pad>", 0.0, "control"), Piece("<unk>", 0.0, "unknown"),
            *(Piece(c, 0.0, "control") for c in control),
            *(Piece(u, 0.0, "user") for u in user_symbols)]


def model_bytes(pieces: Sequence[Piece]) -> bytes:
    """The vocabulary as a standard SentencePiece model: pad 0, unk 1, no begin or end."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    model = pb.ModelProto()
    types = {"normal": 1, "unknown": 2, "control": 3, "user": 4}
    for piece in pieces:
        model.pieces.add(piece=piece.text, score=piece.score, type=types[piece.kind])
    spec = model.trainer_spec
    spec.model_type = 2  # pair merges
    spec.vocab_size = len(pieces)
    spec.pad_id, spec.unk_id, spec.bos_id, spec.eos_id = 0, 1, -1, -1
    norm = model.normalizer_spec
    norm.name = "identity"
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = True
    return model.SerializeToString()


def save_model(spark: SparkSession, pieces: Sequence[Piece], path: str) -> str:
    """Write the model through the file system that `path` names."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(model_bytes(pieces))
    finally:
        out.close()
    return path


def train_vocab(df: DataFrame, size: int = 10_000, coverage: float = 1.0,
                text: str = "text", marks: Sequence[str] = (), control: Sequence[str] = CONTROL,
                user_symbols: Sequence[str] = USER_SYMBOLS, **options) -> list[Piece]:
    """Learn a vocabulary of pair merges from all texts."""
    chunks = settle(chunk_counts(df, text, marks, user_symbols))
    return bpe_pieces(chunks, size, coverage, control, user_symbols, **options)
