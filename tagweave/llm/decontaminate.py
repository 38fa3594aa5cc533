"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages, and items likewise. Over the words of the benchmark, passages are TF-IDF
vectors; one pass over all documents gathers the passage counts of the words and the product of the passage matrix
with a random start, from which the driver takes the leading singular vectors (randomised SVD, Nystroem form; all of
it of the size of the benchmark's vocabulary). The passages of the items are added to this decomposition as further
rows, and it is cut at the rank that holds the share `HELD` of their weight: words that the documents use alike fall
together. A second pass projects every passage, takes pairs by cosine, and verifies each against the whole item where
the document is read: longest common subsequence of words, and for paraphrases the words of the answer. No text is
shuffled. Items are searched for in blocks, each with a space of its own, all of them in the same pass as far as
`SPACE_BYTES` goes.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tagweave.llm.common import chunks, enter, table, text_of
from tagweave.llm.shingles import words_of
from tagweave.operators.joins import drop_matching, measured_size
from tagweave.session import settle, ship_package

#: Words of half a passage; passages are two halves and overlap by one.
HALF = 24
#: Singular vectors of the documents' passages.
RANK = 32
#: Share of the weight of the items' passages that the latent space holds, of all on average and of each at least.
HELD, HELD_EACH = 0.9, 0.6
#: Passages of items that share a space.
BLOCK = 256
#: Bytes of a benchmark that the driver takes in, and bytes of numbers that a pass may broadcast.
BENCHMARK_BYTES, SPACE_BYTES = 64 << 20, 128 << 20
#: Cosine from which a passage is a candidate. Where an item says less than a passage, so that no passage could reach
#: that, it is the cosine that a passage with the share `HOLDS` of the item's weight has.
COSINE, HOLDS = 0.55, 0.5
#: Share of an item's words in common order: surely a leak, and a paraphrase if the answer is there as well.
SURE, PARAPHRASE = 0.7, 0.5
ANSWER = 0.6


@dataclass
class Item:
    item: object
    words: list[str]
    answer: frozenset = field(default_factory=frozenset)


@dataclass
class Space:
    """A block of passages of items: its words, their projection, and where each passage lies in it and in its item."""
    numbers: np.ndarray
    projection: np.ndarray
    targets: np.ndarray
    item: np.ndarray
    begin: np.ndarray


def _answer(text: str, words: list[str]) -> frozenset:
    """Words of the item's last sentence that are not in its other sentences, or of its last third."""
    sentences = [words_of(s) for s in text.replace("?", ".").replace("!", ".").replace("\n", " ").split(".")]
    sentences = [s for s in sentences if s]
    last = sentences[-1] if len(sentences) > 1 and len(sentences[-1]) > 2 else words[-max(3, len(words) // 3):]
    return frozenset(last)


def read_items(benchmark: DataFrame, item: str = "item_id", text: str = "text",
               answer: str | None = None) -> list[Item]:
    """The items of a benchmark of checked size; null and empty texts are no items."""
    _, size = measured_size(benchmark.select(F.col(f"`{text}`").cast("string").alias("t")))
    if size > BENCHMARK_BYTES:
        raise ValueError(f"the benchmark is larger than {BENCHMARK_BYTES} bytes: search for it in parts")
    columns = [F.col(f"`{item}`").alias("i"), text_of(text).alias("t"),
               (text_of(answer) if answer else F.lit("")).alias("a")]
    out = []
    for row in benchmark.select(*columns).distinct().collect():
        words = words_of(row.t)
        if words:
            out.append(Item(row.i, words, frozenset(words_of(row.a)) or _answer(row.t, words)))
    return sorted(out, key=lambda x: (str(x.item), x.words))


def _halves(texts: list[str], vocabulary: dict[str, int]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; for each known word its number and its half passage; the text of each half."""
    words = [words_of(t) for t in texts]
    ids = np.fromiter(map(vocabulary.get, itertools.chain.from_iterable(words), itertools.repeat(-1)), np.int32,
                      sum(map(len, words)))
    sizes = np.array([len(w) for w in words], np.int64)
    counts = -(-sizes // HALF)
    first = np.cumsum(counts) - counts
    within = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    half = np.repeat(first, sizes) + within // HALF
    owner = np.repeat(np.arange(len(texts)), counts)
    known = ids >= 0
    return words, ids[known], half[known], owner


def _passages(halves: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each half with the one that follows it in its text."""
    out = halves.copy()
    if len(owner) > 1:
        same = owner[1:] == owner[:-1]
        out[:-1][same] += halves[1:][same]
    return out


def _sums(table: np.ndarray, ids: np.ndarray, half: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of `table` over the words of each half."""
    out = np.zeros((n, table.shape[1]), np.float32)
    if len(ids):
        starts = np.flatnonzero(np.append(True, half[1:] != half[:-1]))
        counts = np.diff(np.append(starts, len(ids)))
        step = 256  # halves whose sums stay in a cache
        for a in range(0, len(starts), step):
            # first words of all of them, then second ones and so on; halves of many words come first
            order = np.argsort(-counts[a:a + step], kind="stable") + a
            first, below = starts[order], -counts[order]
            held = table[ids[first]]
            for k in range(1, -below[0]):
                more = int(np.searchsorted(below, -k))
                held[:more] += table[ids[first[:more] + k]]
            out[half[first]] = held
    return out


def gathered(docs: DataFrame, vocabulary: dict[str, int], start: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Over all passages: their number, how many halves hold each word, and counts' counts' start.

    With N the matrix of passage by word this is the pass for N'N times the random start.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, start.astype(np.float32)))
    rank = start.shape[1]
    columns = [f"y{k}" for k in range(rank)]
    schema = "word int, held long, " + ", ".join(f"{c} double" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("leaks")
        known, first = shared.value
        size = len(known)
        held, total, passages = np.zeros(size, np.int64), np.zeros((size, rank)), 0
        for _, texts in chunks(batches, "text"):
            _, ids, half, owner = _halves(texts, known)
            passages += len(owner)
            if not len(ids):
                continue
            seen = _passages(_sums(first, ids, half, len(owner)), owner)
            back = seen.copy()  # a half stands in its own passage and in the one before
            same = np.flatnonzero(owner[1:] == owner[:-1]) + 1
            back[same] += seen[same - 1]
            order = np.argsort(ids, kind="stable")
            ids, half = ids[order], half[order]
            new = np.append(True, (ids[1:] != ids[:-1]) | (half[1:] != half[:-1]))
            held += np.bincount(ids[new], minlength=size)
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            step = 1 << 13
            for a in range(0, len(ids), step):
                inside = starts[(starts >= a) & (starts < a + step)]
                inside = np.unique(np.append(inside, a))
                total[ids[inside]] += np.add.reduceat(back[half[a:a + step]], inside - a, axis=0)
        seen = np.flatnonzero(held)
        values = np.vstack([total[seen], np.zeros((1, rank))])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1).astype(np.int32)), pa.array(np.append(held[seen], passages)),
             *[pa.array(np.ascontiguousarray(values[:, k])) for k in range(rank)]], names=["word", "held", *columns])

    summed = (docs.mapInArrow(run, schema).groupBy("word")
              .agg(F.sum("held").alias("held"), *[F.sum(c).alias(c) for c in columns])).collect()
    held, total, passages = np.zeros(len(vocabulary), np.int64), np.zeros((len(vocabulary), rank)), 0
    for row in summed:
        if row[0] < 0:
            passages = row[1]
        else:
            held[row[0]], total[row[0]] = row[1], row[2:]
    return passages, held, total


def singular(start: np.ndarray, product: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors and values of A from a start W and A'A W (Nystroem)."""
    norm = np.linalg.norm(product)
    if not norm:
        return np.zeros((len(start), 0)), np.zeros(0)
    shift = 1e-10 * norm
    shifted = product + shift * start
    core = start.T @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-12 * max(values.max(), 0)
    root = shifted @ (vectors[:, good] / np.sqrt(values[good]))
    left, sizes, _ = np.linalg.svd(root, full_matrices=False)
    sizes = np.sqrt(np.maximum(sizes ** 2 - shift, 0))
    keep = sizes[:rank] > 1e-9 * max(sizes.max(), 1e-300)
    return left[:, :rank][:, keep], sizes[:rank][keep]


def latent_spaces(docs: DataFrame, items: list[Item], vocabulary: dict[str, int], rank: int = RANK,
                  held: float = HELD) -> list[Space]:
    """The blocks of items, each with the projection of words to its latent space; one pass over the documents."""
    if len(vocabulary) * (rank + 8) * 8 > SPACE_BYTES:
        raise ValueError(f"the benchmark has too many distinct words ({len(vocabulary)}): search for it in parts")
    raw = np.random.default_rng(3).standard_normal((len(vocabulary), rank + 8))
    passages, halves, product = gathered(docs, vocabulary, raw)
    weight = np.log((passages + 1) / (halves + 1)) + 1e-3
    # counts N with weights D: A = N D; the start is raw / D, so A'A times it is D N'N raw
    vectors, sizes = singular(raw / weight[:, None], weight[:, None] * product, rank)
    pieces = [(n, at, x.words[at:at + 2 * HALF]) for n, x in enumerate(items)
              for at in range(0, max(len(x.words) - HALF, 1), HALF)]
    return [_space(block, vocabulary, weight, vectors * sizes, held) for block in itertools.batched(pieces, BLOCK)]


def _space(block: tuple[tuple[int, int, list[str]], ...], vocabulary: dict[str, int], weight: np.ndarray,
           scaled: np.ndarray, held: float) -> Space:
    """The decomposition of the documents' passages with those of a block of items as further rows, cut at a rank.

    Items of which less than `HELD_EACH` is left add what the cut has taken from them as directions of their own.
    """
    numbers = np.unique([vocabulary[w] for _, _, words in block for w in words])
    rows = np.zeros((len(block), len(numbers)))
    for n, (_, _, words) in enumerate(block):
        np.add.at(rows[n], np.searchsorted(numbers, [vocabulary[w] for w in words]), 1)
    rows *= weight[numbers]
    _, sizes, basis = np.linalg.svd(np.vstack([scaled[numbers].T, rows]), full_matrices=False)
    basis = basis[sizes > 1e-9 * max(sizes.max(), 1e-300)]
    shares = np.cumsum((rows @ basis.T) ** 2, axis=1) / (rows ** 2).sum(1)[:, None]
    rank = min(int(np.searchsorted(shares.mean(0), held - 1e-9)) + 1, len(basis))
    basis = basis[:rank]
    poor = shares[:, rank - 1] < min(HELD_EACH, held)
    if poor.any():
        left = rows[poor] - rows[poor] @ basis.T @ basis
        _, sizes, more = np.linalg.svd(left, full_matrices=False)
        basis = np.vstack([basis, more[sizes > 1e-9 * sizes.max()]])
    return Space(numbers, (weight[numbers][:, None] * basis.T).astype(np.float32), (rows @ basis.T).astype(np.float32),
                 np.array([n for n, _, _ in block]), np.array([at for _, at, _ in block]))


def _in_passes(spaces: list[Space]) -> list[list[Space]]:
    """As many spaces a pass as may be broadcast at once; an item is in one pass only."""
    passes: list[list[Space]] = []
    size = SPACE_BYTES
    for space in spaces:
        more = space.projection.nbytes + space.targets.nbytes
        if size + more > SPACE_BYTES and not (passes and space.begin[0]):
            passes.append([])
            size = 0
        passes[-1].append(space)
        size += more
    return passes


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, on bit vectors."""
    places: dict[str, int] = {}
    for n, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << n
    full = (1 << len(a)) - 1
    rest = full
    for w in b:
        hit = rest & places.get(w, 0)
        if hit:
            rest = ((rest + hit) | (rest - hit)) & full
    return len(a) - rest.bit_count()


def verify(item: Item, words: list[str], begin: int, at: int = 0) -> tuple[float, float, int, int] | None:
    """The best stretch for an item around the passage at `begin`: share of common order and of the answer.

    The passage is like the item's words from `at` on. Stretches are a quarter longer than the item. None if none of
    them is a leak.
    """
    n = len(item.words)
    length = n + max(n // 4, 2)
    step = max(n // 8, 1)
    begin -= at
    low = max(0, begin - min(length, 2 * HALF + n // 4))
    high = min(len(words), begin + 2 * HALF + length + (n // 4 if at else 0))
    best, around = None, set(words[low:high])
    if sum(w in around for w in item.words) < PARAPHRASE * n:
        return None
    for a in range(low, max(high - n, low) + 1, step):
        stretch = words[a:min(a + length, high)]
        share = common_words(item.words, stretch) / n
        if share < PARAPHRASE or best and share <= best[0]:
            continue
        answered = len(item.answer & set(stretch)) / max(len(item.answer), 1)
        if share >= SURE or answered >= ANSWER:
            best = (share, answered, a, min(a + length, high))
    return best


def _candidates(space: Space, projected: np.ndarray, cosine: float) -> Iterator[tuple[int, int, float]]:
    """Passage, target and cosine of the pairs to verify, the nearest of each few passages first."""
    norms = np.linalg.norm(space.targets, axis=1)
    goals = (space.targets / norms[:, None]).T
    for a in range(0, len(projected), 1024):
        part = projected[a:a + 1024]
        size = np.linalg.norm(part, axis=1)
        along = part @ goals
        rows, goal = np.nonzero((along >= np.minimum.outer(cosine * size, HOLDS * norms)) & (size > 0)[:, None])
        value = along[rows, goal] / size[rows]
        order = np.argsort(-value)
        yield from zip((rows[order] + a).tolist(), goal[order].tolist(), value[order].tolist())


def _search(docs: DataFrame, items: list[Item], vocabulary: dict[str, int], spaces: list[Space],
            item_type: T.DataType, cosine: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((items, vocabulary, spaces))
    schema = docs.drop("text").schema
    keep = list(schema.names)
    schema = schema.add("item", item_type)
    for name, of in [*dict.fromkeys(["cosine", "common", "answered"], "double").items(), ("first_word", "long"), ("last_word", "long")]:
        schema = schema.add(name, of)
    kind = to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("leaks")
        items, vocabulary, spaces = shared.value
        lookups = [np.full(len(vocabulary), -1, np.int32) for _ in spaces]
        for space, lookup in zip(spaces, lookups):
            lookup[space.numbers] = np.arange(len(space.numbers))
        for batch, texts in chunks(batches, "text"):
            words, ids, half, owner = _halves(texts, vocabulary)
            found: dict[tuple[int, int], tuple] = {}
            first = np.searchsorted(owner, np.arange(len(texts)))
            for space, lookup in zip(spaces, lookups) if len(ids) else ():
                own = lookup[ids]
                known = own >= 0
                projected = _passages(_sums(space.projection, own[known], half[known], len(owner)), owner)
                for row, goal, near in _candidates(space, projected, cosine):
                    text, n = int(owner[row]), int(space.item[goal])
                    before = found.get((text, n))
                    if before and before[1] >= SURE:
                        continue
                    hit = verify(items[n], words[text], (row - int(first[text])) * HALF, int(space.begin[goal]))
                    if hit and (before is None or hit[0] > before[1]):
                        found[text, n] = (near, *hit)
            if found:
                places = sorted(found)
                columns = list(zip(*(found[p] for p in places)))
                rows = pa.array([t for t, _ in places])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(rows) for c in keep],
                     pa.array([items[n].item for _, n in places]).cast(kind),
                     *[pa.array(c, pa.float64()) for c in columns[:3]],
                     *[pa.array(c, pa.int64()) for c in columns[3:]]], names=schema.names)

    return docs.mapInArrow(run, schema)


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id",
          item_text: str = "text", answer: str | None = None, cosine: float = COSINE,
          held: float = HELD) -> DataFrame:
    """One row per document and benchmark item found in it.

    Columns: the key, the item, `cosine` of the passage, `common` (share of the item's words that the text has in
    the same order), `answered` (share of the answer's words), and the words from `first_word` to before
    `last_word`. An item is found if `common` reaches SURE, or PARAPHRASE with the answer's words. Without an
    answer column the answer is the item's last sentence or last third. Null and empty texts and items are never
    found; rows without a key come back with a null key; a repeated row is found as often as it occurs. Other
    columns are not looked at. An empty table on either side gives an empty table.
    """
    texts = docs.select(F.col(f"`{key}`").alias("doc"), text_of(text).alias("text"))
    return _found(texts, benchmark, item, item_text, answer, cosine, held).withColumnsRenamed({"doc": key, "item": item})


def _found(texts: DataFrame, benchmark: DataFrame, item: str = "item_id", item_text: str = "text",
           answer: str | None = None, cosine: float = COSINE, held: float = HELD) -> DataFrame:
    """The items found in `text`, beside the other columns of `texts`; one pass for the space, one or more to search."""
    ship_package(texts.sparkSession)
    items = read_items(benchmark, item, item_text, answer)
    item_type = benchmark.schema[item].dataType
    vocabulary = {w: i for i, w in enumerate(sorted({w for x in items for w in x.words}))}
    spaces = latent_spaces(texts.select("text"), items, vocabulary, held=held) if items else []
    found = [_search(texts, items, vocabulary, some, item_type, cosine) for some in _in_passes(spaces) or [[]]]
    return functools.reduce(DataFrame.union, found)


def _identity(text: str, key: str) -> list[Column]:
    """What tells rows apart, also those without a key: 128 bits of key and text. Equal rows have it in common."""
    parts = F.col(f"`{key}`").isNull(), F.col(f"`{key}`"), text_of(text)
    return [F.xxhash64(F.lit(n), *parts).alias(f"__id{n}") for n in (1, 2)]


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents in which no benchmark item is found. Each row is judged by its own text, with or without a key."""
    found = settle(_found(docs.select(*_identity(text, key), text_of(text).alias("text")), benchmark)
                   .select("__id1", "__id2").distinct())
    marked = docs.select("*", *_identity(text, key))
    return drop_matching(marked, found, ["__id1", "__id2"], salt_by=["__id1"]).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return leaks(docs, table(spark, folder, "benchmark"))
