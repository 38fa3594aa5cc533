"""Documents whose sets of word 5-grams reach a Jaccard similarity, with Bayesian pruning of candidates.

Texts with equal sets are one class from the start. Classes meet in buckets of a few MinHash values each. Two
classes of a bucket have their MinHash values compared step by step; a pair is dropped as soon as the posterior
probability that its similarity reaches the threshold (flat prior, binomial matches) is below a tolerance. What is
left is verified on the whole sets. A bucket of very many classes is cut into pairs of parts, and each pair of
classes is looked at only in the first bucket they share, so links are counted once. Parts put out one row per
class (its links and one neighbour), never one per pair.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import chunks, enter, groups, table, text_of, together
from tagweave.llm.components import connected
from tagweave.llm.shingles import set_digest, shingle_set, signatures
from tagweave.operators.joins import SALT, attach, drop_matching, keep_matching
from tagweave.session import settle, ship_package

THRESHOLD = 0.8
#: MinHash values of a signature, and how many of them make one bucket.
HASHES, ROWS = 64, 3
#: MinHash values compared before the posterior is looked at again.
STEP = 16
#: Posterior probability below which a pair is dropped.
TOLERANCE = 1e-7
#: Classes of one part of a bucket, and shingles of all their sets.
PART, PART_SHINGLES = 1024, 4_000_000


@functools.cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES,
                  step: int = STEP) -> tuple[int, ...]:
    """After each step, the fewest matches with which a pair goes on.

    With m matches of n and a flat prior the similarity has a Beta(m + 1, n - m + 1) posterior; its mass above the
    threshold is the chance that a binomial of n + 1 draws gives m or fewer.
    """
    out = []
    for n in range(step, hashes + 1, step):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def signed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """`doc`, `cls` and `check` (hashes of the shingle set), `sig` (MinHash values), `size` (shingles) of each row.

    The last four are null for texts without words and rows without a key.
    """
    schema = docs.select(F.col(f"`{key}`").alias("doc")).schema
    for name, kind in (("cls", "long"), ("check", "long"), ("sig", "binary"), ("size", "long")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("shingles")
        for batch, texts in chunks(batches, "text"):
            keyed = batch.column("doc").is_valid().to_pylist()
            sets = [shingle_set(t) if k else None for t, k in zip(texts, keyed)]
            full = [s for s in sets if s is not None and len(s)]
            signs = iter([row.tobytes() for row in signatures(full, HASHES)] if full else [])
            rows = [(*set_digest(s), next(signs), len(s)) if s is not None and len(s) else (None,) * 4 for s in sets]
            cls, check, sig, size = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(cls, pa.int64()), pa.array(check, pa.int64()),
                 pa.array(sig, pa.binary()), pa.array(size, pa.int64())], names=schema.names)

    return docs.select(F.col(f"`{key}`").alias("doc"), text_of(text).alias("text")).mapInArrow(run, schema)


def buckets(classes: DataFrame) -> DataFrame:
    """`bucket`, `band`, `cls`, `parts`: the buckets that two classes or more fall into."""
    width = 2 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 1 + width * b, width)) for b in range(HASHES // ROWS)])
    keyed = classes.select("cls", "size", F.posexplode(bands).alias("band", "bucket"))
    held = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("size"))
    parts = F.ceil(F.greatest(F.col("count") / PART, F.col("size") / PART_SHINGLES)).cast("int")
    shared = settle(held.filter("count > 1").select("bucket", parts.alias("parts")))
    # the rows of a large bucket meet its number of parts in many tasks
    large = attach(keyed.drop("size"), shared.filter("parts > 1"), ["bucket"], salt_by=["cls"])
    turn = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("cls"), F.lit(SALT))).otherwise(0).cast("int")
    turns = F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    return (large.withColumn("turn", turn).drop("parts")
            .join(shared.withColumn("turn", F.explode(turns)), ["bucket", "turn"]).drop("turn"))


def dealt(rows: DataFrame) -> DataFrame:
    """Each class of a bucket goes to every pair of parts that its own part stands in."""
    own = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return paired.select("bucket", "band", "cls", "own", F.least("own", "other").alias("i"),
                         F.greatest("own", "other").alias("j"))


def _pairs(sig: np.ndarray, own: np.ndarray, cross: bool, band: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that outlive the pruning and share no earlier bucket."""
    n, least = len(sig), least_matches()
    for a in range(0, n - 1, 64):
        matches = np.zeros((min(64, n - a), n), np.int16)
        for k in range(STEP):
            matches += sig[a:a + 64, k, None] == sig[None, :, k]
        alive = (matches >= least[0]) & (np.arange(a, min(a + 64, n))[:, None] < np.arange(n)[None, :])
        if cross:
            alive &= own[a:a + 64, None] != own[None, :]
        x, y = np.nonzero(alive)
        count = matches[x, y]
        x += a
        for turn, need in enumerate(least[1:], 1):
            if not len(x):
                break
            values = slice(turn * STEP, (turn + 1) * STEP)
            count = count + (sig[x, values] == sig[y, values]).sum(1)
            stay = count >= need
            x, y, count = x[stay], y[stay], count[stay]
        if len(x) and band:
            earlier = (sig[x, :ROWS * band] == sig[y, :ROWS * band]).reshape(len(x), band, ROWS).all(2).any(1)
            x, y = x[~earlier], y[~earlier]
        if len(x):
            yield x, y


def pruned(placed: DataFrame) -> DataFrame:
    """`bucket`, `band`, `i`, `j`, `cls`: the classes of each part that have a candidate left in it."""
    names = ["bucket", "i", "j"]
    kept = ["bucket", "band", "i", "j", "own", "cls"]
    sorted_rows = placed.repartition(*[F.col(n) for n in names]).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("shingles")
        out, held = [], 0
        for rows in groups(batches, names):
            if len(rows["cls"]) < 2:
                continue
            sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, HASHES)
            i, j, band = (int(rows[c][0]) for c in ("i", "j", "band"))
            active = np.zeros(len(sig), bool)
            for x, y in _pairs(sig, rows["own"], i != j, band):
                active[x] = active[y] = True
            if active.any():
                out.append([rows[c][active] for c in kept])
                held += len(out[-1][0])
            if held > 20_000:
                yield together(out, kept)
                out, held = [], 0
        if out:
            yield together(out, kept)

    return sorted_rows.mapInArrow(run, "bucket long, band int, i int, j int, own int, cls long")


def _shared(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs of sets."""
    if len(x) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x, y)], np.int64)
    values, places = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = np.flatnonzero(np.bincount(places) > 1)
    column = np.full(len(values), -1)
    column[common] = np.arange(len(common))
    column = column[places]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, len(common), 4096):
        inside = (column >= a) & (column < a + 4096)
        held = np.zeros((len(sets), min(4096, len(common) - a)), np.float32)
        held[owner[inside], column[inside] - a] = 1
        total += held @ held.T
    return total[x, y].astype(np.int64)


def verified(placed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`cls`, `links`, `peer`: per part, the documents each class links to there and one class it is joined to."""
    names = ["bucket", "i", "j"]
    sorted_rows = placed.repartition(*[F.col(n) for n in names]).sortWithinPartitions(*names, "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("shingles")
        out, held = [], 0
        for rows in groups(batches, names):
            cls = rows["cls"]
            once = np.append(True, cls[1:] != cls[:-1])  # repeated documents come more than once
            rows = {c: values[once] for c, values in rows.items()}
            cls, n = rows["cls"], int(once.sum())
            if n < 2:
                continue
            sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, HASHES)
            sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
            sizes, weight = np.array([len(s) for s in sets]), rows["n"]
            i, j, band = (int(rows[c][0]) for c in ("i", "j", "band"))
            links, root = np.zeros(n, np.int64), np.arange(n)
            for x, y in _pairs(sig, rows["own"], i != j, band):
                both = _shared(sets, x, y)
                same = both >= threshold * (sizes[x] + sizes[y] - both) - 1e-9
                x, y = x[same], y[same]
                np.add.at(links, x, weight[y])
                np.add.at(links, y, weight[x])
                for a, b in zip(x.tolist(), y.tolist()):
                    if root[a] != root[b]:
                        low, high = sorted((root[a], root[b]))
                        root[root == high] = low
            found = np.flatnonzero(links)
            if len(found):
                out.append([cls[found], links[found], cls[root[found]]])
                held += len(found)
            if held > 20_000:
                yield together(out, ["cls", "links", "peer"])
                out, held = [], 0
        if out:
            yield together(out, ["cls", "links", "peer"])

    return sorted_rows.mapInArrow(run, "cls long, links long, peer long")


def _sets(docs: DataFrame, text: str) -> DataFrame:
    """`cls` and `shingles` (the whole set) of the given documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("shingles")
        for _, texts in chunks(batches, "text"):
            sets = [s for s in map(shingle_set, texts) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_digest(s)[0] for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "shingles"])

    return docs.select(text_of(text).alias("text")).mapInArrow(run, "cls long, shingles binary")


def jaccard_classes(docs: DataFrame, text: str = "text", key: str = "doc_id",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: the key, `class_id`, `n_links`, `text_id`.

    Two documents link when the Jaccard similarity of their sets of five-word shingles (lower-case words of
    letters and digits; a shorter text is one shingle) reaches `threshold`. `class_id` is the least key of the
    connected group, `text_id` the least key among documents with an equal set, `n_links` the number of other
    documents it links to, copies included. Null and empty texts, texts without words and rows without a key
    come back with a null class and no links. A row that repeats a key and text counts as a copy. Other columns
    are not looked at. An empty table gives an empty table. Buckets and pruning are set for `THRESHOLD`; a lower
    `threshold` would lose pairs and is refused.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"threshold {threshold} is below {THRESHOLD}, for which buckets and pruning are set")
    ship_package(docs.sparkSession)
    everything = settle(signed(docs, text, key))
    placed = everything.filter(F.col("cls").isNotNull())
    classes = settle(placed.groupBy("cls").agg(
        F.min("doc").alias("text_id"), F.count(F.lit(1)).alias("n"), F.max("sig").alias("sig"),
        F.max("size").alias("size"), F.min("check").alias("low"), F.max("check").alias("high"))
        .filter("low = high").drop("low", "high"))
    active = settle(pruned(dealt(buckets(classes.select("cls", "sig", "size"))).join(classes.select("cls", "sig"), "cls")))
    wanted = active.select("cls").distinct().join(classes, "cls")
    sets = _sets(keep_matching(docs.select(F.col(f"`{key}`").alias("doc"), text_of(text).alias("text")),
                               settle(wanted.select(F.col("text_id").alias("doc")).distinct()), ["doc"],
                               salt_by=["doc"]), "text")
    found = settle(verified(active.join(classes.select("cls", "sig", "n"), "cls").join(sets, "cls"), threshold))
    roots = connected(found.select(F.col("cls").alias("a"), F.col("peer").alias("b")))
    named = classes.drop("sig").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "root", F.coalesce("root", "cls"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = named.groupBy("root").agg(F.min("text_id").alias("class_id"))
    done = settle(named.join(links, "cls", "left").join(groups, "root").select(
        "cls", "class_id", "text_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    described = placed.select("doc", "cls").join(done, "cls", "left").select(
        F.col("doc").alias(key), F.coalesce("class_id", "doc").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("text_id", "doc").alias("text_id"))
    bare = everything.filter(F.col("cls").isNull()).select(
        F.col("doc").alias(key), F.lit(None).cast(described.schema["class_id"].dataType).alias("class_id"),
        F.lit(0).cast("long").alias("n_links"), F.lit(None).cast(described.schema["text_id"].dataType).alias("text_id"))
    return described.union(bare)


def op3_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard_classes(docs)


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each group of texts that link, directly or through others: the one with the least key.

    Each row is judged by its key and text together: rows that repeat a key are compared like others, rows without
    key come after all keys, and of rows equal in key and text one stays. Documents without words stay.
    """
    name = F.struct(F.col(f"`{key}`").isNull().alias("bare"), F.col(f"`{key}`").alias("key"),
                    F.xxhash64(text_of(text)).alias("body")).alias("__row")
    rows = docs.select("*", name)
    classes = settle(jaccard_classes(docs.select(name, F.col(f"`{text}`").alias("text")), "text", "__row"))
    repeated = settle(classes.filter(F.col("class_id") < F.col("__row")).select("__row").distinct())
    equal = settle(classes.filter(F.col("class_id") == F.col("__row")).groupBy("__row").count().filter("count > 1")
                   .select("__row"))
    kept = drop_matching(rows, repeated, ["__row"], salt_by=["__row"])
    if not equal.isEmpty():
        one = keep_matching(kept, equal, ["__row"], salt_by=["__row"]).dropDuplicates(["__row"])
        kept = drop_matching(kept, equal, ["__row"], salt_by=["__row"]).unionByName(one)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
