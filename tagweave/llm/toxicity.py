"""Toxicity scores: boosted trees over dense text features, calibrated by isotonic regression.

Features of a text: densities of a lexicon of words and word beginnings, how close lexicon words stand to a
second person, capitals, punctuation and symbols, and rates of obfuscated spelling. The lexicon (words and
beginnings that mark toxic texts of the fitting rows), the trees and the calibration are learnt from a bounded
sample of labelled rows; features and scores cover every text whole. No shuffle of texts: the sample of labels
is broadcast to the documents, its size is bounded by `training_rows`.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.common import chunks, enter, kept_fields, on_leave, table, text_of
from tagweave.session import settle, ship_package

#: Labelled rows that a model is fitted on, about; more are sampled by a hash of their key.
TRAINING_ROWS = 20_000
#: Entries of the lexicon at most.
LEXICON = 1_000
THRESHOLD = 0.7

# Pronouns of the second person in English, German, French and Spanish.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch",
                 "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted",
                 "ustedes", "vosotros", "vuestro")
# Signs that stand for letters in obfuscated words.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""}

WORD = re.compile(r"[^\W\d_]+")
SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
MIXED = re.compile(r"[^\W\d_]+(?:[0134579@$!*]+[^\W\d_]+)+")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
NEAR = 5
PREFIXES = range(4, 8)

FEATURES = ("log_words", "lexicon_rate", "lexicon_weight", "lexicon_best", "lexicon_hits", "lexicon_kinds",
            "second_rate", "near_rate", "near_weight", "capital_rate", "shouted_rate", "punctuation_rate",
            "exclamation_rate", "symbol_rate", "mixed_rate", "hidden_weight", "stretched_rate")
_PUNCTUATION = np.frombuffer(b".,;:!?'\"()-", np.uint8)
_SYMBOLS = np.frombuffer(b"#*$%&|<>@^~_=+", np.uint8)


def terms_of(text: str) -> set[str]:
    """Distinct words and word beginnings (marked by a star) of a text."""
    words = set(WORD.findall(text.lower()))
    found = {w for w in words if len(w) >= 3}
    for n in PREFIXES:
        found.update(w[:n] + "*" for w in words if len(w) > n)
    return found


class Lexicon:
    """Weights of words: of the word itself or else of its longest listed beginning."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self._seen: dict[str, float] = {}

    def __getitem__(self, word: str) -> float:
        known = self._seen.get(word)
        if known is None:
            known = self.weights.get(word)
            for n in reversed(PREFIXES):
                if known is None and len(word) > n:
                    known = self.weights.get(word[:n] + "*")
            known = known or 0.0
            if len(self._seen) > 150_000:
                self._seen.clear()
            self._seen[word] = known
        return known


def text_features(text: str, lexicon: Lexicon) -> tuple[float, ...]:
    """The values of FEATURES for one text; zeros for one without words."""
    lowered = text.lower()
    words = WORD.findall(lowered)
    n = max(len(words), 1)
    weights = [lexicon[w] for w in words]
    hits = [i for i, w in enumerate(weights) if w]
    second = [i for i, w in enumerate(words) if w in _SECOND]
    near = []
    if hits and second:
        places = np.array(second)
        at = np.searchsorted(places, hits)
        left = np.abs(places[np.clip(at - 1, 0, None)] - hits)
        right = np.abs(places[np.clip(at, None, len(places) - 1)] - hits)
        near = [i for i, d in zip(hits, np.minimum(left, right)) if d <= NEAR]
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    chars = max(int(counts.sum()), 1)
    mixed = MIXED.findall(lowered)
    hidden = sum(lexicon[m.translate(_UNMASK)] for m in mixed) if mixed else 0.0
    total = sum(weights)
    return (math.log1p(len(words)), 100 * len(hits) / n, 100 * total / n, max(weights, default=0.0),
            math.log1p(len(hits)), math.log1p(len({words[i] for i in hits})), 100 * len(second) / n,
            100 * len(near) / n, 100 * sum(weights[i] for i in near) / n, counts[65:91].sum() / chars,
            len(SHOUTED.findall(text)) / n, counts[_PUNCTUATION].sum() / chars, counts[33] / chars,
            counts[_SYMBOLS].sum() / chars, 100 * len(mixed) / n, hidden,
            100 * len(STRETCHED.findall(lowered)) / n)


_SECOND = frozenset(SECOND_PERSON)
_UNMASK = str.maketrans(LOOKALIKES)


@functools.lru_cache(maxsize=1)
def _lexicon(entries: tuple[tuple[str, float], ...]) -> Lexicon:
    return Lexicon(dict(entries))


on_leave("toxicity", _lexicon.cache_clear)


def features(df: DataFrame, lexicon: dict[str, float], text: str = "text",
             keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and one double per name of FEATURES; a null text counts as empty."""
    ship_package(df.sparkSession)
    entries = df.sparkSession.sparkContext.broadcast(tuple(sorted(lexicon.items())))
    schema = kept_fields(df, keep, *[T.StructField(f"__{n}", T.DoubleType(), False) for n in FEATURES])
    carried = schema.names[:len(schema) - len(FEATURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        known = _lexicon(entries.value)
        for batch, texts in chunks(batches, "__text", 500_000):
            values = np.array([text_features(t, known) for t in texts], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in carried] + [pa.array(values[:, i]) for i in range(len(FEATURES))],
                names=schema.names)

    return df.select(*[F.col(f"`{n}`") for n in carried], text_of(text).alias("__text")).mapInArrow(run, schema)


def learn_lexicon(labelled: DataFrame, text: str = "text", label: str = "__label", least: int = 5,
                  log_odds: float = 2.5, size: int = LEXICON) -> dict[str, float]:
    """Words and beginnings that mark texts with label 1, with the log of their odds ratio.

    A term counts once a text. It enters when at least `least` texts with label 1 hold it and its log odds
    reach `log_odds`; the `size` strongest are kept, and one that a listed beginning covers is left out.
    """
    ship_package(labelled.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        for batch, texts in chunks(batches, "__text"):
            tally = {0: Counter(), 1: Counter()}
            for value, words in zip(batch.column("__label").to_pylist(), map(terms_of, texts)):
                tally[value].update(words)
            terms = list(tally[0].keys() | tally[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *[pa.array([tally[v][t] for t in terms], pa.int64()) for v in (1, 0)]],
                names=["term", "ones", "zeros"])

    rows = labelled.select(text_of(text).alias("__text"), F.col(label).cast("int").alias("__label"))
    totals = rows.agg(F.count_if(F.col("__label") == 1), F.count_if(F.col("__label") == 0)).first()
    counted = (rows.mapInArrow(count, "term string, ones long, zeros long").groupBy("term")
               .agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")))
    weight = F.log((F.col("ones") + 0.5) / (totals[0] + 1)) - F.log((F.col("zeros") + 0.5) / (totals[1] + 1))
    best = (counted.filter(F.col("ones") >= least).withColumn("weight", weight)
            .filter(F.col("weight") >= log_odds).orderBy(F.desc("weight"), "term").limit(size).collect())
    chosen: dict[str, float] = {}
    for row in sorted(best, key=lambda r: (len(r.term), r.term)):
        covered = [chosen.get(row.term[:n] + "*") for n in PREFIXES if n < len(row.term.rstrip("*"))]
        if all(c is None or c < row.weight - 0.7 for c in covered):
            chosen[row.term] = float(row.weight)
    return chosen


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    rate: float


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"__{n}" for n in FEATURES], outputCol="__features").transform(df)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
        training_rows: int = TRAINING_ROWS) -> ToxicityModel:
    """Learn a model from the labelled rows; only the text and the label are used.

    Rows without a key or label are left out; several labels of one key count as their largest. About
    `training_rows` keys are taken, by a hash of the key; a quarter of them calibrates, the others make the
    lexicon and the trees. With labels of one kind only the model is the constant rate.
    """
    given = (labels.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{label}`").cast("int").alias("__label"))
             .filter("__key is not null and __label in (0, 1)").groupBy("__key").agg(F.max("__label").alias("__label")))
    share = training_rows / max(given.count(), 1)
    spot = F.pmod(F.xxhash64("__key", F.lit("fit")), F.lit(1 << 20))
    fold = F.pmod(F.xxhash64("__key", F.lit("fold")), F.lit(4))
    sample = given.filter(spot < int(share * (1 << 20)) + 1).withColumn("__fold", fold)
    rows = settle(docs.select(F.col(f"`{key}`").alias("__key"), text_of(text).alias("__text"))
                  .join(F.broadcast(sample), "__key").select("__text", "__label", "__fold"))
    fitting = rows.filter("__fold > 0")
    ones, total = fitting.agg(F.coalesce(F.sum("__label"), F.lit(0)), F.count(F.lit(1))).first()
    if not 0 < ones < total:
        return ToxicityModel({}, None, None, ones / total if total else 0.0)
    lexicon = learn_lexicon(fitting, "__text")
    points = settle(_vectors(features(rows, lexicon, "__text", ("__label", "__fold"))))
    trees = GBTClassifier(featuresCol="__features", labelCol="__label", maxIter=12, maxDepth=4, stepSize=0.3,
                          minInstancesPerNode=5, seed=7).fit(points.filter("__fold > 0"))
    margin = vector_to_array(F.col("probability")).getItem(1)
    held = trees.transform(points.filter("__fold = 0")).select(
        F.col("__label").cast("double").alias("label"), margin.alias("features"))
    calibration = IsotonicRegression().fit(held) if held.count() else None
    return ToxicityModel(lexicon, trees, calibration, ones / total)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: Sequence[str] = ("doc_id",),
          into: str = "score") -> DataFrame:
    """The columns `keep` and `into`, a double from 0 to 1, one row per row of `docs`.

    Null and empty texts get the score of a text without words. A column called like `into` gives way. The
    score is the calibrated one, with a thousandth of the trees' own so that equal steps keep their order.
    """
    carried = [k for k in keep if k.lower() != into.lower()]
    if model.trees is None:
        return docs.select(*[F.col(f"`{k}`") for k in carried], F.lit(model.rate).alias(into))
    renamed = docs.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(carried)],
                          text_of(text).alias("__text"))
    names = [f"__k{i}" for i in range(len(carried))]
    raw = model.trees.transform(_vectors(features(renamed, model.lexicon, "__text", names))).select(
        *names, vector_to_array(F.col("probability")).getItem(1).alias("features"))
    if model.calibration is None:
        value = F.col("features")
    else:
        raw = model.calibration.transform(raw)
        value = 0.999 * F.col("prediction") + 0.001 * F.col("features")
    return raw.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(carried)], value.alias(into))


def held_out(key: str = "doc_id") -> Column:
    """The third of all rows whose labels no model here may see."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 3 == 1, F.lit(False))


def fit_from_tables(spark: SparkSession, folder: str) -> ToxicityModel:
    labels = table(spark, folder, "labels").filter(~held_out())
    return fit(table(spark, folder, "documents"), labels)


def rejected(score_column: str = "score") -> Column:
    return F.col(score_column) >= THRESHOLD


def keep_clean(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Documents that the model does not reject, with their columns."""
    scored = score(docs, model, text, docs.columns, into="__toxicity")
    return scored.filter(~rejected("__toxicity")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score(docs, fit_from_tables(spark, folder))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         F.when(rejected(), 1).otherwise(0).alias("predicted"))
