"""Quality rules whose cutoffs come with a guarantee on false rejection.

Every document is measured whole. For each stratum the cutoffs of all rules stand in one sequence; after each step an
exact binomial test asks whether all rules together, as they then are, reject at most a share `RISK` of the labelled
good documents. The order of the steps hangs on the bad documents alone, so a sequence needs no correction up to its
first failure; a rule that fails stays as it was and the others go on, at a level that pays for all places where the
failures may have been. The level is shared out over the strata (Bonferroni). With too few good labels (see
`labels_needed`) a stratum has no rules. All counts are over all labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.common import chunks, enter, kept_fields, table, text_of
from tagweave.operators.joins import attach
from tagweave.session import settle, ship_package

#: Share of a stratum's good documents that all rules together may reject, and the chance to be wrong about any stratum.
RISK, LEVEL = 0.02, 0.05
WINDOW = 5
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)

#: Cutoffs of each rule from lenient to strict; a document above one is rejected by it.
CUTOFFS = {
    "symbol_rate": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "repeat_share": (0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05),
    "capital_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25),
    "word_length": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0),
    "same_word_share": (0.99, 0.97, 0.95, 0.92, 0.9, 0.85, 0.8),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "__lines", "__capitals", "__letters",
          "__distinct")


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that stand in a window of `window` words which occurs twice or more in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    code, kinds = ids[:n], len(index)
    for k in range(1, window):
        if kinds * len(index) >= 1 << 62:  # number the beginnings anew before they overflow
            unique, code = np.unique(code, return_inverse=True)
            kinds = len(unique)
        code = code * len(index) + ids[k:n + k]
        kinds *= len(index)
    _, places, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = counts[places] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k:n + k] |= twice
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    letters = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    capitals = int(letters[65:91].sum())
    return (len(words), sum(map(len, words)), int(letters[_SYMBOLS].sum()), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), capitals, capitals + int(letters[97:123].sum()), len(set(words)))


def measured(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and the counts of each whole text; a null text counts as empty."""
    ship_package(docs.sparkSession)
    schema = kept_fields(docs, keep, *[T.StructField(n, T.LongType(), False) for n in COUNTS])
    carried = schema.names[:len(schema) - len(COUNTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        for batch, texts in chunks(batches, "__text"):
            values = np.array([measure(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in carried] + [pa.array(values[:, i]) for i in range(len(COUNTS))],
                names=schema.names)

    return docs.select(*[F.col(f"`{n}`") for n in carried], text_of(text).alias("__text")).mapInArrow(run, schema)


def _ratio(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def rule_values() -> dict[str, Column]:
    return {
        "symbol_rate": _ratio("n_symbols", "n_words"), "dup_line_share": _ratio("n_dup_lines", "__lines"),
        "repeat_share": _ratio("n_repeat_words", "n_words"), "capital_share": _ratio("__capitals", "__letters"),
        "word_length": _ratio("word_chars", "n_words"),
        "same_word_share": _ratio(F.col("n_words") - F.col("__distinct"), "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def at_most(k: int, n: int, rate: float) -> float:
    """The chance that a binomial of n draws at `rate` gives k or fewer, for k up to its mean."""
    if k > n * rate:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                    + k * math.log(rate) + (n - k) * math.log1p(-rate))
    total, i = 0.0, k
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i / (n - i + 1) * (1 - rate) / rate
        i -= 1
    return min(total, 1.0)


def last_safe(rejected: Sequence[int], n: int, risk: float, level: float) -> int:
    """How many cutoffs, from the most lenient on, pass the test one after the other."""
    for turn, k in enumerate(rejected):
        if at_most(int(k), n, risk) > level:
            return turn
    return len(rejected)


def level_after(failures: int, level: float) -> float:
    """The level of a test after so many failures: halves, shared by all sequences that their places allow."""
    steps = sum(map(len, CUTOFFS.values()))
    return level / 2 ** (failures + 1) / steps ** failures


def labels_needed(strata: int, risk: float = RISK, level: float = LEVEL) -> int:
    """Good labelled documents from which on a stratum can have a rule, one that rejects none of them."""
    return math.ceil(math.log(level_after(0, level / max(strata, 1))) / math.log1p(-risk))


def _next_rule(force: np.ndarray, first: np.ndarray, bad: np.ndarray, open_rules: list[int]) -> int:
    """The rule to tighten next: of most bad documents gained per step, else the most lenient one."""
    left = ~(first < force).any(1) & (bad > 0)
    best, choice = 0.0, None
    for r in open_rules:
        size = len(tuple(CUTOFFS.values())[r])
        gained = np.bincount(first[left, r], bad[left], size + 1)[force[r]:size].cumsum()
        rate = (gained / np.arange(1, len(gained) + 1)).max()
        if rate > best:
            best, choice = rate, r
    if choice is None:
        choice = min(open_rules, key=lambda r: force[r] / len(tuple(CUTOFFS.values())[r]))
    return choice


def safe_cutoffs(first: np.ndarray, good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> np.ndarray:
    """How many cutoffs of each rule are in force at the end of the sequence.

    A row of `first` says for each rule which cutoff is the first to reject; `good` and `bad` count the documents.
    """
    sizes = np.array([len(c) for c in CUTOFFS.values()])
    force, failed, n = np.zeros(len(sizes), np.int64), set(), int(good.sum())
    while open_rules := [r for r in range(len(sizes)) if r not in failed and force[r] < sizes[r]]:
        rule = _next_rule(force, first, bad, open_rules)
        tighter = force.copy()
        tighter[rule] += 1
        rejected = int(good[(first < tighter).any(1)].sum())
        if at_most(rejected, n, risk) <= level_after(len(failed), level):
            force = tighter
        else:
            failed.add(rule)
    return force


def cutoffs(holdout: DataFrame, stratum: str = "__stratum", good: str = "__good", risk: float = RISK,
            level: float = LEVEL) -> DataFrame:
    """One row per stratum: a cutoff for each rule, null where none is safe, and `__n_good`, the documents it rests on.

    `holdout` holds the rules' values of labelled documents; those with `good` = 0 only order the steps.
    """
    steps = [sum((F.col(rule) <= cut).cast("int") for cut in cuts).alias(f"__{rule}") for rule, cuts in CUTOFFS.items()]
    counted = settle(holdout.filter(F.col(good).isNotNull()).select(stratum, (F.col(good) == 1).alias("__is"), *steps)
                     .groupBy(stratum, *[f"__{rule}" for rule in CUTOFFS])
                     .agg(F.count_if("__is").alias("__n"), F.count_if(~F.col("__is")).alias("__bad")))
    share = level / max(counted.filter("__n > 0").select(stratum).distinct().count(), 1)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([f"__{rule}" for rule in CUTOFFS])
        force = safe_cutoffs(frame[[f"__{rule}" for rule in CUTOFFS]].to_numpy(np.int64), frame["__n"].to_numpy(np.int64),
                             frame["__bad"].to_numpy(np.int64), risk, share)
        out = {stratum: frame[stratum].iloc[:1].to_list(), "__n_good": [int(frame["__n"].sum())]}
        out |= {f"{rule}__cut": [cuts[k - 1] if k else None] for (rule, cuts), k in zip(CUTOFFS.items(), force)}
        return pd.DataFrame(out).astype({f"{r}__cut": float for r in CUTOFFS})

    schema = f"{stratum} string, __n_good long, " + ", ".join(f"{rule}__cut double" for rule in CUTOFFS)
    chosen = counted.groupBy(stratum).applyInPandas(choose, schema)
    return chosen.select(stratum, "__n_good", *[
        F.when(~F.isnan(c), F.col(c)).alias(c) for c in chosen.columns[2:]])


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang",
          label: str = "quality", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per row of `docs`: the key, its counts, `base_failed`, `kept` and the names of the `failed` rules.

    A null text counts as empty, a null stratum as a stratum of its own. Labels without key or value are left out;
    a key with several labels is good only if all are. A document that `docs` repeats is measured each time and
    counts as often in the holdout. With too few good labels a stratum has no rules but the base. Other columns
    are not looked at. An empty table gives an empty table.
    """
    source = docs.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit(""))
                         .alias("__stratum"), text_of(text).alias("__words"))
    counts = settle(measured(source, "__words", ("__key", "__stratum")))
    values = counts.select("*", *[v.alias(n) for n, v in rule_values().items()])
    given = (labels.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{label}`").cast("int").alias("__good"))
             .dropna().groupBy("__key").agg(F.min("__good").alias("__good")))
    # documents that the base rejects anyway tell nothing about the rules
    chosen = cutoffs(values.filter(~base_failed()).join(given, "__key"), risk=risk, level=level)
    judged = attach(values, chosen, ["__stratum"], settled=True, salt_by=["__key"])
    failed = F.array_compact(F.array(*[
        F.when(F.col(rule) > F.col(f"{rule}__cut"), F.lit(rule)) for rule in CUTOFFS]))
    return judged.select(F.col("__key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", base_failed().alias("base_failed"),
                         (~base_failed() & (F.size(failed) == 0)).alias("kept"),
                         F.array_join(failed, ",").alias("failed"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
