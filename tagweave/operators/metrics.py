"""Per-label precision, recall and F1, weighted averages and word accuracy."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.operators.joins import explode_occurrences
from tagweave.operators.runs import MASK
from tagweave.operators.scan import BLOCK, _names, running
from tagweave.operators.tags import IGNORED, as_map

NO_NAME = "WTF"


def confusion_counts(df: DataFrame, y_true: str = "label", y_pred: str = "pred") -> DataFrame:
    """Rows per (label, pred) pair: the only pass over the data that the metrics need."""
    return df.groupBy(F.col(y_true).alias("label"), F.col(y_pred).alias("pred")).count()


#: What each scope counts of an occurrence: every token, those of words that training saw, and for words that it
#: never saw their first occurrence in each example.
SCOPES = {"all": "n", "seen": "if(seen, n, 0)", "unseen": "if(seen, 0, n_first)"}


def scoped_confusion(occurrences: DataFrame, scopes: Mapping[str, str] = SCOPES) -> DataFrame:
    """Confusion counts per scope, (scope, label, pred, count), from `joins.occurrence_counts`.

    `scopes` names counts as SQL over the columns `n`, `n_first` and `seen`. All scopes come from one pass over the tokens;
    a label without a prediction, or the other way round, is counted with a null. Pairs that a scope never counts
    give no row.
    """
    tokens = explode_occurrences(occurrences, keep=("n", "n_first", "seen"))
    pairs = tokens.groupBy("seen", "label", F.col("prediction").alias("pred")).agg(
        F.sum("n").alias("n"), F.sum("n_first").alias("n_first"))
    each = [F.struct(F.lit(name).alias("scope"), F.expr(count).cast("long").alias("count")) for name, count in scopes.items()]
    return pairs.select("label", "pred", F.inline(F.array(*each))).filter("count > 0").groupBy(
        "scope", "label", "pred").agg(F.sum("count").alias("count"))


def labels_of_scopes(labels: DataFrame, scopes: Iterable[str] = SCOPES) -> DataFrame:
    """Every label once per scope, as `prf_per_label(..., by="scope")` takes them."""
    return labels.withColumn("scope", F.explode(F.array(*[F.lit(name) for name in scopes])))


def _label_totals(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    n, none = F.col("count"), F.lit(0).cast("long")
    hits = F.when(F.col("label").eqNullSafe(F.col("pred")), n).otherwise(none)
    roles = F.array(F.struct(F.col("label"), n.alias("support"), none.alias("predicted"), hits.alias("tp")),
                    F.struct(F.col("pred").alias("label"), none.alias("support"), n.alias("predicted"), none.alias("tp")))
    # both roles of a row in one pass
    return confusion.select(*by, F.inline(roles)).groupBy(*by, "label").agg(
        F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support"))


def _ratio(top: Column, bottom: Column, zero_division: float) -> Column:
    return F.when(bottom == 0, F.lit(float(zero_division))).otherwise(top / bottom)


def prf_per_label(confusion: DataFrame, labels: DataFrame | None = None, zero_division: float = 0.0,
                  swap: bool = False, by: str | Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every label, within each group of the columns `by`.

    `labels` (one column) lists the labels to report, also those that never occur; by default those
    seen in either role. With `by` it has those columns after the label. `swap` takes the predictions as the truth, as two of the reports compared
    here do.
    """
    by = _names(by)
    totals = _label_totals(confusion, by)
    if swap:
        totals = totals.select(*by, "label", "tp", F.col("support").alias("predicted"),
                               F.col("predicted").alias("support"))
    if labels is not None:
        wanted = labels.select(F.col(labels.columns[0]).alias("label"), *by).distinct()
        totals = wanted.join(totals, ["label", *by], "left").fillna(0, ["tp", "predicted", "support"])
    tp, predicted, support = (F.col(c) for c in ("tp", "predicted", "support"))
    return totals.select(
        *by, "label",
        _ratio(tp, predicted, zero_division).alias("precision"),
        _ratio(tp, support, zero_division).alias("recall"),
        _ratio(2 * tp, predicted + support, zero_division).alias("f1"),
        support.cast("long").alias("support"))


def label_range(label_ids: DataFrame, column: str = "label_id") -> DataFrame:
    """All ids from max(0, smallest) to the largest, as column `label`."""
    low, high = label_ids.agg(F.min(column), F.max(column)).first()
    return label_ids.sparkSession.range(max(0, low), high + 1).select(F.col("id").cast("int").alias("label"))


def prf_weighted(confusion: DataFrame, swap: bool = False, zero_division: float = 0.0) -> DataFrame:
    """Support-weighted averages over all labels that occur."""
    rows = prf_per_label(confusion, zero_division=zero_division, swap=swap)
    total = F.sum("support")
    return rows.agg(*[(F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in ("precision", "recall", "f1")],
                    total.alias("support"))


def metrics_report(per_label: DataFrame, names: DataFrame | Mapping[int, str], mask: str = MASK,
                   by: str | Sequence[str] = ()) -> DataFrame:
    """Named metrics with the share of support, within each group of the columns `by`.

    The mask row's share is of all rows, every other row's of the rows that are not mask. Labels
    without a name show as `NO_NAME`.
    """
    by = _names(by)
    named = as_map(per_label, names, "label_id", "label", "label_id int, label string").select(
        F.col("label_id").alias("__id"), F.col("label").alias("tag"))
    rows = per_label.join(named, F.col("label") == F.col("__id"), "left").select(
        *by, F.col("label").alias("label_id"), F.coalesce("tag", F.lit(NO_NAME)).alias("tag"),
        "precision", "recall", "f1", "support")
    is_mask = F.col("tag") == mask
    every = Window.partitionBy(*by)  # one row per label
    rest = F.coalesce(F.sum(F.when(~is_mask, F.col("support"))).over(every), F.lit(0))
    base = F.when(is_mask, F.sum("support").over(every)).otherwise(rest)
    share = F.when(base > 0, F.col("support") / base)
    return rows.select(*by, "label_id", "tag", "precision", "recall", "f1", "support",
                        share.alias("support_share"), is_mask.alias("is_mask"))


def sorted_report(report: DataFrame) -> DataFrame:
    """Largest support first."""
    return report.orderBy(F.col("support").desc(), "label_id")


def report_totals(report: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Weighted averages over the rows that are not mask, one row per group of the columns `by`."""
    rest = report.filter(~F.col("is_mask"))
    return rest.groupBy(*_names(by)).agg(*[F.sum(F.col(m) * F.col("support_share")).alias(m) for m in ("precision", "recall", "f1")])


def word_accuracy(df: DataFrame, mask, part: str = "example_id", order: str | Sequence[str] = "pos", label: str = "label",
                  pred: str = "pred", faithful: bool = False, block: int = BLOCK) -> DataFrame:
    """Share of words all of whose positions agree; a word starts at a non-mask label.

    Mask positions before the first word of a sequence are left out. `faithful` leaves out the last
    word of the last sequence, which a loop that scores a word on meeting the next one never counts.
    """
    starts = (F.col(label) != F.lit(mask)).cast("int")
    rows = running(df, part, order, sums={"__word": starts}, inclusive=True, block=block)
    words = rows.filter(F.col("__word") > 0).groupBy(part, "__word").agg(
        F.bool_and(F.col(label) == F.col(pred)).alias("__right"))
    right = F.count_if("__right")
    total = F.count(F.lit(1))
    if faithful:
        last = F.max_by("__right", F.struct(part, "__word"))
        right, total = right - last.cast("int"), total - 1
    return words.agg(right.cast("long").alias("correct"), total.cast("long").alias("words")).withColumn(
        "accuracy", F.when(F.col("words") > 0, F.col("correct") / F.col("words")))


def ffill_labels(df: DataFrame, mask, part: str = "example_id", order: str | Sequence[str] = "pos", label: str = "label",
                 pad: int = IGNORED, block: int = BLOCK) -> DataFrame:
    """Carry the last label that is not `mask` forward inside its sequence; gaps at the start get `pad`."""
    real = F.when(F.col(label) != F.lit(mask), F.col(label))
    filled = running(df, part, order, lasts={"__filled": real}, inclusive=True, block=block)
    padding = F.lit(pad).cast(df.schema[label].dataType)
    return filled.withColumn(label, F.coalesce("__filled", padding)).drop("__filled")
