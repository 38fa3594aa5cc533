"""Running aggregates over long ordered groups.

A group (one document, one sequence) may hold a large part of all rows, so no window here is
partitioned by the group alone. Rows are cut into blocks of consecutive order keys; a window runs
inside each block, and what the blocks pass on (totals, last values) is computed on a table with one
row per block. The join that brings it back uses the window's own partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.session import PARTITIONS_CONF, settle

BLOCK = 1 << 16
#: Rows that are sampled for each block of `ranged`.
_SAMPLED = 64
#: The block of a row; it stays on rows that `ranged` has cut, for every scan that follows.
_BLK = "__blk"


def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def ranged(df: DataFrame, part: str | Sequence[str], order: str | Sequence[str], blocks: int | None = None,
           stored: bool = True) -> DataFrame:
    """Rows cut into blocks by ranges of `part` and all `order` columns, as a stored table with the block of each row.

    For orders whose first column does not cut evenly or is no whole number, such as (line, item) with lines of any
    length: blocks hold about the same number of rows each, as many as there are shuffle partitions (fewer where the
    planner joins small ones) or `blocks`. One range shuffle, kept for all scans over the result; they move rows by
    block again for their windows. Rows equal in all these columns share a block. `part` may be empty: one order for
    all rows. The column `__blk` is part of the result and of what row-wise scans make of it.

    With `stored=False` the bounds of the blocks are taken from a sample, for which the rows are read twice, and the block is a
    column found by its bounds: no row is stored or moved, and rows that lie together by `part` stay where they are.
    """
    if not stored:
        return _placed(df, [*_names(part), *_names(order)], blocks or int(df.sparkSession.conf.get(PARTITIONS_CONF)))
    columns = [F.col(c) for c in (*_names(part), *_names(order))]
    spread = df.repartitionByRange(*columns) if blocks is None else df.repartitionByRange(blocks, *columns)
    return settle(spread.withColumn(_BLK, F.spark_partition_id().cast("long")))


def _placed(df: DataFrame, columns: Sequence[str], blocks: int) -> DataFrame:
    """Rows with the block they fall in, by bounds from a sample of `_SAMPLED` rows a block."""
    keys = df.select(*columns)
    sample = keys.sample(min(1.0, _SAMPLED * blocks / max(keys.count(), 1)), 7).orderBy(*columns).collect()
    bounds = list(dict.fromkeys(sample[len(sample) * n // blocks] for n in range(1, blocks))) if sample else []
    types = [keys.schema[c].dataType for c in columns]
    ends = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(row, types, columns)]) for row in bounds])
    found = df.withColumn(_BLK, F.lit(0))
    step = 1 << len(bounds).bit_length() >> 1
    while step:  # as many bounds as are not beyond the row, by halves; past the last bound there is null
        reached = F.get(ends, F.col(_BLK) + (step - 1)) <= F.struct(*columns)
        found = found.withColumn(_BLK, F.col(_BLK) + F.when(reached, step).otherwise(0))
        step >>= 1
    return found.withColumn(_BLK, F.col(_BLK).cast("long"))


def deal_by_cost(df: DataFrame, cost: Column, order: str | Sequence[str], tasks: int) -> DataFrame:
    """The rows in `tasks` partitions of about the same summed cost each, by ranges of the running cost.

    A partition gets the rows whose running cost begins in its share, so it exceeds the mean by less than its last
    row costs. `order` tells the rows apart; a null or negative cost counts as 0. For work whose time follows a
    size, such as a model over tokens, where equal numbers of rows would leave one task with the long ones.
    """
    cut = ranged(df.withColumn("__cost", F.greatest(F.coalesce(cost.cast("long"), F.lit(0)), F.lit(0))), (), order)
    placed = running(cut, (), order, sums={"__from": F.col("__cost")}, totals=True)
    share = F.floor(F.col("__from") / F.nullif("__from_total", F.lit(0)) * tasks)
    task = F.least(F.coalesce(share, F.lit(0)), F.lit(tasks - 1)).cast("int")
    return placed.repartitionById(tasks, task).drop("__cost", "__from", "__from_total", _BLK)


def running(df: DataFrame, part: str | Sequence[str], order: str | Sequence[str],
            sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None,
            inclusive: bool = False, totals: bool = False, block: int | None = BLOCK) -> DataFrame:
    """Add running sums and latest non-null values, in `order` inside each `part` group.

    Both look at the rows before the current one, or up to and including it with `inclusive`.
    `totals` also adds `<name>_total`, the sum over the whole group. Blocks are those of `ranged`, if `df` comes from
    there; else they are ranges of the first order column, which must then be a non-negative whole number of which
    few rows share a value. Group keys must not be null. Sums are taken as long.

    With blocks the input is read twice. `block=None` reads it once, in one window over the whole group: for groups that
    are cut from one row each and so lie in one part anyway, such as the words of a document's text. A group's rows then
    pass through one task, which holds a few of them and spills the rest.
    """
    part, order = _names(part), _names(order)
    keys = [*part, _BLK]
    summed = {n: F.coalesce(v.cast("long"), F.lit(0)) for n, v in (sums or {}).items()}
    latest = dict(lasts or {})
    if block is None and _BLK not in df.columns:
        whole = Window.partitionBy(*part).orderBy(*order)
        upto = whole.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        named = {n: F.coalesce(F.sum(v).over(upto), F.lit(0)) for n, v in summed.items()}
        named |= {f"{n}_total": F.sum(v).over(every) for n, v in summed.items() if totals}
        named |= {n: F.last(v, ignorenulls=True).over(upto) for n, v in latest.items()}
        added = [c for n in summed for c in ([n, f"{n}_total"] if totals else [n])] + list(latest)
        return df.select(*[c for c in df.columns if c not in added], *[named[c].alias(c) for c in added])
    keyed = df if _BLK in df.columns else df.withColumn(_BLK, F.expr(f"`{order[0]}` div {int(block)}"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = Window.partitionBy(*part).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)

    local = keyed.select(
        "*",
        *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__l_{n}") for n, v in summed.items()],
        *[F.last(v, ignorenulls=True).over(inside).alias(f"__l_{n}") for n, v in latest.items()])
    # one narrow row per block; computed from the input again with map-side combine
    per_block = keyed.groupBy(*keys).agg(
        *[F.sum(v).alias(f"__t_{n}") for n, v in summed.items()],
        *[_latest(keyed, order, v).alias(f"__t_{n}") for n, v in latest.items()])
    carried = per_block.select(
        *keys,
        *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in summed],
        *[F.last(f"__t_{n}", ignorenulls=True).over(earlier).alias(f"__o_{n}") for n in latest],
        *([F.sum(f"__t_{n}").over(whole).alias(f"{n}_total") for n in summed] if totals else []))
    # the big side is partitioned by `keys` already, so only the block table moves
    joined = local.join(carried, keys, "left")
    for name in summed:
        joined = joined.withColumn(name, F.col(f"__l_{name}") + F.col(f"__o_{name}"))
    for name in latest:
        joined = joined.withColumn(name, F.coalesce(f"__l_{name}", f"__o_{name}"))
    added = [c for n in summed for c in ([n, f"{n}_total"] if totals else [n])] + list(latest)
    return joined.select(*[c for c in df.columns if c not in added], *added)


def _latest(df: DataFrame, order: Sequence[str], value: Column) -> Column:
    """Aggregate: the non-null value of the last row in `order`.

    For a flag and one order column that is a whole number, the last places of true and of false: numbers are kept in a
    hash aggregate, where the largest struct would sort all rows.
    """
    flag = isinstance(df.select(value).schema[0].dataType, T.BooleanType)
    if flag and len(order) == 1 and isinstance(df.schema[order[0]].dataType, T.IntegralType):
        yes, no = F.max(F.when(value, F.col(order[0]))), F.max(F.when(~value, F.col(order[0])))
        return F.when(no.isNull(), F.when(yes.isNotNull(), True)).otherwise(F.coalesce(yes >= no, F.lit(False)))
    return F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("__v")))).getField("__v")


def running_sums(df: DataFrame, part: str | Sequence[str], order: str | Sequence[str],
                 sums: Mapping[str, Column], inclusive: bool = False, totals: bool = False,
                 block: int | None = BLOCK) -> DataFrame:
    return running(df, part, order, sums=sums, inclusive=inclusive, totals=totals, block=block)


def running_last(df: DataFrame, part: str | Sequence[str], order: str | Sequence[str],
                 value: Column, name: str, block: int | None = BLOCK) -> DataFrame:
    """Add the latest non-null `value` at or before each row of its group, else null."""
    return running(df, part, order, lasts={name: value}, inclusive=True, block=block)
