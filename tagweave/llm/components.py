"""Connected components of an edge table, by least labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.session import settle

_ROUNDS = 64


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `root`: every node that stands in an edge and the least node of its component.

    Each round gives a node the least label among itself and its neighbours, then the label of that label, so
    that long chains shorten fast. Rounds are written to the shared folder; both sides of the joins are tables
    read back, so a node of very many edges is split by the adaptive planner. Edges with a null end or to
    itself add nothing; an empty table gives an empty table.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    both = settle(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = settle(both.groupBy("u").agg(F.least("u", F.min("v")).alias("root")).withColumnRenamed("u", "node"))
    for _ in range(_ROUNDS):
        near = (both.join(labels.select(F.col("node").alias("v"), "root"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near")))
        lower = settle(labels.join(near, "node", "left")
                       .select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        short = lower.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        following = settle(lower.join(short, "root", "left")
                           .select("node", F.least("root", "beyond").alias("root"), "old"))
        changed = following.filter("root <> old").limit(1).count()
        labels = following.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {_ROUNDS} rounds")
