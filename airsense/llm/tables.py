"""Stored tables, size-checked broadcasts and connected components shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsense.sources.stored import store

#: Rows up to which a side of a join is broadcast; its rows are counted first.
BROADCAST_ROWS = 100_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if a count finds at most ``rows`` rows; else joined by shuffle.

    ``df`` should be a stored table, since it is read twice.
    """
    return F.broadcast(df) if df.count() <= rows else df


def components(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by its smallest
    node.

    Each round gives every node the smallest label among its neighbours, then follows labels once
    (a label is itself a node), so that the number of rounds grows with the logarithm of a chain's
    length. Rounds are stored tables; only a count of changes reaches the driver. Labels of a
    counted, small number of nodes are broadcast, so that such a round shuffles once.
    """
    both = store(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = store(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")),
        f"{name}-labels",
    )
    for _ in range(rounds):
        known = small_side(labels)
        near = (
            both.join(known, both.b == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
            .withColumnRenamed("a", "node")
        )
        lower = near.join(known, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = small_side(labels.select(F.col("node").alias("component"), F.col("component").alias("further")))
        new = store(
            lower.join(jump, "component").select("node", "old", F.least("component", "further").alias("component")),
            f"{name}-labels",
        )
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle within {rounds} rounds")
