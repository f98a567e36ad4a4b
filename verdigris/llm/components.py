"""Connected components by alternating large-star and small-star steps, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, staged


def _joined(edges: DataFrame, least: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (u, v) with the m of u, and the staged table of these: staged, so that the join shuffles both sides and a hub's edges can be split."""
    least = staged(least, "component-least")
    return edges.join(least, "u"), least


def _large(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined, least = _joined(both.where("v > u"), both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), least


def _small(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined, least = _joined(down, down.groupBy("u").agg(F.min("v").alias("m")))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), least


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """From edges (u, v): one row (node, component) for every node that is not its component's smallest."""
    state, before = staged(edges.select("u", "v").where("u <> v").distinct(), label), None
    while True:
        larger, one = _large(state)
        larger = staged(larger, label)
        smaller, two = _small(larger)
        last, state = state, staged(smaller, label)
        drop(last, larger, one, two)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            out = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out.staged_at = state.staged_at
            return out
        before = now
