"""Graphs: components, breadth-first search, link extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``pairs`` (two id columns): the smallest node reachable.

    Each round a node takes the least label around it, and then the label of its
    label, so paths halve; rounds are checkpointed.
    """
    x, y = pairs.columns
    both = pairs.select(F.col(x).alias("u"), F.col(y).alias("v"))
    edges = cut(both.union(both.select("v", "u")).distinct())
    labels = cut(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("m"))
        lower = labels.join(near, F.col("node") == F.col("u")).select("node", F.least("label", "m").alias("label"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut(lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label")))
        moved = new.join(labels.withColumnRenamed("label", "old"), "node").where(F.col("label") != F.col("old"))
        still = moved.isEmpty()
        labels = new
        if still:
            return labels.withColumnRenamed("label", "component")


def links(html: Column) -> Column:
    """Distinct href targets in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<a\s[^>]*href=["']([^"'#]+)"""), F.lit(1)))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, fanout: int | None = None) -> DataFrame:
    """(node, depth) reached from ``seeds`` (node) over ``edges`` (source, target[, ord]) within ``depth`` steps.

    ``fanout`` follows only the first targets of a page, as a crawl does.
    """
    if fanout is not None:
        from pyspark.sql import Window

        edges = edges.withColumn("__n", F.row_number().over(Window.partitionBy("source").orderBy("ord"))).where(F.col("__n") <= fanout)
    edges = cut(edges.select("source", "target").distinct())
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.select(F.col("node").alias("source")).join(edges, "source").select(F.col("target").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    return seen
