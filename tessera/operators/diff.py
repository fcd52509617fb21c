"""Unified diffs as tables of tagged, numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def patch_lines(patches: DataFrame, key: str, patch: str = "patch") -> DataFrame:
    """(key, n, type, text, old_line, new_line): running sums from each hunk's start."""
    lines = patches.where(F.coalesce(F.col(patch), F.lit("")) != "").select(key, F.posexplode(F.split(patch, "\n")).alias("n", "raw"))
    kind = (
        F.when(F.col("raw").startswith("@@"), "hunk_header")
        .when(F.col("raw").startswith("+") & ~F.col("raw").startswith("+++"), "added")
        .when(F.col("raw").startswith("-") & ~F.col("raw").startswith("---"), "removed")
        .otherwise("context")
    )
    by_file = Window.partitionBy(key).orderBy("n")
    marked = lines.withColumn("type", kind).withColumn("is_hunk", F.col("raw").rlike(_HUNK).cast("int")).withColumn("hunk", F.sum("is_hunk").over(by_file))
    before = Window.partitionBy(key, "hunk").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key, "hunk")
    start = lambda g: F.max(F.when(F.col("is_hunk") == 1, F.regexp_extract("raw", _HUNK, g).cast("int"))).over(whole)
    passed = lambda *kinds: F.coalesce(F.sum(F.col("type").isin(*kinds).cast("int")).over(before), F.lit(0))
    old, new = start(1) + passed("removed", "context"), start(2) + passed("added", "context")
    text = F.when(F.col("type").isin("added", "removed"), F.substring("raw", 2, 1 << 30)).when((F.col("type") == "context") & F.col("raw").startswith(" "), F.substring("raw", 2, 1 << 30)).otherwise(F.col("raw"))
    return marked.select(
        key, "n", "type", text.alias("text"),
        F.when(F.col("type").isin("removed", "context"), old).cast("int").alias("old_line"),
        F.when(F.col("type").isin("added", "context"), new).cast("int").alias("new_line"),
    )
