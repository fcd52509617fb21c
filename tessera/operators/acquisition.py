"""Decisions of acquisition over request and outcome logs: turns, proxies, alternate sources, resilient fetches.

Collectors do the input and output; what they asked and what came of it are tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIRECT = "direct"
#: Seconds between requests to one host, and for which a failed proxy rests.
DELAY, COOLDOWN = 1.0, 60.0


def turns(requests: DataFrame, host: str = "host", at: str = "at", order: str = "pos", delay: float = DELAY) -> DataFrame:
    """``requests`` (``at``: seconds at which each arrives) and ``start``: its turn, ``delay`` or more after the one before to its host.

    A turn starts at its arrival or ``delay`` after the last one: the largest of all
    earlier arrivals, each moved on by the turns since.  So a running maximum says
    it, and no loop; a host's requests are one window.
    """
    mine = Window.partitionBy(host).orderBy(at, order)
    place = F.row_number().over(mine) - 1
    ahead = requests.withColumn("__n", place).withColumn("__free", F.col(at) - F.col("__n") * F.lit(delay))
    start = F.max("__free").over(mine.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("__n") * F.lit(delay)
    return ahead.withColumn("start", start).drop("__n", "__free")


def proxy_id(proxy: Column) -> Column:
    """Host and port of a proxy, without scheme and credentials."""
    return F.regexp_replace(F.regexp_replace(proxy, "^[^:/]+://", ""), "^.*@", "")


def proxies_available(proxies: DataFrame, log: DataFrame, now: Column, cooldown: float = COOLDOWN) -> DataFrame:
    """(proxy_id) that may be used at ``now``: those whose last outcome (proxy_id, success, ts) is a success, or longer ago than ``cooldown``; always ``DIRECT``."""
    last = log.groupBy("proxy_id").agg(F.max_by(F.struct("success", "ts"), "ts").alias("last"))
    known = proxies.select(proxy_id(F.col("proxy")).alias("proxy_id")).distinct().join(last, "proxy_id", "left")
    rested = F.coalesce(F.col("last.success") | (F.col("last.ts") + F.make_interval(secs=F.lit(cooldown)) <= now), F.lit(True))
    direct = proxies.sparkSession.range(1).select(F.lit(DIRECT).alias("proxy_id"))
    return known.where(rested & (F.col("proxy_id") != DIRECT)).select("proxy_id").unionByName(direct)


def ladder_outcomes(outcomes: DataFrame, url: str = "url", rung_order: str = "rung_order", rungs: int = 5) -> DataFrame:
    """(url, status, rung, rungs_tried): the first of the first ``rungs`` tries (url, rung, rung_order, success) that succeeded, and what was tried up to it."""
    tried = outcomes.where(F.col(rung_order) < rungs)
    first = F.min(F.when(F.col("success"), F.struct(rung_order, "rung")))
    each = tried.groupBy(url).agg(first.alias("first"), F.array_sort(F.collect_list(F.struct(rung_order, "rung"))).alias("all"))
    upto = F.filter("all", lambda t: F.col("first").isNull() | (t[rung_order] <= F.col("first")[rung_order]))
    return each.select(url, F.when(F.col("first").isNull(), "failed").otherwise("success").alias("status"), F.col("first.rung").alias("rung"), F.transform(upto, lambda t: t["rung"]).alias("rungs_tried"))


def fetch_outcomes(attempts: DataFrame, url: str = "url", order: str = "attempt") -> DataFrame:
    """(url, status, attempts, tier, error): what became of each URL over its attempts (url, attempt, tier, status_code, error).

    The first success counts; else the last attempt tells whether another try may help.
    """
    from .quality import classify_attempt

    judged = attempts.withColumn("class", classify_attempt(F.col("status_code"), F.col("error")))
    each = judged.groupBy(url).agg(
        F.min(F.when(F.col("class") == "success", F.struct(order, "tier"))).alias("won"), F.max(F.struct(order, "tier", "class", "error")).alias("last"), F.count(F.lit(1)).alias("n"),
    )
    ok = F.col("won").isNotNull()
    return each.select(
        url, F.when(ok, "success").when(F.col("last.class") == "transient", "retry").otherwise("failed").alias("status"),
        F.when(ok, F.col("won")[order] + 1).otherwise(F.col("n")).cast("int").alias("attempts"), F.when(ok, F.col("won.tier")).otherwise(F.col("last.tier")).alias("tier"), F.when(~ok, F.col("last.error")).alias("error"),
    )


def compacted(options: Column) -> Column:
    """A map of options without null and blank values."""
    return F.map_filter(options, lambda _, v: F.coalesce(F.trim(v), F.lit("")) != "")
