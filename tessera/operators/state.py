"""Learned state over append-only outcome logs: arms, choices, strategies, selectors, breakers, caches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Attempts before learned choices count; rows kept of the logs; seconds that cache entries live.
LEAST_FETCH, LEAST_SOURCE = 3, 5
KEEP_STRATEGY, KEEP_SOURCE = 20_000, 10_000
TTL = {"news": 1800, "web": 21600, "static": 86400, "default": 7200}


def retain(log: DataFrame, cap: int, ts: str, key: str) -> DataFrame:
    """The newest ``cap`` rows (a top-k, so no single task sorts the log)."""
    return log.orderBy(F.desc(ts), F.desc(key)).limit(cap)


def arms(log: DataFrame, *keys: str, success: str = "success", latency: str = "latency_ms", ts: str = "ts") -> DataFrame:
    """Per key: successes, failures, mean latency, last seen."""
    ok = F.col(success)
    return log.groupBy(*keys).agg(F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.avg(latency).alias("avg_latency_ms"), F.max(ts).alias("last_seen"))


def best_arm(of: DataFrame, domain: str, *arm: str) -> DataFrame:
    """Per domain the arm with the best rate, then the least latency, then the first name; and the overall rate."""
    n = F.col("successes") + F.col("failures")
    rate = F.col("successes") / n
    ordered = F.struct(-rate, F.coalesce("avg_latency_ms", F.lit(0.0)), *arm)
    return of.groupBy(domain).agg(
        F.min_by(F.struct(*arm, rate.alias("rate")), ordered).alias("best"),
        F.sum(n).alias("attempts"),
        (F.sum("successes") / F.sum(n)).alias("overall_rate"),
    ).select(domain, *[F.col("best")[a].alias(a) for a in arm], F.col("best")["rate"].alias("best_rate"), "attempts", "overall_rate")


def posterior_mean(successes: Column, failures: Column) -> Column:
    return (successes + 1) / (successes + failures + 2)


def beta_draws(of: DataFrame, seed: int, name: str = "sample") -> DataFrame:
    """``of`` and one Beta(successes + 1, failures + 1) draw for each row, reproducible by ``seed`` and the row's content."""
    row = F.xxhash64(*of.columns)

    @F.pandas_udf("double")
    def draw(key: pd.Series, s: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng((seed, k & 0xFFFFFFFF)).beta(a + 1, b + 1) for k, a, b in zip(key, s, f, strict=True)])

    return of.withColumn(name, draw(row, F.coalesce("successes", F.lit(0)), F.coalesce("failures", F.lit(0))))


def choose_arm(of: DataFrame, domain: str, arm: tuple[str, ...], usable: DataFrame, default: dict[str, str], score: Column | None = None) -> DataFrame:
    """Per domain one usable arm by ``score`` (posterior mean unless a draw is given); the default below three attempts."""
    score = score if score is not None else posterior_mean(F.col("successes"), F.col("failures"))
    fit = of.join(usable, list(arm), "left_semi").withColumn("__score", score)
    n = F.col("successes") + F.col("failures")
    picked = fit.groupBy(domain).agg(F.sum(n).alias("attempts"), F.min_by(F.struct(*arm, (F.col("successes") / n).alias("rate")), F.struct(-F.col("__score"), *arm)).alias("best"))
    known = F.coalesce(F.col("attempts"), F.lit(0)) >= LEAST_FETCH
    every = of.select(domain).distinct().join(picked, domain, "left")
    return every.select(
        domain,
        *[F.when(known, F.col("best")[a]).otherwise(F.lit(default[a])).alias(a) for a in arm],
        F.when(known, "bandit").otherwise("default").alias("chosen_by"),
        F.when(known, F.round(F.col("best")["rate"], 3)).otherwise(0.0).alias("confidence"),
    )


def choose_sources(of: DataFrame, available: DataFrame, k: int = 5, score: Column | None = None) -> DataFrame:
    """(query_type, source_name, chosen_by): top ``k`` by score, or all below five attempts or up to ``k`` available.

    ``of`` are arms by (query_type, source_name), ``available`` is a small registry table (source_name).
    """
    types = of.groupBy("query_type").agg(F.sum(F.col("successes") + F.col("failures")).alias("attempts"))
    offered = available.agg(F.count(F.lit(1)).alias("offered"))
    grid = types.crossJoin(F.broadcast(available)).crossJoin(F.broadcast(offered))  # a registry of some dozens of names
    joined = grid.join(of.select("query_type", "source_name", "successes", "failures"), ["query_type", "source_name"], "left")
    joined = joined.withColumns({"successes": F.coalesce("successes", F.lit(0)), "failures": F.coalesce("failures", F.lit(0))})
    joined = joined.withColumn("__score", score if score is not None else posterior_mean(F.col("successes"), F.col("failures")))
    place = F.row_number().over(Window.partitionBy("query_type").orderBy(F.desc("__score"), "source_name"))
    all_of_them = (F.col("attempts") < LEAST_SOURCE) | (F.col("offered") <= k)
    return joined.withColumn("place", place).where(all_of_them | (F.col("place") <= k)).select("query_type", "source_name", F.when(all_of_them, "default").otherwise("bandit").alias("chosen_by"))


def authority_counters(log: DataFrame, domain: str, success: str, weight: Column | None = None) -> DataFrame:
    """(domain, alpha, beta): Beta counters from 1, by weight."""
    w = weight if weight is not None else F.lit(1.0)
    return log.groupBy(F.col(domain).alias("domain")).agg(
        (1 + F.sum(F.when(F.col(success), w).otherwise(0.0))).alias("alpha"), (1 + F.sum(F.when(F.col(success), 0.0).otherwise(w))).alias("beta")
    )


def strategies(log: DataFrame, domain: str = "domain", tier: str = "tier", success: str = "success") -> DataFrame:
    """(domain, strategy, confidence, counters) from attempts with requests and with a browser."""
    plain, ok = F.col(tier) == "requests", F.col(success)
    c = log.groupBy(domain).agg(
        F.count_if(plain).alias("requests_attempts"), F.count_if(plain & ok).alias("requests_successes"),
        F.count_if(~plain).alias("browser_attempts"), F.count_if(~plain & ok).alias("browser_successes"),
    )
    req = F.coalesce(F.try_divide(F.col("requests_successes").cast("double"), "requests_attempts"), F.lit(0.0))
    web = F.coalesce(F.try_divide(F.col("browser_successes").cast("double"), "browser_attempts"), F.lit(0.0))
    banned = (F.col("browser_attempts") >= 5) & (F.col("browser_successes") == 0)
    browser = (F.col("browser_attempts") >= 5) & (web >= 0.8) & (F.col("requests_attempts") >= 3) & (req <= 0.2)
    plainly = (F.col("requests_attempts") >= 5) & (req >= 0.8)
    return c.withColumn("strategy", F.when(banned, "banned").when(browser, "browser").when(plainly, "requests").otherwise("unknown")).withColumn(
        "confidence", F.when(banned, 1.0).when(browser, web).when(plainly, req).otherwise(0.0)
    )


def strategy_summary(of: DataFrame, domain: str = "domain", samples: int = 10) -> DataFrame:
    """(strategy, domains, sample): counts with the first names."""
    place = F.row_number().over(Window.partitionBy("strategy").orderBy(domain))
    counts = of.groupBy("strategy").agg(F.count(F.lit(1)).alias("domains"))
    first = of.withColumn("n", place).where(F.col("n") <= samples).groupBy("strategy").agg(F.array_sort(F.collect_list(domain)).alias("sample"))
    return counts.join(first, "strategy")


def skip_to_browser(log: DataFrame, domain: str = "domain", tier: str = "tier", success: str = "success") -> DataFrame:
    """(domain, skip, browser_rate, requests_rate): the second learner, over 0.8 against under 0.3."""
    s = strategies(log, domain, tier, success)
    req = F.try_divide(F.col("requests_successes").cast("double"), "requests_attempts")
    web = F.try_divide(F.col("browser_successes").cast("double"), "browser_attempts")
    enough = (F.col("requests_attempts") + F.col("browser_attempts") >= 5) & (F.col("requests_attempts") >= 3) & (F.col("browser_attempts") >= 3)
    return s.select(domain, F.coalesce(enough & (web > 0.8) & (req < 0.3), F.lit(False)).alias("skip"), web.alias("browser_rate"), req.alias("requests_rate"))


def health(log: DataFrame, key: str, success: str = "success", latency: str = "latency_ms", ts: str = "ts", status: str = "status", error: str = "error") -> DataFrame:
    """Per feed: counts, success rate, mean response time, uptime, last status and error."""
    ok = F.col(success)
    rate = F.round(F.count_if(ok) / F.greatest(F.count(F.lit(1)), F.lit(1)), 3)
    return log.groupBy(key).agg(
        F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.round(F.sum(latency) / F.count(F.lit(1)), 3).alias("average_response_time"),
        rate.alias("success_rate"), F.round(rate * 100, 2).alias("uptime_percentage"), F.max(F.when(ok, F.col(ts))).alias("last_success"), F.max(ts).alias("last_attempt"),
        F.max_by(F.when(ok, F.col(status)), F.when(ok, F.col(ts))).alias("last_status"), F.max_by(F.when(~ok, F.col(error)), F.when(~ok, F.col(ts))).alias("last_error"),
    )


def breaker(log: DataFrame, key: str, now: Column, success: str = "success", ts: str = "ts", order: str = "event_id", threshold: int = 5, timeout: float = 300.0) -> DataFrame:
    """(key, failure_count, state): consecutive failures at the end of each key's log and the breaker they leave.

    The failures since the last success are an aggregate, so no key's log is sorted.
    """
    ok = F.col(success)
    last_ok = log.where(ok).groupBy(key).agg(F.max(F.struct(ts, order)).alias("ok_at"))
    since = log.join(last_ok, key, "left").where(F.col("ok_at").isNull() | (F.struct(ts, order) > F.col("ok_at")) | ok)
    counts = since.groupBy(key).agg(F.count_if(~ok).alias("failure_count"), F.max(F.when(~ok, F.col(ts))).alias("last_failure"))
    waited = (F.unix_micros(now) - F.unix_micros("last_failure")) / 1e6
    state = F.when(F.col("failure_count") < threshold, "closed").when(waited > timeout, "half_open").otherwise("open")
    return counts.select(key, "failure_count", state.alias("state"))


def streaks(log: DataFrame, key: str, success: str = "success", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """``log`` and ``consecutive_failures`` up to each row (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(ts, order)
    island = log.withColumn("__island", F.sum(F.col(success).cast("int")).over(w))
    inside = Window.partitionBy(key, "__island").orderBy(ts, order)
    return island.withColumn("consecutive_failures", F.sum((~F.col(success)).cast("int")).over(inside)).drop("__island")


def selectors(log: DataFrame, key: str, selector: str, success: str = "success", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(key, selector, failures): the last successful selector of each key, forgotten at three failures since."""
    ok = F.col(success)
    last = log.where(ok).groupBy(key).agg(F.max(F.struct(F.col(ts).alias("t"), F.col(order).alias("o"), F.col(selector).alias("s"))).alias("l"))
    after = log.join(last, key).where(~ok & (F.struct(F.col(ts), F.col(order)) > F.struct(F.col("l.t"), F.col("l.o")))).groupBy(key).agg(F.count(F.lit(1)).alias("failures"))
    return last.join(after, key, "left").select(key, F.col("l.s").alias("selector"), F.coalesce("failures", F.lit(0)).alias("failures")).where(F.col("failures") < 3)


def cache_state(entries: DataFrame, now: Column, key: str = "url", content: str = "content", kind: str = "content_type", at: str = "cached_at") -> DataFrame:
    """Latest entry of each key: its age, whether it is fresh, and whether the content changed since the one before."""
    hashed = entries.withColumn("content_hash", F.substring(F.sha2(F.coalesce(F.col(content), F.lit("")), 256), 1, 16))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc("content_hash")))
    last = hashed.withColumn("n", place).where(F.col("n") <= 2)
    two = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", F.col(at).alias("t"), F.col("content_hash").alias("h"), F.col(kind).alias("k")))).alias("l"))
    ttl = F.coalesce(F.create_map(*[x for k, v in TTL.items() for x in (F.lit(k), F.lit(v))])[F.col("l")[0]["k"]], F.lit(TTL["default"]))
    age = (F.unix_micros(now) - F.unix_micros(F.col("l")[0]["t"])) / 1e6
    return two.select(key, age.alias("age_seconds"), (age <= ttl).alias("fresh"), F.when(F.size("l") > 1, F.col("l")[0]["h"] != F.get(F.col("l"), F.lit(1))["h"]).otherwise(False).alias("content_changed"))


def cache_stats(entries: DataFrame, content: str = "content") -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length(content)).alias("bytes"))
