"""Queries on learned state, graphs, diffs, sources, streams, and relational checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import diff, graph, state
from ..sources import plugins, sinks
from ..streaming import jobs
from . import responses
from .common import ORACLES, query, table

_TIERS = ("requests", "browser", "requests", "mirror", "browser")
_LOG = "log AS (SELECT event_id, ts, 'd' || (user_id % 40) || '.example.org' AS domain, (['requests', 'browser', 'requests', 'mirror', 'browser'])[user_id % 5 + 1] AS arm, CASE WHEN event_id % 3 = 0 THEN 'browser' ELSE 'requests' END AS tier, (event_type <> 'error' AND (event_id + user_id) % 4 <> 0) AS success, value AS latency_ms FROM events)"


def outcome_log(spark, d):
    e = table(spark, d, "events")
    return with_outcomes(e)


def with_outcomes(e):
    arm = F.element_at(F.array(*[F.lit(x) for x in _TIERS]), (F.col("user_id") % 5 + 1).cast("int"))
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("d"), (F.col("user_id") % 40).cast("string"), F.lit(".example.org")).alias("domain"), arm.alias("arm"),
        F.when(F.col("event_id") % 3 == 0, "browser").otherwise("requests").alias("tier"),
        ((F.col("event_type") != "error") & ((F.col("event_id") + F.col("user_id")) % 4 != 0)).alias("success"), F.col("value").alias("latency_ms"),
    )


_ARMS = "arms AS (SELECT domain, tier, count(*) FILTER (WHERE success) AS successes, count(*) FILTER (WHERE NOT success) AS failures, avg(latency_ms) AS lat, max(ts) AS last_seen FROM log GROUP BY ALL)"


@query("strategy_arms", f"WITH {_LOG}, {_ARMS} SELECT domain, tier, successes, failures, round(lat, 6) AS avg_latency_ms, last_seen FROM arms")
def strategy_arms(spark, d):
    return state.arms(outcome_log(spark, d), "domain", "tier").withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


@query("best_arms", f"""WITH {_LOG}, {_ARMS}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY successes / CAST(successes + failures AS DOUBLE) DESC, coalesce(lat, 0), tier) AS k FROM arms),
o AS (SELECT domain, sum(successes + failures) AS attempts, sum(successes) / CAST(sum(successes + failures) AS DOUBLE) AS overall FROM arms GROUP BY domain)
SELECT domain, tier, round(successes / CAST(successes + failures AS DOUBLE), 6) AS best_rate, CAST(attempts AS BIGINT) AS attempts, round(overall, 6) AS overall_rate FROM r JOIN o USING (domain) WHERE k = 1""")
def best_arms(spark, d):
    best = state.best_arm(state.arms(outcome_log(spark, d), "domain", "tier"), "domain", "tier")
    return best.select("domain", "tier", F.round("best_rate", 6).alias("best_rate"), "attempts", F.round("overall_rate", 6).alias("overall_rate"))


@query("chosen_arms", f"""WITH {_LOG}, {_ARMS}, u AS (SELECT * FROM arms WHERE tier IN ('requests')), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY (successes + 1) / CAST(successes + failures + 2 AS DOUBLE) DESC, tier) AS k FROM u),
t AS (SELECT domain, sum(successes + failures) AS n FROM u GROUP BY domain), d AS (SELECT DISTINCT domain FROM arms)
SELECT d.domain, CASE WHEN coalesce(n, 0) >= 3 THEN tier ELSE 'requests' END AS tier, CASE WHEN coalesce(n, 0) >= 3 THEN 'bandit' ELSE 'default' END AS chosen_by, CASE WHEN coalesce(n, 0) >= 3 THEN round(successes / CAST(successes + failures AS DOUBLE), 3) ELSE 0.0 END AS confidence
FROM d LEFT JOIN t USING (domain) LEFT JOIN (SELECT * FROM r WHERE k = 1) r USING (domain)""")
def chosen_arms(spark, d):
    usable = spark.createDataFrame([("requests",)], "tier string")
    return state.choose_arm(state.arms(outcome_log(spark, d), "domain", "tier"), "domain", ("tier",), usable, {"tier": "requests"})


@query("beta_draws")
def beta_draws(spark, d):
    return state.beta_draws(state.arms(outcome_log(spark, d), "domain", "tier"), 7).select("domain", "tier", "sample")


@query("chosen_sources", f"""WITH {_LOG}, a AS (SELECT tier AS query_type, arm || '_' || (event_id % 4) AS source_name, count(*) FILTER (WHERE success) AS s, count(*) FILTER (WHERE NOT success) AS f FROM log GROUP BY ALL),
r AS (SELECT query_type, source_name, row_number() OVER (PARTITION BY query_type ORDER BY (s + 1) / CAST(s + f + 2 AS DOUBLE) DESC, source_name) AS k FROM a)
SELECT query_type, source_name, 'bandit' AS chosen_by FROM r WHERE k <= 5""")
def chosen_sources(spark, d):
    log = outcome_log(spark, d).withColumn("source_name", F.concat("arm", F.lit("_"), (F.col("event_id") % 4).cast("string"))).withColumnRenamed("tier", "query_type")
    names = spark.createDataFrame([(f"{a}_{i}",) for a in sorted(set(_TIERS)) for i in range(4)], "source_name string")
    return state.choose_sources(state.arms(log, "query_type", "source_name"), names)


@query("domain_strategies", f"""WITH {_LOG}, c AS (SELECT domain, count(*) FILTER (WHERE tier = 'requests') AS requests_attempts, count(*) FILTER (WHERE tier = 'requests' AND success) AS requests_successes,
 count(*) FILTER (WHERE tier <> 'requests') AS browser_attempts, count(*) FILTER (WHERE tier <> 'requests' AND success) AS browser_successes FROM log GROUP BY domain),
r AS (SELECT *, coalesce(CAST(requests_successes AS DOUBLE) / nullif(requests_attempts, 0), 0) AS req, coalesce(CAST(browser_successes AS DOUBLE) / nullif(browser_attempts, 0), 0) AS web FROM c)
SELECT domain, requests_attempts, requests_successes, browser_attempts, browser_successes, CASE WHEN browser_attempts >= 5 AND browser_successes = 0 THEN 'banned' WHEN browser_attempts >= 5 AND web >= 0.8 AND requests_attempts >= 3 AND req <= 0.2 THEN 'browser' WHEN requests_attempts >= 5 AND req >= 0.8 THEN 'requests' ELSE 'unknown' END AS strategy FROM r""")
def domain_strategies(spark, d):
    return state.strategies(outcome_log(spark, d)).drop("confidence")


@query("strategy_summary", ORACLES["domain_strategies"].replace("SELECT domain, requests_attempts", ", s AS (SELECT domain, requests_attempts", 1) + """), k AS (SELECT strategy, domain, row_number() OVER (PARTITION BY strategy ORDER BY domain) AS k FROM s)
SELECT strategy, count(*) AS domains, string_agg(domain, ' ' ORDER BY domain) FILTER (WHERE k <= 10) AS sample FROM k GROUP BY strategy""")
def strategy_summary(spark, d):
    return state.strategy_summary(state.strategies(outcome_log(spark, d))).withColumn("sample", F.array_join("sample", " "))


@query("browser_skips", f"""WITH {_LOG}, c AS (SELECT domain, count(*) FILTER (WHERE tier = 'requests') AS ra, count(*) FILTER (WHERE tier = 'requests' AND success) AS rs, count(*) FILTER (WHERE tier <> 'requests') AS ba, count(*) FILTER (WHERE tier <> 'requests' AND success) AS bs FROM log GROUP BY domain)
SELECT domain, coalesce(ra + ba >= 5 AND ra >= 3 AND ba >= 3 AND bs / CAST(nullif(ba, 0) AS DOUBLE) > 0.8 AND rs / CAST(nullif(ra, 0) AS DOUBLE) < 0.3, false) AS skip FROM c""")
def browser_skips(spark, d):
    return state.skip_to_browser(outcome_log(spark, d)).select("domain", "skip")


@query("feed_health", f"""WITH {_LOG} SELECT domain, count(*) FILTER (WHERE success) AS successes, count(*) FILTER (WHERE NOT success) AS failures, round(sum(latency_ms) / count(*), 3) AS average_response_time,
 round(count(*) FILTER (WHERE success) / CAST(count(*) AS DOUBLE), 3) AS success_rate, max(ts) FILTER (WHERE success) AS last_success, max(ts) AS last_attempt FROM log GROUP BY domain""")
def feed_health(spark, d):
    log = outcome_log(spark, d).withColumn("status", F.lit(200)).withColumn("error", F.lit("timeout"))
    return state.health(log, "domain").select("domain", "successes", "failures", "average_response_time", "success_rate", "last_success", "last_attempt")


@query("breaker_states", f"""WITH {_LOG}, k AS (SELECT domain, max(struct_pack(ts := ts, e := event_id)) FILTER (WHERE success) AS ok FROM log GROUP BY domain),
c AS (SELECT domain, count(*) FILTER (WHERE NOT success AND (ok IS NULL OR struct_pack(ts := ts, e := event_id) > ok)) AS failure_count, max(ts) FILTER (WHERE NOT success AND (ok IS NULL OR struct_pack(ts := ts, e := event_id) > ok)) AS lf FROM log JOIN k USING (domain) GROUP BY domain)
SELECT domain, failure_count, CASE WHEN failure_count < 2 THEN 'closed' WHEN epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(lf) > 7200 THEN 'half_open' ELSE 'open' END AS state FROM c""")
def breaker_states(spark, d):
    return state.breaker(outcome_log(spark, d), "domain", F.to_timestamp(F.lit("2024-01-31 00:00:00")), threshold=2, timeout=7200.0)


@query("failure_streaks", f"""WITH {_LOG}, i AS (SELECT event_id, domain, ts, success, sum(CAST(success AS INTEGER)) OVER (PARTITION BY domain ORDER BY ts, event_id) AS island FROM log)
SELECT event_id, CAST(sum(CAST(NOT success AS INTEGER)) OVER (PARTITION BY domain, island ORDER BY ts, event_id) AS BIGINT) AS consecutive_failures FROM i""")
def failure_streaks(spark, d):
    return state.streaks(outcome_log(spark, d), "domain").select("event_id", "consecutive_failures")


@query("remembered_selectors", f"""WITH {_LOG}, l AS (SELECT domain, max_by(arm, struct_pack(ts := ts, e := event_id)) FILTER (WHERE success) AS selector, max(struct_pack(ts := ts, e := event_id)) FILTER (WHERE success) AS ok FROM log GROUP BY domain),
f AS (SELECT domain, selector, count(*) FILTER (WHERE NOT success AND struct_pack(ts := ts, e := event_id) > ok) AS failures FROM log JOIN l USING (domain) WHERE ok IS NOT NULL GROUP BY ALL) SELECT domain, selector, failures FROM f WHERE failures < 3""")
def remembered_selectors(spark, d):
    return state.selectors(outcome_log(spark, d), "domain", "arm")


@query("cache_freshness", """WITH e AS (SELECT user_id, ts, substring(sha256(event_type), 1, 16) AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, substring(sha256(event_type), 1, 16) DESC) AS n FROM events),
a AS (SELECT user_id, max(ts) FILTER (WHERE n = 1) AS t, max(h) FILTER (WHERE n = 1) AS h1, max(h) FILTER (WHERE n = 2) AS h2 FROM e WHERE n <= 2 GROUP BY user_id)
SELECT user_id, round(epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(t), 3) AS age_seconds, epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(t) <= 21600 AS fresh, coalesce(h1 <> h2, false) AS content_changed FROM a""")
def cache_freshness(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("content"), F.lit("web").alias("content_type"), F.col("ts").cast("timestamp").alias("cached_at"))
    return state.cache_state(rows, F.to_timestamp(F.lit("2024-01-31 00:00:00")), "user_id").withColumn("age_seconds", F.round("age_seconds", 3))


@query("cache_statistics", "SELECT count(*) AS entries, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages")
def cache_statistics(spark, d):
    return state.cache_stats(table(spark, d, "pages"), "html")


@query("retained_outcomes", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def retained_outcomes(spark, d):
    return state.retain(table(spark, d, "events"), 2000, "ts", "event_id").select("event_id")


# ----------------------------------------------------------------- graph, diff
_EDGES = "edges AS (SELECT DISTINCT p_partkey AS source, (p_partkey * 7 + k * 13) % 1999 AS target FROM part CROSS JOIN (VALUES (1), (2), (3)) t(k))"


def _edges(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("source"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("ord"))
    return parts.select("source", ((F.col("source") * 7 + F.col("ord") * 13) % 1999).alias("target"), "ord")


@query("bfs_depth3", f"""WITH RECURSIVE {_EDGES}, r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT CAST(target AS BIGINT), depth + 1 FROM r JOIN edges ON source = node WHERE depth < 3)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def bfs_depth3(spark, d):
    return graph.bfs(_edges(spark, d), spark.createDataFrame([(1,)], "node long"), 3)


@query("bfs_multi_seed", f"""WITH RECURSIVE {_EDGES.replace('(1), (2), (3)', '(1), (2)')}, r AS (SELECT CAST(unnest([1, 50]) AS BIGINT) AS node, 0 AS depth UNION SELECT CAST(target AS BIGINT), depth + 1 FROM r JOIN edges ON source = node WHERE depth < 2)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def bfs_multi_seed(spark, d):
    return graph.bfs(_edges(spark, d), spark.createDataFrame([(1,), (50,)], "node long"), 2, fanout=2)


@query("connected_components", """WITH c AS (SELECT o_custkey, min(o_orderkey) AS component FROM orders GROUP BY o_custkey)
SELECT o_orderkey AS node, component FROM orders JOIN c USING (o_custkey) UNION ALL SELECT o_custkey + 1000000000000, component FROM c""")
def connected_components(spark, d):
    return graph.components(table(spark, d, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_custkey") + 1_000_000_000_000).alias("b")))


@query("patch_lines", """WITH p AS (SELECT o_orderkey AS k, o_orderkey % 50 + 1 AS s FROM orders), l(n, type, text, od, nd) AS (VALUES (0, 'hunk_header', '', NULL, NULL), (1, 'context', 'same', 0, 0), (2, 'removed', 'old', 1, NULL), (3, 'added', 'new', NULL, 1), (4, 'added', 'more', NULL, 2), (5, 'context', 'end', 2, 3))
SELECT k AS o_orderkey, CAST(n AS INTEGER) AS n, type, CASE WHEN n = 0 THEN '@@ -' || s || ',3 +' || (s + 10) || ',4 @@' ELSE text END AS text, CAST(s + od AS INTEGER) AS old_line, CAST(s + 10 + nd AS INTEGER) AS new_line FROM p CROSS JOIN l""")
def patch_lines(spark, d):
    s = F.col("o_orderkey") % 50 + 1
    patch = F.concat(F.lit("@@ -"), s.cast("string"), F.lit(",3 +"), (s + 10).cast("string"), F.lit(",4 @@\n same\n-old\n+new\n+more\n end"))
    return diff.patch_lines(table(spark, d, "orders").select("o_orderkey", patch.alias("patch")), "o_orderkey")


# --------------------------------------------------------------------- sources
@query("plugin_records", """WITH p AS (SELECT o_orderkey AS k, o_orderkey % 900 AS c, (['openalex', 'gitlab', 'jikan', 'zenodo', 'hackernews'])[o_orderkey % 5 + 1] AS source FROM orders)
SELECT k AS pos, source, CASE source WHEN 'openalex' THEN 'https://doi.org/10.1/' || k WHEN 'zenodo' THEN 'https://zenodo.org/records/' || k WHEN 'hackernews' THEN 'https://news.ycombinator.com/item?id=' || k ELSE 'https://example.org/' || k END AS url, 'Title ' || k AS title,
 CASE source WHEN 'openalex' THEN 'word ' || c WHEN 'gitlab' THEN 'GitLab project Title ' || k || ' — ' || c || ' stars, 0 forks' WHEN 'jikan' THEN CASE WHEN c > 0 THEN c || ' eps | Score: ' || c ELSE '' END WHEN 'zenodo' THEN 'Number ' || c ELSE 'Points: ' || c || ' | Comments: 3 | Author: a' || c END AS snippet,
 round(CAST(CASE source WHEN 'openalex' THEN least(c / 500.0, 1) WHEN 'gitlab' THEN least(c / 500.0, 1) WHEN 'jikan' THEN least(c / 10.0, 1) WHEN 'zenodo' THEN least((c + 1) / 1000.0, 1) ELSE least(c / 500.0, 1) END AS DOUBLE), 6) AS authority_score FROM p""")
def plugin_records(spark, d):
    k, c = F.col("k"), F.col("c")
    fill = lambda shape: F.replace(F.replace(F.lit(shape), F.lit("#K"), k), F.lit("#C"), c)
    shapes = {
        "openalex": '{"results":[{"id":"https://openalex.org/W#K","doi":"https://doi.org/10.1/#K","title":"Title #K","abstract_inverted_index":{"#C":[1],"word":[0]},"cited_by_count":#C}]}',
        "gitlab": '[{"id":#K,"name":"Title #K","web_url":"https://example.org/#K","star_count":#C}]',
        "jikan": '{"data":[{"mal_id":#K,"title":"Title #K","url":"https://example.org/#K","episodes":#C,"score":#C}]}',
        "zenodo": '{"hits":{"hits":[{"id":#K,"metadata":{"title":"Title #K","description":"<p>Number #C</p>"},"files":[{"downloads":#C},{"downloads":1}]}]}}',
        "hackernews": '{"hits":[{"objectID":"#K","title":"Title #K","points":#C,"num_comments":3,"author":"a#C"}]}',
    }
    source = F.element_at(F.array(*[F.lit(x) for x in shapes]), (F.col("pos") % 5 + 1).cast("int"))
    payload = F
    for name, shape in shapes.items():
        payload = payload.when(F.col("source") == name, fill(shape))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("k"), (F.col("o_orderkey") % 900).cast("string").alias("c")).withColumn("source", source)
    found = plugins.search_all(rows.select("pos", "source", payload.alias("payload")), names=sorted(shapes))
    return found.select("pos", "source", "url", "title", "snippet", F.round("authority_score", 6).alias("authority_score"))


@query("provider_records", responses.expected_sql())
def provider_records(spark, d):
    landed = spark.createDataFrame(responses.payloads(), "source string, payload string")
    return plugins.search_all(landed).select("source", *responses.FIELDS)


@query("source_listing", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t}', {str(n in ('arxiv', 'zenodo')).lower()})" for n, t in sorted((n, records[0][5]) for n, (_, records) in responses.RESPONSES.items())) + ") v(source, content_type, configured)")
def source_listing(spark, d):
    return plugins.listing(spark, ("arxiv", "zenodo"))


@query("unknown_sources", "SELECT DISTINCT p_type AS source FROM part WHERE p_type IS NOT NULL")
def unknown_sources(spark, d):
    known = plugins.listing(spark).select("source")
    return plugins.unknown(table(spark, d, "part").select(F.col("p_type").alias("source")).where("source IS NOT NULL").distinct().unionByName(known), spark)


@query("relaxed_attempts", """SELECT CAST(n_nationkey AS INTEGER) AS attempt, (['auto', 'html', 'lite'])[n_nationkey % 3 + 1] AS backend, CASE WHEN n_nationkey < 1 THEN 'set' END AS timelimit, CASE WHEN n_nationkey < 1 THEN 'set' END AS filters,
 CASE WHEN n_nationkey < 2 THEN 'moderate' ELSE 'off' END AS safesearch FROM nation""")
def relaxed_attempts(spark, d):
    return plugins.relaxation(table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("attempt")))


@query("merged_engines", """WITH r AS (SELECT 1 AS o, page_id AS pos, url FROM pages UNION ALL SELECT 2, page_id, url || '/' FROM pages UNION ALL SELECT 3, page_id, 'https://only.example.org/' || page_id FROM pages)
SELECT engine_ord, pos FROM (SELECT CAST(o AS INTEGER) AS engine_ord, pos, row_number() OVER (PARTITION BY regexp_replace(trim(url), '/+$', '') ORDER BY o, pos) AS k FROM r) WHERE k = 1""")
def merged_engines(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("pos"), "url")
    one = p.withColumn("engine_ord", F.lit(1))
    two = p.select("pos", F.concat("url", F.lit("/")).alias("url"), F.lit(2).alias("engine_ord"))
    three = p.select("pos", F.concat(F.lit("https://only.example.org/"), F.col("pos").cast("string")).alias("url"), F.lit(3).alias("engine_ord"))
    return plugins.merge_engines(one.unionByName(two).unionByName(three)).select("engine_ord", "pos")


@query("wrapped_lines", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text || chr(10), '(?s)(.{1,500}\s|\S{500})\s*', 1), lambda x: regexp_replace(x, '\s+$', '')), lambda x: x <> '') AS ls FROM documents)
SELECT doc_id, CAST(len(ls) AS INTEGER) AS n_lines, sha256(regexp_replace(array_to_string(ls, ''), '\s', '', 'g')) AS letters_sha256 FROM l""")
def wrapped_lines(spark, d):
    lines = sinks.wrap_lines(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(lines).alias("n_lines"), F.sha2(F.regexp_replace(F.array_join(lines, ""), r"\s", ""), 256).alias("letters_sha256"))


# --------------------------------------------------------------------- streams
def _stream(spark, d):
    schema = table(spark, d, "events").schema
    return with_outcomes(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))


def _name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


@query("stream_arms", f"WITH {_LOG} SELECT domain, tier, count(*) FILTER (WHERE success) AS successes, count(*) FILTER (WHERE NOT success) AS failures, max(ts) AS last_seen FROM log GROUP BY ALL")
def stream_arms(spark, d):
    return jobs.drain(jobs.arms(_stream(spark, d), "domain", "tier"), _name("arms"), "complete").select("domain", "tier", "successes", "failures", "last_seen")


@query("stream_tumbling", f"WITH {_LOG} SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS start, tier, count(*) AS n, count(*) FILTER (WHERE NOT success) AS failures FROM log GROUP BY ALL")
def stream_tumbling(spark, d):
    return jobs.drain(jobs.tumbling(_stream(spark, d), "tier", "6 hours"), _name("tumbling"), "complete")


@query("stream_sessions", f"""WITH {_LOG}, g AS (SELECT domain, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM log WINDOW w AS (PARTITION BY domain ORDER BY ts)),
s AS (SELECT domain, ts, sum(new) OVER (PARTITION BY domain ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT domain, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS end, count(*) AS n FROM s GROUP BY domain, k""")
def stream_sessions(spark, d):
    return jobs.drain(jobs.sessions(_stream(spark, d), "domain", "1 hour"), _name("sessions"), "complete")


@query("stream_first_seen", f"WITH {_LOG} SELECT DISTINCT domain FROM log")
def stream_first_seen(spark, d):
    return jobs.drain(jobs.first_seen(_stream(spark, d), "domain", "90 days"), _name("first")).select("domain")


@query("stream_breaker")
def stream_breaker(spark, d):
    return jobs.drain(jobs.breaker(_stream(spark, d), "domain", 3, 3600.0), _name("breaker"))


# ------------------------------------------------------------------ relational
@query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.to_timestamp(F.lit("1998-09-02")))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("top_orders_per_customer", "SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def top_orders_per_customer(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", place.alias("place")).where("place <= 3")


@query("grouping_sets", "SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_name), (c_mktsegment), ())")
def grouping_sets(spark, d):
    for t in ("customer", "nation"):
        table(spark, d, t).createOrReplaceTempView(f"tessera_{t}")
    return spark.sql("SELECT n_name, c_mktsegment, count(*) AS n FROM tessera_customer JOIN tessera_nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_name), (c_mktsegment), ())")


@query("set_operations", "(SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL (SELECT s_suppkey FROM supplier INTERSECT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def set_operations(spark, d):
    without = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select("o_custkey"))
    return without.unionAll(table(spark, d, "supplier").select("s_suppkey").intersect(table(spark, d, "lineitem").where("l_quantity > 49").select("l_suppkey")))


@query("semi_and_anti_joins", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def semi_and_anti_joins(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").select("c_custkey", F.lit(True).alias("has_orders")).unionByName(c.join(o, "c_custkey", "left_anti").select("c_custkey", F.lit(False).alias("has_orders")))
