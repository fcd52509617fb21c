"""Behaviour that the SQL comparison does not pin: properties, edge rows, sinks, streams."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, html, structure, text, urls
from tessera.functions import query as Q
from tessera.operators import bm25f, dedup, diff, documents, facets, feeds, graph, ingest, ranking, state, vectors
from tessera.sources import landed, plugins, sinks
from tessera.streaming import jobs

def now():
    return F.to_timestamp(F.lit("2024-03-02 00:00:00"))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# ------------------------------------------------------------------------ text
@pytest.mark.parametrize(
    ("word", "stem"),
    [("running", "run"), ("computers", "computer"), ("relational", "relate"), ("dieing", "dy"), ("falling", "fall"), ("cat", "cat"), ("größen", "größen"), ("happiness", "happi"), ("flies", "fly")],
)
def test_stems(spark, word, stem):
    assert spark.createDataFrame([(word,)], "w string").select(text.stem("w").alias("s")).first()["s"] == stem == text.stem_word(word)


def test_query_operators():
    assert Q.parse('alpha +beta -gamma "two words"') == Q.Terms(("beta",), ("gamma",), ("two words",))
    assert Q.parse("alpha beta").required == ("alpha", "beta")
    assert Q.parse("alpha +beta", bare_required=True).required == ("alpha", "beta")


def test_null_and_empty_texts(spark):
    rows = spark.createDataFrame([(None,), ("",)], "t string").select(
        text.tokens(F.col("t")).alias("tokens"), text.word_count(F.col("t")).alias("n"), F.size(text.sentences(F.col("t"))).alias("s"), text.readability(F.col("t")).alias("f"), F.size(structure.paragraphs(F.col("t"))).alias("p")
    ).collect()
    assert all((r["tokens"], r["n"], r["s"], r["f"], r["p"]) == ([], 0, 0, None, 0) for r in rows)


def test_sentences_keep_abbreviations(spark):
    got = one(spark, text.sentences(F.lit("Dr. Smith went home early today. He was very tired indeed!")))
    assert got == ["Dr. Smith went home early today.", "He was very tired indeed!"]


def test_repeated_headers(spark):
    page = "\n".join(["Menu item"] * 5 + [f"A longer line of text number {i}" for i in range(8)])
    assert one(spark, text.drop_repeated_headers(F.lit(page))).count("Menu item") == 1


# ------------------------------------------------------------------------ BM25
def corpus(spark, *titles):
    return spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(titles)], "pos long, title string, snippet string, content string, url string")


def ranks(spark, query, *titles):
    return [r["pos"] for r in bm25f.top(bm25f.scores(corpus(spark, *titles), query), "bm25f", 10).collect()]


def test_bm25f_title_beats_content(spark):
    docs = spark.createDataFrame([(0, "x", "python here", ""), (1, "python", "x here", "")], "pos long, title string, content string, url string").withColumn("snippet", F.lit(""))
    assert bm25f.top(bm25f.scores(docs, "python"), "bm25f", 1).first()["pos"] == 1


def test_bm25f_typo_prefix_stem_phrase(spark):
    assert ranks(spark, "pyhon", "python guide", "cooking book") == [0]
    assert ranks(spark, "comp", "computer guide", "cooking book") == [0]
    assert ranks(spark, "running", "run fast", "cooking book") == [0]
    assert ranks(spark, "machine learning", "learning a machine", "machine learning now")[0] == 1
    assert ranks(spark, "absent", "python guide") == []


def test_bm25_scores_are_positive(spark):
    got = bm25f.flat_scores(corpus(spark, "a", "b").withColumn("content", F.col("title")), "a").collect()
    assert [r["pos"] for r in got] == [0] and got[0]["bm25"] > 0


# --------------------------------------------------------------------- ranking
def test_fusion_puts_last_in_both_last(spark):
    a, b = (spark.createDataFrame(x, "pos long, rank int") for x in ([(0, 1), (1, 2), (2, 3)], [(1, 1), (0, 2), (2, 3)]))
    assert ranking.fuse(a, b).orderBy(F.desc("rrf")).collect()[-1]["pos"] == 2


def test_weights_sum_to_one():
    assert all(abs(sum(w) - 1) < 1e-9 for w in [*ranking.WEIGHTS.values(), ranking.GENERAL_WEIGHTS])


@pytest.mark.parametrize(("hours", "want"), [(1, 1.0), (100, 0.8), (500, 0.5), (5000, 0.2)])
def test_recency_steps(spark, hours, want):
    assert one(spark, dates.recency_step(now() - F.make_interval(hours=F.lit(hours)), now())) == want


def test_freshness_edges(spark):
    assert one(spark, dates.freshness(F.lit(None).cast("timestamp"), F.lit("web"), now())) == 0.5
    assert one(spark, dates.freshness(now() + F.make_interval(hours=F.lit(3)), F.lit("web"), now())) == 1.0
    assert abs(one(spark, dates.freshness(now() - F.make_interval(hours=F.lit(48)), F.lit("news"), now())) - 0.5) < 1e-9


def test_diversity_falls_in_a_cluster(spark):
    rows = spark.createDataFrame([(0, 7), (1, 7), (2, 9)], "pos long, cluster long")
    assert {r["pos"]: r["diversity"] for r in ranking.diversity(rows).collect()} == {0: 1.0, 1: 0.5, 2: 1.0}


def test_authority_is_clamped(spark):
    rows = spark.createDataFrame([("https://nasa.gov/a",), ("https://unknown.example/x",), ("",)], "url string")
    learned = spark.createDataFrame([("nasa.gov", 500.0, 1.0), ("unknown.example", 1.0, 500.0)], "domain string, alpha double, beta double")
    got = {r["url"]: r["authority"] for r in ranking.with_authority(rows, adjustments=learned).collect()}
    assert got["https://nasa.gov/a"] == 1.0 and 0 <= got["https://unknown.example/x"] < 0.01 and got[""] == 0.5


def test_staged_extracts_only_the_first(spark):
    docs = corpus(spark, *[f"python {i}" for i in range(30)]).withColumn("source", F.lit("toi")).withColumn("publish_date", F.lit("2024-03-01"))
    seen = []

    def extract(rows):
        seen.append(rows.count())
        return rows

    assert ranking.staged(docs, "python", now(), extract, 15, 10).count() == 10 and seen == [15]


# ---------------------------------------------------------------------- dedup
def test_first_wins_and_empty_keys(spark):
    rows = spark.createDataFrame([(0, "a/"), (1, "a"), (2, ""), (3, None), (4, "b")], "pos long, url string")
    keep = lambda e: sorted(r["pos"] for r in dedup.first_wins(rows, dedup.url_key(F.col("url")), "pos", keep_empty=e).collect())
    assert keep(False) == [0, 4] and keep(True) == [0, 2, 3, 4]


def test_greedy_keep_is_order_dependent(spark):
    rows = spark.createDataFrame([(i,) for i in range(4)], "pos long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "earlier long, later long")  # a chain: 1 goes, so 2 stays, so 3 goes
    assert sorted(r["pos"] for r in dedup.greedy_keep(rows, pairs, "pos").collect()) == [0, 2]


def test_collapse_names_the_others(spark):
    story = "the quick brown fox jumps over the lazy dog near the river bank today " * 3
    rows = spark.createDataFrame([(0, "Story", "https://a.com/1", story), (1, "Story", "https://b.com/2", story), (2, "Other", "https://c.com/3", "something else entirely about cooking pasta at home tonight")], "pos long, title string, url string, content string")
    got = {r["pos"]: r["duplicates"] for r in dedup.collapse(rows).collect()}
    assert got == {0: ["https://b.com/2"], 2: []}


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(pairs).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


# ------------------------------------------------------------- facets and feeds
def test_facets_unknown_and_www(spark):
    rows = spark.createDataFrame([("https://www.a.com/x", "2024-01-05", "S", "EN"), ("", None, None, None)], "url string, publish_date string, source string, lang string")
    got = {(r["facet"], r["value"]): r["count"] for r in facets.facets(rows).collect()}
    assert got == {("domain", "a.com"): 1, ("domain", "unknown"): 1, ("date", "2024-01"): 1, ("date", "unknown"): 1, ("source", "s"): 1, ("source", "unknown"): 1, ("language", "en"): 1, ("language", "unknown"): 1}


RSS = """<rss version="2.0"><channel><title>T</title><item><title>A &amp; B</title><link>https://x.org/a/?utm_source=q&amp;k=1#f</link><guid>g1</guid><pubDate>Fri, 01 Mar 2024 10:00:00 GMT</pubDate><description><![CDATA[<p>Hello  <b>you</b></p>]]></description></item><item><broken</channel></rss>"""
ATOM = """<feed><entry><title>V</title><link href="https://x.org/v"/><published>2024-02-01T00:00:00Z</published><author><name>N</name></author><media:group><media:thumbnail url="https://i.org/t.jpg" width="10" height="x"/></media:group></entry></feed>"""


def test_feed_parsing(spark):
    raw = spark.createDataFrame([("r", RSS), ("a", ATOM), ("n", None)], "feed_url string, xml string")
    got = {r["feed_url"]: r.asDict() for r in feeds.normalize(feeds.parse(raw)).collect()}
    assert set(got) == {"r", "a"}
    assert (got["r"]["title"], got["r"]["url"], got["r"]["published"], got["r"]["summary"]) == ("A & B", "https://x.org/a/?k=1", "2024-03-01T10:00:00+00:00", "Hello you")
    assert (got["a"]["url"], got["a"]["author"], got["a"]["reading_time_minutes"]) == ("https://x.org/v", "N", 1)
    media = feeds.media(raw).collect()
    assert [(m["media_url"], m["width"], m["height"]) for m in media] == [("https://i.org/t.jpg", 10, None)]


def test_sort_newest_first(spark):
    rows = spark.createDataFrame([("old", "2020-01-01"), ("none", ""), ("new", "2024-01-01")], "title string, published string")
    assert [r["title"] for r in feeds.sort_newest(rows, dates.parse(F.col("published"))).collect()] == ["new", "old", "none"]


@pytest.mark.parametrize(
    "value", ["Fri, 01 Mar 2024 10:00:00 GMT", "Fri, 01 Mar 2024 10:00:00 +0000", "2024-03-01T10:00:00Z", "2024-03-01T10:00:00+00:00", "2024-03-01 10:00:00", "Fri, 1 Mar 2024 05:00:00 EST", "2024-03-01T11:00:00+0100"]
)
def test_date_formats(spark, value):
    assert one(spark, F.date_format(dates.parse(F.lit(value)), "yyyy-MM-dd HH:mm")) == "2024-03-01 10:00"


# ------------------------------------------------------------------ URLs, HTML
def test_urls(spark):
    assert one(spark, urls.normalize(F.lit("HTTPS://WWW.A.com/Path/?utm_source=x&b=2&ref=y#frag"))) == "HTTPS://www.a.com/Path/?b=2"
    assert one(spark, urls.normalize(F.lit("https://a.com/path/"))) == "https://a.com/path"
    assert one(spark, urls.host(F.lit("www.bare.org/x"))) == "bare.org"
    page = '<link rel="canonical" href="https://pub.org/story"/>'
    assert one(spark, urls.resolve(F.lit("https://www.msn.com/a"), F.lit(page))) == "https://pub.org/story"
    assert one(spark, urls.resolve(F.lit("https://news.google.com/r?url=https%3A%2F%2Fp.org%2Fx"), F.lit(""))) == "https://p.org/x"
    assert one(spark, urls.ranking_multiplier(F.lit("https://www.msn.com/a"), F.lit(False))) == 0.25


def test_density_extraction():
    body = "".join(f"<p>Sentence number {i} of the article body with enough words.</p>" for i in range(8))
    page = f"<html><nav><a href='/'>Home</a></nav><div class='sidebar'><a>one</a><a>two</a><a>three and more links to fill</a></div><article>{body}</article></html>"
    text_, trust = html.density_extract(page)
    assert "Sentence number 3" in text_ and "Home" not in text_ and 0 < trust <= 0.95
    assert html.density_extract("") == ("", 0.0) and html.density_extract(None) == ("", 0.0)


# ------------------------------------------------------------- documents, diffs
def test_sections(spark):
    page = "Intro line that is quite long and ends with a stop.\nFirst Heading\nA body line that is clearly longer than its heading.\nSecond Heading\nAnother body line, also clearly longer than the heading."
    got = {r["section"]: r["lines"] for r in documents.sections(spark.createDataFrame([(1, page)], "k long, t string"), "k", "t").collect()}
    assert set(got) == {"Main Content", "First Heading", "Second Heading"}


def test_truncation_keeps_characters(spark):
    assert one(spark, documents.truncate(F.lit("aé"), max_bytes=2)) == "a"
    assert one(spark, documents.parse_size(F.lit("5mb"))) == 5 * 1024**2
    assert one(spark, documents.convert_count(F.lit("1.2М"))) == 1_200_000  # a Cyrillic letter
    assert one(spark, documents.convert_count(F.lit("?"))) is None


def test_diff_numbers(spark):
    patch = "@@ -1,2 +1,3 @@\n a\n-b\n+c\n+d\n@@ -10 +11 @@\n e"
    got = [(r["type"], r["old_line"], r["new_line"]) for r in diff.patch_lines(spark.createDataFrame([(1, patch)], "k long, patch string"), "k").orderBy("n").collect()]
    assert got == [("hunk_header", None, None), ("context", 1, 1), ("removed", 2, None), ("added", None, 2), ("added", None, 3), ("hunk_header", None, None), ("context", 10, 11)]


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0]), (3, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in vectors.knn(rows, [2.0, 0.0], 2).collect()] == [0, 3]
    pieces = vectors.chunks(spark.createDataFrame([(1, "x" * 1200), (2, ""), (3, None)], "k long, t string"), "k", "t").collect()
    assert [(p["k"], p["chunk_idx"], len(p["chunk"])) for p in pieces] == [(1, 0, 500), (1, 1, 500), (1, 2, 300)]


# ----------------------------------------------------------------------- state
def test_bandit_prefers_what_works(spark):
    arms = spark.createDataFrame([("d", "good", 20, 0), ("d", "bad", 0, 20), ("e", "good", 1, 0)], "domain string, tier string, successes long, failures long")
    usable = spark.createDataFrame([("good",), ("bad",)], "tier string")
    for scored in (arms, state.beta_draws(arms, 3)):
        score = F.col("sample") if "sample" in scored.columns else None
        got = {r["domain"]: (r["tier"], r["chosen_by"]) for r in state.choose_arm(scored, "domain", ("tier",), usable, {"tier": "bad"}, score).collect()}
        assert got == {"d": ("good", "bandit"), "e": ("bad", "default")}
    assert state.beta_draws(arms, 3).collect() == state.beta_draws(arms, 3).collect()


def test_breaker_and_selectors(spark):
    base = dt.datetime(2024, 3, 1)
    log = spark.createDataFrame([("u", i, base + dt.timedelta(seconds=i), i == 0, "sel") for i in range(6)] + [("v", 9, base, True, "keep")], "url string, event_id long, ts timestamp, success boolean, selector string")
    when = lambda s: F.to_timestamp(F.lit(str(base + dt.timedelta(seconds=s))))
    assert {r["url"]: r["state"] for r in state.breaker(log, "url", when(10)).collect()} == {"u": "open", "v": "closed"}
    assert {r["url"]: r["state"] for r in state.breaker(log, "url", when(1000)).collect()}["u"] == "half_open"
    assert [r["url"] for r in state.selectors(log, "url", "selector").collect()] == ["v"]
    assert max(r["consecutive_failures"] for r in state.streaks(log, "url").collect()) == 5


# --------------------------------------------------------------------- streams
def stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.json(path)
    return spark.readStream.schema(schema).json(path)


def test_breaker_stream(spark, tmp_path):
    base = dt.datetime(2024, 3, 1)
    rows = [("u", base + dt.timedelta(seconds=i), False) for i in range(5)] + [("u", base + dt.timedelta(seconds=400), True), ("v", base, True)]
    log = stream(spark, rows, "url string, ts timestamp, success boolean", str(tmp_path / "log"))
    got = jobs.drain(jobs.breaker(log, "url"), "breaker_test").orderBy("ts").collect()
    assert [(r["key"], r["state"]) for r in got] == [("u", "open"), ("u", "half_open"), ("u", "closed")]


def test_selector_and_cache_streams(spark, tmp_path):
    base = dt.datetime(2024, 3, 1)
    rows = [("d", base + dt.timedelta(seconds=i), i == 0, "css", f"c{i // 2}") for i in range(4)]
    log = stream(spark, rows, "domain string, ts timestamp, success boolean, selector string, content string", str(tmp_path / "log"))
    got = jobs.drain(jobs.selectors(log, "domain", "selector"), "selectors_test", "update").collect()
    assert [(r["selector"], r["failures"]) for r in got] == [("", 0)]
    seen = jobs.drain(jobs.fresh_cache(log, "domain", 60), "cache_test").orderBy("ts").collect()
    assert [r["event"] for r in seen][:4] == ["stored", "unchanged", "changed", "unchanged"]


# --------------------------------------------------------------- sources, sinks
def test_plugins(spark):
    assert len(plugins.PLUGINS) == 34
    rows = spark.createDataFrame([("openalex", '{"title":"T","doi":"https://doi.org/1","cited_by_count":250}'), ("openalex", "{broken"), ("unpaywall", '{"title":"U"}')], "source string, payload string")
    got = plugins.search_all(rows, names=["openalex", "unpaywall"]).collect()
    assert sorted((r["source"], r["title"], r["authority_score"], r["error"]) for r in got if not r["error"]) == [("openalex", "T", 0.5, None), ("unpaywall", "U", 0.3, None)]
    assert sum(r["error"] is not None for r in got) == 1
    assert plugins.unknown(spark.createDataFrame([("arxiv",), ("nope",)], "source string"), spark).collect()[0]["source"] == "nope"


def test_landed_source(spark, tmp_path):
    for name in ("jikan", "gitlab"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.jsonl").write_text(json.dumps({"name": name, "title": name, "url": f"https://{name}.org"}) + "\n\n")
    spark.dataSource.register(landed.LandedSource)
    rows = spark.read.format("tessera_landed").option("path", str(tmp_path)).load()
    assert sorted(r["title"] for r in plugins.search_all(rows, names=["jikan", "gitlab"]).collect()) == ["gitlab", "jikan"]
    assert spark.read.format("tessera_landed").option("path", str(tmp_path)).option("sources", "jikan").load().count() == 1


def test_unified_flatten_prune_abstract(spark):
    rows = spark.createDataFrame([(1, "", "B", "80", "odd")], "pos long, title string, body string, score string, extra string")
    got = ingest.unified(rows).first()
    assert (got["title"], got["snippet"], got["authority_score"], json.loads(got["metadata"])) == ("", "B", 0.8, {"extra": "odd"})
    nested = spark.sql("SELECT named_struct('b', 1, 'c', array('x', 'y')) AS a")
    assert ingest.flatten(nested).first().asDict() == {"a.b": 1, "a.c": "x; y"}
    assert one(spark, ingest.abstract_text(F.from_json(F.lit('{"is":[1],"This":[0],"a":[2],"test":[3]}'), "map<string,array<int>>"))) == "This is a test"
    pruned = ingest.prune_empty(spark.createDataFrame([('{"a":"","b":"1"}',)], "metadata string")).first()["metadata"]
    assert json.loads(pruned) == {"b": "1"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("t|1", "https://a", {"k": 1}, "word " * 300)], "title string, url string, meta map<string,int>, body string")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).columns == ["title", "url", "body", "meta"]
    sinks.write_json(rows, str(tmp_path / "json"))
    wrapped = spark.read.json(str(tmp_path / "json")).first()["body"]
    assert max(map(len, wrapped)) <= 500 and " ".join(wrapped) == ("word " * 300).strip()
    assert one(spark, sinks.wrap_lines(F.lit("y" * 1201))) == ["y" * 500, "y" * 500, "y" * 201]
    assert "| t\\|1 |" in sinks.markdown(rows, "Report")
    assert sinks.yaml(rows.select("url")) == '- url: "https://a"\n'
    assert one(spark, sinks.safe_name(F.lit("A b/c: d?"))) == "A_bc_d"


def test_ranks_without_a_single_window(spark):
    rows = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") * 7 % 50).cast("double").alias("score")).repartition(7)
    want = {r["pos"]: i + 1 for i, r in enumerate(sorted(rows.collect(), key=lambda r: (-r["score"], r["pos"])))}
    assert {r["pos"]: r["rank"] for r in ranking.with_rank(rows, "score").collect()} == want
    assert {r["pos"]: r["rank"] for r in ranking.with_rank(rows, "score", limit=9).collect()} == {k: v for k, v in want.items() if v <= 9}
