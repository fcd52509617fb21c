"""Provider payloads and end-to-end pipelines on hand-made rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.plans import pipelines
from tessera.sources import payloads


def frame(spark, payload, name="payload"):
    text = payload if isinstance(payload, str) else json.dumps(payload)
    return spark.createDataFrame([(1, text), (2, "{broken"), (3, None)], f"k long, {name} string")


def test_discord(spark):
    page = [
        {"id": "7", "content": "", "embeds": [{"title": "A", "description": "B"}], "author": {"username": "u"}, "reactions": [{"emoji": {"name": "x"}, "count": 2}]},
        {"id": "9", "content": "hi", "attachments": [{"url": "f"}], "timestamp": "2024-03-01T10:00:00+00:00"},
    ]
    got = payloads.discord_messages(frame(spark, page), "payload", "k").orderBy("n").collect()
    assert [(r["id"], r["content"]) for r in got] == [("7", "A\nB"), ("9", "hi")]
    assert got[0]["reactions"][0]["count"] == 2 and got[1]["attachments"] == ["f"]
    assert [r["id"] for r in payloads.page_before(payloads.discord_messages(frame(spark, page)), "9", 5).collect()] == ["7"]


def test_instagram_and_telegram(spark):
    block = {"@graph": [{"@type": "BlogPosting", "articleBody": "text", "author": {"name": "me"}, "mainEntityOfPage": {"@id": "https://i/p"}}, {"@type": "Person"}]}
    page = f'<script type="application/ld+json">{json.dumps(block)}</script>'
    got = payloads.instagram_posts(frame(spark, page, "html")).collect()
    assert [(r["author"], r["content"], r["url"]) for r in got] == [("me", "text", "https://i/p")]
    post = '<div class="tgme_widget_message" data-post="c/{}"><div class="tgme_widget_message_text">Hi <b>you</b></div><span class="tgme_widget_message_views">1.2K</span><time datetime="2024-03-01"></time></div>'
    html = "<html>" + post.format(1) + post.format(2) + post.format(2) + '<div data-post="c/3"><a class="tgme_widget_message_photo_wrap"></a></div>'
    got = payloads.telegram_posts(frame(spark, html, "html"), "html", "k").orderBy("id").collect()
    assert [(r["id"], r["type"], r["text"], r["views_count"]) for r in got] == [("c/1", "text", "Hi you", 1200), ("c/2", "text", "Hi you", 1200), ("c/3", "photo", "", None)]
    names = spark.createDataFrame([("https://t.me/s/News?x=1",), ("@news",), ("news",)], "t string").select(payloads.channel_name(F.col("t")).alias("c"))
    assert {r["c"] for r in names.collect()} == {"news"}


def test_repositories(spark):
    repo = {"full_name": "o/r", "stargazers_count": 5, "license": {"spdx_id": "MIT"}, "fork": False, "topics": ["a"]}
    got = payloads.repositories(frame(spark, repo), "payload", "k").where("k = 1").first()
    assert (got["full_name"], got["stars"], got["license"], got["is_fork"], got["topics"]) == ("o/r", 5, "MIT", False, ["a"])
    listing = [{"number": 1, "labels": [{"name": "bug"}], "user": {"login": "u"}}, {"number": 2, "pull_request": {"url": "x"}}]
    assert [(r["number"], r["labels"]) for r in payloads.issues(frame(spark, listing)).collect()] == [(1, ["bug"])]
    assert payloads.issues(frame(spark, listing), pull_requests=True).count() == 2
    log = [{"sha": "s", "commit": {"message": "one\n\ntwo", "author": {"name": "n", "date": "d"}}}]
    assert payloads.commits(frame(spark, log)).first()["title"] == "one"
    refs = spark.createDataFrame([("https://github.com/o/r.git",), ("o/r",), ("nothing",)], "t string").select(payloads.repo_ref(F.col("t")).alias("r")).collect()
    assert [r["r"] and tuple(r["r"]) for r in refs] == [("o", "r"), ("o", "r"), None]
    header = '<https://api/x?page=2>; rel="next", <https://api/x?per_page=1&page=34>; rel="last"'
    assert spark.range(1).select(payloads.last_page(F.lit(header)).alias("n")).first()["n"] == 34


def test_wiki(spark):
    page = {"query": {"pages": {"9": {"pageid": 9, "title": "T", "extract": " a  b ", "links": [{"title": "L"}, {"title": "User:X"}, {"title": "L"}], "categories": [{"title": "Category:C"}]}}}}
    got = payloads.wiki_pages(frame(spark, page), "payload", "k").first()
    assert (got["pageid"], got["extract"], got["links"], got["categories"]) == (9, "a b", ["L"], ["Category:C"])
    rows = spark.createDataFrame([("f", 0, "User:A", "x"), ("f", 1, "Art", '<span class="autocomment">Lead</span><table><tr><td>d</td></tr></table>'), ("f", 2, "Art", "again")], "feed_url string, n int, title string, summary string")
    assert [(r["title"], r["summary"]) for r in payloads.recent_changes(rows).collect()] == [("Art", "Lead")]


def test_videos_and_result_pages(spark):
    data = {"a": [{"videoRenderer": {"videoId": "v1", "title": {"runs": [{"text": "One"}]}}}, {"b": {"videoRenderer": {"videoId": "v1"}}}, {"videoRenderer": {"videoId": "v2", "title": {"simpleText": "Two"}}}]}
    got = payloads.videos(frame(spark, f"<script>var ytInitialData = {json.dumps(data)};</script>", "html"), "html", "k").orderBy("n").collect()
    assert [(r["video_id"], r["title"]) for r in got] == [("v1", "One"), ("v2", "Two")]
    serp = '<a href="https://d.com/l/?uddg=https%3A%2F%2Fx.org%2Fa">Title &amp; more</a><span>Body text</span><a href="/next">n</a>'
    got = payloads.result_page(frame(spark, serp, "html")).collect()
    assert [(r["title"], r["href"], r["body"]) for r in got] == [("Title & more", "https://x.org/a", "Body text")]
    assert spark.range(1).select(payloads.publisher_title(F.lit("Big news - The Paper"), F.lit("the paper"), "google_news").alias("t")).first()["t"] == "Big news"


def candidates(spark, n=12):
    rows = [(i, f"python guide {i}" if i % 2 else f"cooking {i}", "snippet", "", f"https://h{i}.org/x", "toi", "2024-03-01") for i in range(n)]
    return spark.createDataFrame(rows, "pos long, title string, snippet string, content string, url string, source string, publish_date string")


def test_search_resolves_wrappers(spark):
    now = F.to_timestamp(F.lit("2024-03-02"))
    rows = candidates(spark)
    wrapped = rows.limit(1).withColumn("url", F.lit("https://www.msn.com/a?url=https%3A%2F%2Fpub.org%2Fstory")).withColumn("title", F.lit("python wrapped"))
    lost = rows.limit(1).withColumn("url", F.lit("https://www.msn.com/b")).withColumn("title", F.lit("python lost"))
    got = pipelines.search([rows, wrapped, lost], "python", now, k=20, with_content=True).collect()
    assert "https://pub.org/story" in {r["url"] for r in got} and not any("msn.com" in r["url"] for r in got)
    assert [r["rank"] for r in pipelines.search([rows, rows], "python", now, k=5).collect()] == [1, 2, 3, 4, 5]


def test_rerank_with_model_and_merge(spark):
    now = F.to_timestamp(F.lit("2024-03-02"))
    rows = candidates(spark)
    got = pipelines.semantic_rerank(rows, "python", cross_encoder=F.col("pos").cast("double"), top=5, collapse=False).orderBy("semantic_rank").collect()
    assert [r["semantic_rank"] for r in got] == list(range(1, 13)) and [r["reranked"] for r in got] == [True] * 5 + [False] * 7
    merged = pipelines.merge_and_rank("python", rows.unionByName(rows.withColumn("pos", F.col("pos") + 100)), None, now, 5).collect()
    assert len(merged) == 5 and len({r["url"] for r in merged}) == 5
