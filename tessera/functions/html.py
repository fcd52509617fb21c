"""HTML columns: native patterns for simple parts, an Arrow UDF for the document tree."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The entities that native columns know.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape_native(text: Column) -> Column:
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


@F.pandas_udf(T.StringType())
def unescape_nfkc(text: pd.Series) -> pd.Series:
    """All entities and NFKC; an optional step, since it leaves the JVM."""
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", unescape(t)))


def strip_tags(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; known entities, single spaces."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(unescape_native(t), r"\s+", " "))


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(unescape_native(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " "))


def meta_description(html: Column) -> Column:
    """Description, Open Graph or Twitter description; '' without one."""
    h = F.coalesce(html, F.lit(""))
    tag = lambda key, name: F.nullif(F.regexp_extract(h, rf"""(?is)<meta[^>]+{key}=["']{name}["'][^>]*content=["']([^"']*)["']""", 1), F.lit(""))
    return F.trim(unescape_native(F.coalesce(tag("name", "description"), tag("property", "og:description"), tag("name", "twitter:description"), F.lit(""))))


def json_ld(html: Column) -> Column:
    """Array of the JSON-LD blocks of a page."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))


# ------------------------------------------------------------- document tree
# Elements and name parts that count for or against content.
NOISE_TAGS = {"script", "style", "noscript", "nav", "footer", "header", "aside", "form", "iframe", "svg", "button"}
NOISE_NAMES = ("nav", "menu", "sidebar", "footer", "header", "comment", "advert", "promo", "social", "share", "related", "cookie", "popup", "widget", "breadcrumb", "pagination", "newsletter", "subscribe")
CONTENT_NAMES = ("article", "content", "post", "story", "entry", "main", "body-text")
CONTAINERS = {"div", "article", "main", "section", "td"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Node:
    __slots__ = ("links", "paragraphs", "parts", "tag", "tags", "title")

    def __init__(self, tag: str, title: str):
        self.tag, self.title, self.parts, self.tags, self.paragraphs, self.links = tag, title, [], 0, 0, 0


class _Tree(HTMLParser):
    """One pass: every open container gathers its text, tags, paragraphs and link text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Node] = []
        self.done: list[_Node] = []
        self.noise = 0
        self.links = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        if self.noise or tag in NOISE_TAGS:
            self.noise += tag in NOISE_TAGS
            return
        for node in self.open:
            node.tags += 1
            node.paragraphs += tag == "p"
        self.links += tag == "a"
        if tag in CONTAINERS:
            names = dict(attrs)
            self.open.append(_Node(tag, f"{names.get('class') or ''} {names.get('id') or ''}".lower()))

    def handle_endtag(self, tag):
        if tag in NOISE_TAGS:
            self.noise = max(0, self.noise - 1)
        elif not self.noise:
            if tag == "a":
                self.links = max(0, self.links - 1)
            if tag in CONTAINERS:
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i].tag == tag:
                        self.done += self.open[i:]
                        del self.open[i:]
                        break

    def handle_data(self, data):
        text = data.strip()
        if text and not self.noise:
            for node in self.open:
                node.parts.append(text)
                node.links += len(text) if self.links else 0


def density_extract(html: str | None, least: float = 10.0) -> tuple[str, float]:
    """(text, confidence) of the container with the best text density: characters per tag, paragraphs, few links, telling names."""
    tree = _Tree()
    try:
        tree.feed(html or "")
        tree.close()
    except Exception:  # a broken page has no content, and must not end the job
        return "", 0.0
    scored = []
    for node in tree.done + tree.open:
        text = " ".join(node.parts)
        if len(text) < 40:
            continue
        names = 15 * sum(h in node.title for h in CONTENT_NAMES) - 20 * sum(h in node.title for h in NOISE_NAMES)
        names += {"article": 25, "main": 20}.get(node.tag, 0)
        scored.append((len(text) / max(node.tags, 1) + min(3 * node.paragraphs, 60) - 100 * node.links / len(text) + names, "\n".join(node.parts)))
    if not scored:
        return "", 0.0
    scored.sort(key=lambda s: -s[0])
    best, text = scored[0]
    if best < least:
        return "", 0.0
    margin = best - (scored[1][0] if len(scored) > 1 else 0.0)
    trust = 0.2 + min(margin / 200, 0.4) + min(len(text) / 3000, 0.4)
    return re.sub(r"\n{3,}", "\n\n", text), max(0.0, min(round(trust, 3), 0.95))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())]))
def extract_content(html: pd.Series) -> pd.DataFrame:
    """``density_extract`` of a column; put it behind every filter and limit of a plan."""
    return pd.DataFrame([density_extract(h) for h in html], columns=["text", "confidence"])
