"""URL columns: host, normal form, cache key, variants, wrapper resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "_ga", "ref", "source")

# Hosts that wrap other publishers' articles.
WRAPPER_HOSTS = ("news.google.com", "www.msn.com", "msn.com", "news.yahoo.com", "finance.yahoo.com", "yahoo.com", "www.yahoo.com", "www.aol.com", "aol.com")

#: scheme, authority, path, query of a URL; the fragment is dropped.
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host(url: Column) -> Column:
    """Lower-case host without port and ``www.``; a bare domain is its own host; '' without one."""
    u = F.coalesce(url, F.lit(""))
    inside = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(F.when(inside != "", inside).otherwise(F.split(u, "/")[0])), r"^www\.", "")


def query_params(url: Column) -> Column:
    """The query's non-empty ``key=value`` parts in order."""
    return F.filter(F.split(F.regexp_extract(url, _PARTS, 4), "&"), lambda p: p.rlike(r"^[^=]+=.+"))


def _rebuilt(url: Column, params: Column) -> Column:
    base = F.concat(F.regexp_extract(url, _PARTS, 1), F.lit("://"), F.lower(F.regexp_extract(url, _PARTS, 2)), F.regexp_extract(url, _PARTS, 3))
    full = F.concat(base, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))
    slash = full.endswith("/") & (F.length(F.regexp_extract(url, _PARTS, 3)) > 1)
    return F.when(slash, F.regexp_replace(full, "/+$", "")).otherwise(full)


def normalize(url: Column) -> Column:
    """Without tracking parameters, fragment and trailing slash; host in lower case."""
    kept = F.filter(query_params(url), lambda p: ~F.regexp_extract(p, "^([^=]+)=", 1).isin(*TRACKING))
    return F.when(url.rlike(_PARTS), _rebuilt(url, kept)).otherwise(url)


def cache_key(url: Column, relevant: tuple[str, ...] = ()) -> Column:
    """First 32 hex digits of SHA-256 over the URL with its relevant parameters, sorted."""
    kept = F.array_sort(F.filter(query_params(url), lambda p: F.regexp_extract(p, "^([^=]+)=", 1).isin(*relevant) if relevant else F.lit(False)))
    return F.substring(F.sha2(F.when(url.rlike(_PARTS), _rebuilt(url, kept)).otherwise(F.coalesce(url, F.lit(""))), 256), 1, 32)


def is_wrapper(url: Column) -> Column:
    raw = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2))
    return raw.isin(*WRAPPER_HOSTS)


def variants(url: Column) -> Column:
    """Array of (rung, url): AMP, mobile and print forms, in order of trial."""
    base = F.regexp_replace(url, "/+$", "")
    joint = F.when(url.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    scheme, authority = F.regexp_extract(url, _PARTS, 1), F.regexp_extract(url, _PARTS, 2)
    mobile = F.concat(scheme, F.lit("://m."), F.regexp_replace(authority, r"^(www|m)\.", ""), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1))
    rung = lambda name, value: F.struct(F.lit(name).alias("rung"), value.alias("url"))
    return F.array(
        rung("amp_path", F.concat(base, F.lit("/amp"))),
        rung("amp_query", F.concat(url, joint, F.lit("amp=1"))),
        rung("mobile", mobile),
        rung("print_query", F.concat(url, joint, F.lit("print=1"))),
        rung("print_path", F.concat(base, F.lit("/print"))),
    )


def resolve(url: Column, html: Column) -> Column:
    """Publisher URL behind a wrapper page: query parameter, canonical link, og:url, JSON-LD, data attribute."""
    h = F.coalesce(html, F.lit(""))
    found = lambda c: F.nullif(c, F.lit(""))
    param = F.url_decode(found(F.regexp_extract(url, r"[?&](?:url|u|q|target)=(https?[^&#]+)", 1)))
    outside = lambda c: F.when(host(c) != host(url), c)
    return F.coalesce(
        param,
        outside(found(F.regexp_extract(h, r"""(?i)<link[^>]+rel=["']canonical["'][^>]*href=["'](https?://[^"']+)""", 1))),
        outside(found(F.regexp_extract(h, r"""(?i)<meta[^>]+property=["']og:url["'][^>]*content=["'](https?://[^"']+)""", 1))),
        outside(found(F.regexp_extract(h, r'"(?:mainEntityOfPage|url)"\s*:\s*"(https?://[^"]+)"', 1))),
        outside(found(F.regexp_extract(h, r"""(?i)data-(?:canonical-url|source-url|n-au)=["'](https?://[^"']+)""", 1))),
    )


def ranking_multiplier(url: Column, resolved: Column) -> Column:
    """A quarter for wrapper hosts, unless their publisher was found."""
    return F.when(is_wrapper(url) & ~F.coalesce(resolved, F.lit(False)), F.lit(0.25)).otherwise(F.lit(1.0))
