"""Date columns.  Nothing here reads a clock: ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Accepted formats, tried in order.
FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]'Z'", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd",
    "d MMM yyyy HH:mm:ss XX", "d MMM yyyy HH:mm:ss", "d MMM yyyy",
)

# Offsets of time zone abbreviations.
ZONES = {"GMT": "+0000", "UTC": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}

# Half-lives of freshness in hours.
HALF_LIFE = {
    "academic": 87600.0, "news": 48.0, "event": 24.0, "dataset": 43800.0, "book": 87600.0, "media": 8760.0,
    "geo": 87600.0, "knowledge": 43800.0, "podcast": 720.0, "code": 17520.0, "web": 720.0,
}
DEFAULT_HALF_LIFE = 720.0


def parse(text: Column) -> Column:
    """Timestamp of a date string in any of ``FORMATS``, else of a YYYY-MM-DD inside it; naive values are UTC."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")  # weekday
    names = "|".join(ZONES)
    offset = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])

    def of(t: Column) -> Column:
        inside = F.try_to_timestamp(F.nullif(F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd"))
        return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in FORMATS], inside)

    zone = F.regexp_extract(plain, rf"\s({names})$", 1)
    return let(F.when(zone == "", plain).otherwise(F.concat(F.regexp_replace(plain, rf"({names})$", ""), offset[zone])), of)


def month(text: Column) -> Column:
    """YYYY-MM of a date string, else 'unknown'."""
    return F.coalesce(F.date_format(parse(text), "yyyy-MM"), F.nullif(F.regexp_extract(text, r"(\d{4}-\d{2})", 1), F.lit("")), F.lit("unknown"))


def age_hours(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / 3.6e9


def recency_step(ts: Column, now: Column) -> Column:
    """1 within a day, 0.8 within a week, 0.5 within 30 days, else (or unknown) 0.2."""
    return let(age_hours(ts, now), lambda h: F.when(h < 24, 1.0).when(h < 168, 0.8).when(h < 720, 0.5).otherwise(0.2))


def freshness(ts: Column, content_type: Column, now: Column) -> Column:
    """Half for each half-life of the type; unknown 0.5, future 1."""
    life = F.coalesce(F.create_map(*[x for k, v in HALF_LIFE.items() for x in (F.lit(k), F.lit(v))])[content_type], F.lit(DEFAULT_HALF_LIFE))
    return let(age_hours(ts, now), lambda h: F.when(h.isNull(), 0.5).when(h < 0, 1.0).otherwise(F.pow(F.lit(0.5), h / life)))
