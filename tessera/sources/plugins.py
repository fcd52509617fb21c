"""Source plugins over landed payloads: one table of responses, one unified record shape.

A plugin is data: where a response keeps its records, and what each field of the
unified record is made of.  Responses are read as VARIANT with ``try_`` functions,
so what is broken or missing gives empty fields and an ``error``, not a failed
job.  ``spark.dataSource.register(LandedSource)`` offers the rows that a collector
has put in a folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import unescape_native
from ..operators.ingest import abstract_text


class Record:
    """A record as a VARIANT column: its fields by JSON path."""

    def __init__(self, v: Column):
        self.v = v

    def get(self, path: str, kind: str) -> Column:
        return F.try_variant_get(self.v, path, kind)

    def text(self, *paths: str) -> Column:
        """The first of the fields that is not empty, else ''."""
        return F.coalesce(*[F.nullif(self.get(p, "string"), F.lit("")) for p in paths], F.lit(""))

    def number(self, path: str) -> Column:
        return F.coalesce(self.get(path, "double"), F.lit(0.0))

    def whole(self, path: str) -> Column:
        return F.coalesce(self.get(path, "long"), F.lit(0))

    def strings(self, path: str, n: int) -> Column:
        return F.slice(F.coalesce(self.get(path, "array<string>"), F.array().cast("array<string>")), 1, n)

    def names(self, path: str, field: str, n: int) -> Column:
        """A field of the first ``n`` members of an array, without empty ones."""
        members = F.slice(F.coalesce(self.get(path, f"array<struct<`{field}`:string>>"), F.array().cast(f"array<struct<`{field}`:string>>")), 1, n)
        return F.filter(F.transform(members, lambda x: x[field]), lambda x: F.coalesce(x, F.lit("")) != "")


def joined(*parts: Column, by: str = " | ") -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), by)


def labelled(label: str, value: Column, tail: str = "") -> Column:
    """'label: value', or '' without a value."""
    return F.when(value == "", "").otherwise(F.concat(F.lit(f"{label}: "), value, F.lit(tail)))


def listed(values: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(values, 1, n), ", ")


def plain(text: Column, n: int | None = None) -> Column:
    """Without tags."""
    bare = F.trim(F.regexp_replace(text, "<[^>]+>", ""))
    return F.substring(bare, 1, n) if n else bare


def either(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def at(prefix: str, value: Column) -> Column:
    return F.when(value == "", "").otherwise(F.concat(F.lit(prefix), value))


def share(value: Column, of: float) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)) / of, F.lit(1.0))


Fields = dict[str, Column]


@dataclass(frozen=True)
class Plugin:
    name: str
    content_type: str
    #: Where a response keeps its records; a response without them is a record itself.
    records: str
    #: id, url, title and what else there is of snippet, content, timestamp, authority, lang.
    fields: Callable[[Record], Fields]
    #: Responses of XML are cut into their entries by this pattern.
    entries: str | None = None


# ------------------------------------------------------------------- providers
# Each provider's record paths, templates and authority formulas.
def _art_institute_chicago(r: Record) -> Fields:
    date = r.text("$.date_display")
    snippet = joined(F.split(r.text("$.artist_display"), "\n")[0], date, r.text("$.medium_display"))
    return dict(id=r.text("$.id"), url=F.concat(F.lit("https://www.artic.edu/artworks/"), r.text("$.id")), title=r.text("$.title"), snippet=snippet, timestamp=date, authority=F.lit(0.4))


def _arxiv(r: Record) -> Fields:
    entry = r.text("$")
    tag = lambda name: F.trim(F.regexp_replace(unescape_native(F.regexp_extract(entry, rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", 1)), r"\s+", " "))
    page = either(*[F.regexp_extract(entry, p, 1) for p in (r'<link\b[^>]*type="text/html"[^>]*href="([^"]*)"', r'<link\b[^>]*href="([^"]*)"[^>]*type="text/html"')], tag("id"))
    return dict(id=F.element_at(F.split(tag("id"), "/"), -1), url=page, title=tag("title"), snippet=tag("summary"), timestamp=tag("published"), authority=F.lit(0.5))


def _bitbucket(r: Record) -> Fields:
    name, full = r.text("$.name"), r.text("$.full_name", "$.name")
    text, language = plain(r.text("$.description"), 500), r.text("$.language")
    snippet = F.concat(either(text, F.concat(F.lit("Bitbucket repository "), full)), F.when(language != "", F.concat(F.lit(" [Language: "), language, F.lit("]"))).otherwise(""))
    authority = 0.5 + F.when(text != "", 0.1).otherwise(0.0) + F.when(language != "", 0.1).otherwise(0.0)
    return dict(id=either(r.text("$.uuid"), full), url=either(r.text("$.links.html.href"), F.concat(F.lit("https://bitbucket.org/"), full)), title=name, snippet=snippet, timestamp=r.text("$.updated_on", "$.created_on"), authority=authority)


def _core(r: Record) -> Fields:
    url = either(r.text("$.downloadUrl"), at("https://doi.org/", r.text("$.doi")), r.text("$.id"))
    return dict(id=r.text("$.id"), url=url, title=r.text("$.title"), snippet=F.substring(r.text("$.description", "$.abstract"), 1, 500), timestamp=r.text("$.yearPublished", "$.publishedDate"), authority=share(r.number("$.citationCount"), 200), lang=r.text("$.language"))


def _crossref(r: Record) -> Fields:
    date = F.array_join(F.coalesce(r.get("$.published['date-parts'][0]", "array<string>"), F.array().cast("array<string>")), "-")
    doi = r.text("$.DOI")
    return dict(id=doi, url=either(r.text("$.URL"), at("https://doi.org/", doi)), title=r.text("$.title[0]"), snippet=plain(r.text("$.abstract")), timestamp=date, authority=share(r.number("$['is-referenced-by-count']"), 300))


def _data_gov(r: Record) -> Fields:
    return dict(id=r.text("$.id"), url=F.concat(F.lit("https://catalog.data.gov/dataset/"), r.text("$.name")), title=r.text("$.title", "$.name"), snippet=plain(r.text("$.notes"), 500), timestamp=r.text("$.metadata_created"), authority=F.lit(0.4))


def _doaj(r: Record) -> Fields:
    year, month = r.text("$.bibjson.year"), r.text("$.bibjson.month")
    links = F.coalesce(r.get("$.bibjson.link", "array<struct<type:string,url:string>>"), F.array().cast("array<struct<type:string,url:string>>"))
    full = F.coalesce(F.get(F.filter(links, lambda x: x["type"] == "fulltext"), F.lit(0))["url"], F.lit(""))
    snippet = joined(labelled("Authors", listed(r.names("$.bibjson.author", "name", 1000), 3)), labelled("Journal", r.text("$.bibjson.journal.title")), labelled("Year", year))
    return dict(
        id=either(r.text("$.id"), r.text("$.bibjson.identifier.doi")), url=either(at("https://doaj.org/article/", r.text("$.id")), full), title=r.text("$.bibjson.title"), snippet=snippet,
        content=F.substring(r.text("$.bibjson.abstract"), 1, 500), timestamp=joined(year, month, by="-"), authority=F.lit(0.5),
    )


def _europe_pmc(r: Record) -> Fields:
    pmc, doi, pmid = r.text("$.pmcid"), r.text("$.doi"), r.text("$.pmid")
    url = either(at("https://europepmc.org/article/PMC/", pmc), at("https://doi.org/", doi), at("https://europepmc.org/article/MED/", pmid))
    return dict(id=either(pmc, pmid, doi), url=url, title=r.text("$.title"), snippet=r.text("$.abstractText"), timestamp=r.text("$.firstPublicationDate"), authority=share(r.number("$.citedByCount"), 200))


def _exa(r: Record) -> Fields:
    content, parts = r.text("$.text"), F.array_join(r.strings("$.highlights", 1000), "\n")
    return dict(id=r.text("$.id", "$.url", "$.title"), url=r.text("$.url"), title=r.text("$.title"), snippet=either(parts, F.substring(content, 1, 500)), content=either(content, parts), timestamp=r.text("$.published_date"), authority=share(r.number("$.score"), 1))


def _firecrawl(r: Record) -> Fields:
    content, image = r.text("$.markdown", "$.html"), r.text("$.image", "$.thumbnail")
    url, title = r.text("$.url", "$.link"), r.text("$.title", "$.name")
    return dict(id=either(url, title), url=either(url, image), title=title, snippet=either(r.text("$.description", "$.summary"), F.substring(content, 1, 500)), content=content, content_type=F.when(image != "", "media").otherwise("web"))


def _gdelt(r: Record) -> Fields:
    url, title, seen = r.text("$.url"), r.text("$.title"), r.text("$.seendate")
    own = F.concat(F.lit("gdelt-"), seen, F.lit("-"), F.substring(title, 1, 20))
    return dict(id=either(url, own), url=url, title=title, snippet=either(title, F.concat(F.lit("News article from "), r.text("$.domain"))), timestamp=seen, authority=F.lit(0.3), lang=r.text("$.language"))


def _gitlab(r: Record) -> Fields:
    full = r.text("$.path_with_namespace", "$.name")
    counts = F.concat(F.lit("GitLab project "), full, F.lit(" — "), r.whole("$.star_count").cast("string"), F.lit(" stars, "), r.whole("$.forks_count").cast("string"), F.lit(" forks"))
    return dict(
        id=r.text("$.id"), url=either(r.text("$.web_url"), F.concat(F.lit("https://gitlab.com/"), full)), title=r.text("$.name", "$.path_with_namespace"),
        snippet=either(F.substring(F.trim(r.text("$.description")), 1, 500), counts), timestamp=r.text("$.last_activity_at", "$.created_at"), authority=share(r.number("$.star_count"), 500),
    )


def _gutenberg(r: Record) -> Fields:
    snippet = F.concat(labelled("Authors", listed(r.names("$.authors", "name", 5))), at(" | Subjects: ", listed(r.strings("$.subjects", 3))))
    return dict(id=r.text("$.id"), url=F.concat(F.lit("https://www.gutenberg.org/ebooks/"), r.text("$.id")), title=r.text("$.title"), snippet=snippet, authority=share(r.number("$.download_count"), 10000))


def _hackernews(r: Record) -> Fields:
    item = r.text("$.objectID")
    counts = F.concat(F.lit("Points: "), r.whole("$.points").cast("string"), F.lit(" | Comments: "), r.whole("$.num_comments").cast("string"), F.lit(" | Author: "), r.text("$.author"))
    story = r.text("$.story_text")
    return dict(id=item, url=either(r.text("$.url"), F.concat(F.lit("https://news.ycombinator.com/item?id="), item)), title=r.text("$.title", "$.story_title"), snippet=F.when(story != "", plain(story, 300)).otherwise(counts), timestamp=r.text("$.created_at"), authority=share(r.number("$.points"), 500))


def _huggingface(r: Record) -> Fields:
    name = r.text("$.id")
    snippet = either(F.substring(r.text("$.cardData.description", "$.description"), 1, 500), F.concat(F.lit("Dataset "), name))
    return dict(id=name, url=F.concat(F.lit("https://huggingface.co/datasets/"), name), title=name, snippet=snippet, timestamp=r.text("$.lastModified"), authority=F.least(r.number("$.downloads") / 100000 + r.number("$.likes") / 1000, F.lit(1.0)))


def _internet_archive(r: Record) -> Fields:
    item = r.text("$.identifier")
    first = lambda name: F.when(F.schema_of_variant(r.get(f"$.{name}", "variant")).startswith("ARRAY"), r.text(f"$.{name}[0]")).otherwise(r.text(f"$.{name}"))
    one_language = F.when(~F.schema_of_variant(r.get("$.language", "variant")).startswith("ARRAY"), r.text("$.language")).otherwise("")
    return dict(id=item, url=F.concat(F.lit("https://archive.org/details/"), item), title=first("title"), snippet=plain(first("description"), 500), timestamp=r.text("$.date"), authority=share(r.number("$.downloads"), 5000), lang=one_language)


def _jikan(r: Record) -> Fields:
    episodes, score = r.whole("$.episodes"), r.number("$.score")
    snippet = joined(r.text("$.type"), F.when(episodes > 0, F.concat(episodes.cast("string"), F.lit(" eps"))).otherwise(""), F.when(score > 0, F.concat(F.lit("Score: "), r.text("$.score"))).otherwise(""), r.text("$.status"))
    return dict(id=r.text("$.mal_id"), url=r.text("$.url"), title=r.text("$.title", "$.title_english"), snippet=snippet, content=F.substring(r.text("$.synopsis"), 1, 500), timestamp=r.text("$.year"), authority=share(score, 10))


def _listennotes(r: Record) -> Fields:
    title, show = r.text("$.title_original", "$.title"), r.text("$.podcast_title_original", "$.podcast_title")
    return dict(id=r.text("$.id"), url=r.text("$.link", "$.audio"), title=F.when(show != "", F.concat(title, F.lit(" — "), show)).otherwise(title), snippet=plain(r.text("$.description_original", "$.description"), 500), timestamp=r.text("$.pub_date_ms"), authority=F.lit(0.4))


def _met_museum(r: Record) -> Fields:
    date = r.text("$.objectDate")
    snippet = joined(r.text("$.artistDisplayName"), date, r.text("$.medium"), r.text("$.department"))
    return dict(id=r.text("$.objectID"), url=r.text("$.objectURL"), title=r.text("$.title"), snippet=snippet, timestamp=date, authority=F.lit(0.4))


def _musicbrainz(r: Record) -> Fields:
    length = r.whole("$.length")
    seconds = F.when(length > 0, F.concat(F.lit(" | Length: "), F.floor(length / 1000).cast("string"), F.lit("s"))).otherwise("")
    snippet = F.concat(labelled("Artists", listed(r.names("$['artist-credit']", "name", 1000), 1000)), at(" | Releases: ", listed(r.names("$.releases", "title", 3), 2)), seconds)
    return dict(id=r.text("$.id"), url=F.concat(F.lit("https://musicbrainz.org/recording/"), r.text("$.id")), title=r.text("$.title"), snippet=snippet, timestamp=r.text("$['first-release-date']"), authority=F.lit(0.3))


def _open_fda(r: Record) -> Fields:
    drugs, reactions = r.names("$.patient.drug", "medicinalproduct", 3), r.names("$.patient.reaction", "reactionmeddrapt", 5)
    sex = F.coalesce(F.element_at(F.array(F.lit("unknown"), F.lit("male"), F.lit("female")), F.nullif(F.least(r.whole("$.patient.patientsex"), F.lit(3)) + 1, F.lit(4)).cast("int")), F.lit("unknown"))
    snippet = joined(labelled("Drugs", listed(drugs, 3)), labelled("Reactions", listed(reactions, 3)), labelled("Age", r.text("$.patient.patientonsetage")), labelled("Sex", sex))
    return dict(id=r.text("$.safetyreportid"), url=F.lit("https://open.fda.gov/data/faers/"), title=F.concat(F.lit("FDA Adverse Event: "), listed(drugs, 2)), snippet=snippet, timestamp=r.text("$.receivedate"), authority=F.lit(0.6))


def _open_food_facts(r: Record) -> Fields:
    code, name, made_of = r.text("$.code"), r.text("$.product_name", "$.generic_name"), r.text("$.ingredients_text")
    energy = r.text("$.nutriments['energy-kcal_100g']", "$.nutriments.energy_100g")
    snippet = joined(labelled("Brand", r.text("$.brands")), labelled("Quantity", r.text("$.quantity")), labelled("Energy", F.when(energy == "0", "").otherwise(energy), " kcal/100g"))
    content = F.when(F.length(made_of) > 300, F.concat(F.substring(made_of, 1, 300), F.lit("..."))).otherwise(made_of)
    return dict(id=either(code, name), url=at("https://world.openfoodfacts.org/product/", code), title=name, snippet=snippet, content=content, authority=F.lit(0.3))


def _open_library(r: Record) -> Fields:
    snippet = F.concat(labelled("Authors", listed(r.strings("$.author_name", 5))), at(" | Subjects: ", listed(r.strings("$.subject", 5))))
    return dict(id=r.text("$.key"), url=at("https://openlibrary.org", r.text("$.key")), title=r.text("$.title"), snippet=snippet, timestamp=r.text("$.first_publish_year"), authority=share(r.number("$.edition_count"), 50))


def _open_meteo(r: Record) -> Fields:
    """A place with the ``current`` part of its forecast, as the collector lands them."""
    now = lambda name: either(r.text(f"$.current.{name}"), F.lit("0"))
    weather = F.concat(F.lit("Current: "), now("temperature_2m"), F.lit("°C (feels like "), now("apparent_temperature"), F.lit("°C) | Humidity: "), now("relative_humidity_2m"), F.lit("% | Wind: "), now("wind_speed_10m"), F.lit(" km/h"))
    url = F.concat(F.lit("https://open-meteo.com/en/docs?latitude="), either(r.text("$.latitude"), F.lit("0")), F.lit("&longitude="), either(r.text("$.longitude"), F.lit("0")))
    return dict(id=r.text("$.id"), url=url, title=F.concat(F.lit("Weather: "), joined(r.text("$.name"), r.text("$.admin1"), r.text("$.country"), by=", ")), snippet=weather, timestamp=r.text("$.current.time"), authority=F.lit(0.5))


def _openalex(r: Record) -> Fields:
    own, doi = r.text("$.id"), r.text("$.doi")
    link = either(doi, F.replace(own, F.lit("https://openalex.org/"), F.lit("https://doi.org/")))
    url = F.when(link.startswith("http"), link).when(doi != "", F.concat(F.lit("https://doi.org/"), link)).otherwise(own)
    abstract = F.coalesce(abstract_text(r.get("$.abstract_inverted_index", "map<string,array<int>>")), F.lit(""))
    title = r.text("$.title", "$.display_name")
    return dict(id=either(F.element_at(F.split(own, "/"), -1), doi), url=url, title=title, snippet=either(abstract, r.text("$.title")), timestamp=r.text("$.publication_date"), authority=share(r.number("$.cited_by_count"), 500), lang=r.text("$.language"))


def _openstreetmap(r: Record) -> Fields:
    lat, lon, shown = r.text("$.lat"), r.text("$.lon"), r.text("$.display_name")
    where = F.concat(F.lit("https://www.openstreetmap.org/?mlat="), lat, F.lit("&mlon="), lon, F.lit("#map=18/"), lat, F.lit("/"), lon)
    kind = r.text("$.osm_type")
    letter = F.when(kind == "node", "N").when(kind == "way", "W").when(kind == "relation", "R")
    own = F.coalesce(F.concat(letter, r.text("$.osm_id")), r.text("$.place_id", "$.osm_id"))
    return dict(id=own, url=F.when((lat != "") & (lon != ""), where).otherwise(""), title=either(r.text("$.name"), F.split(shown, ",")[0]), snippet=shown, authority=F.least(r.number("$.importance"), F.lit(1.0)))


def _semantic_scholar(r: Record) -> Fields:
    authority = F.least((r.number("$.citationCount") + 2 * r.number("$.influentialCitationCount")) / 300, F.lit(1.0))
    return dict(id=r.text("$.paperId"), url=either(r.text("$.url"), at("https://doi.org/", r.text("$.externalIds.DOI"))), title=r.text("$.title"), snippet=r.text("$.abstract", "$.tldr.text"), timestamp=r.text("$.publicationDate", "$.year"), authority=authority)


def _spaceflight_news(r: Record) -> Fields:
    return dict(id=r.text("$.id"), url=r.text("$.url"), title=r.text("$.title"), snippet=F.substring(r.text("$.summary"), 1, 500), timestamp=r.text("$.published_at"), authority=F.lit(0.4))


def _stackexchange(r: Record) -> Fields:
    counts = F.concat(F.lit("Score: "), r.whole("$.score").cast("string"), F.lit(" | Answers: "), r.whole("$.answer_count").cast("string"), F.lit(" | Views: "), r.whole("$.view_count").cast("string"))
    date = either(r.text("$.creation_date"), F.lit("0"))
    return dict(id=r.text("$.question_id"), url=r.text("$.link"), title=r.text("$.title"), snippet=either(plain(r.text("$.body"), 500), counts), timestamp=date, authority=share(r.number("$.score"), 100))


def _tavily(r: Record) -> Fields:
    content, image = r.text("$.content"), r.get("$._is_image", "boolean")
    about, url = r.text("$.description"), r.text("$.url")
    pick = lambda of_image, of_page: F.when(image, of_image).otherwise(of_page)
    return dict(
        id=pick(url, either(url, r.text("$.title"))), url=url, title=pick(either(about, F.lit("Tavily image result")), r.text("$.title")), snippet=pick(about, either(r.text("$.raw_content"), F.substring(content, 1, 500))),
        content=pick(about, either(content, r.text("$._answer"))), content_type=F.when(image, "media").otherwise("web"), authority=pick(F.lit(0.0), share(r.number("$.score"), 10)),
    )


def _unpaywall(r: Record) -> Fields:
    field = lambda name: r.text(f"$.response.{name}", f"$.{name}")
    doi, is_open = field("doi"), F.coalesce(r.get("$.response.is_oa", "boolean"), r.get("$.is_oa", "boolean"), F.lit(False))
    url = F.when(doi != "", either(field("best_oa_location.url_for_pdf"), field("best_oa_location.url"), F.concat(F.lit("https://doi.org/"), doi))).otherwise("")
    status = F.concat(F.lit("Open access article (status: "), field("oa_status"), F.lit(")"))
    return dict(id=doi, url=url, title=either(field("title"), field("title_")), snippet=either(field("abstract"), status), timestamp=field("published_date"), authority=F.when(is_open, 0.6).otherwise(0.3))


def _usgs_earthquakes(r: Record) -> Fields:
    p = lambda name: r.text(f"$.properties.{name}")
    snippet = F.concat(F.lit("Magnitude: "), either(p("mag"), F.lit("0")), F.lit(" | Location: "), p("place"), F.lit(" | Tsunami: "), F.when(r.number("$.properties.tsunami") != 0, "Yes").otherwise("No"), at(" | Alert: ", p("alert")))
    return dict(id=r.text("$.id"), url=p("url"), title=p("title"), snippet=snippet, timestamp=either(p("time"), F.lit("0")), authority=share(r.number("$.properties.mag"), 10))


def _wikidata(r: Record) -> Fields:
    return dict(id=r.text("$.id"), url=F.concat(F.lit("https://www.wikidata.org/wiki/"), r.text("$.id")), title=r.text("$.label"), snippet=r.text("$.description"), authority=F.lit(0.6))


def _zenodo(r: Record) -> Fields:
    files = F.coalesce(r.get("$.files", "array<struct<downloads:double>>"), F.array().cast("array<struct<downloads:double>>"))
    downloads = F.aggregate(files, F.lit(0.0), lambda a, x: a + F.coalesce(x["downloads"], F.lit(0.0)))
    return dict(id=r.text("$.id"), url=F.concat(F.lit("https://zenodo.org/records/"), r.text("$.id")), title=r.text("$.metadata.title"), snippet=plain(r.text("$.metadata.description"), 500), timestamp=r.text("$.metadata.publication_date"), authority=share(downloads, 1000))


PLUGINS: tuple[Plugin, ...] = (
    Plugin("art_institute_chicago", "media", "$.data", _art_institute_chicago),
    Plugin("arxiv", "academic", "$", _arxiv, entries=r"(?s)(<entry\b.*?</entry>)"),
    Plugin("bitbucket", "code", "$.values", _bitbucket),
    Plugin("core", "academic", "$.data", _core),
    Plugin("crossref", "academic", "$.message.items", _crossref),
    Plugin("data_gov", "dataset", "$.result.results", _data_gov),
    Plugin("doaj", "academic", "$.results", _doaj),
    Plugin("europe_pmc", "academic", "$.resultList.results", _europe_pmc),
    Plugin("exa", "web", "$.results", _exa),
    Plugin("firecrawl", "web", "$.data", _firecrawl),
    Plugin("gdelt", "event", "$.articles", _gdelt),
    Plugin("gitlab", "code", "$", _gitlab),
    Plugin("gutenberg", "book", "$.results", _gutenberg),
    Plugin("hackernews", "event", "$.hits", _hackernews),
    Plugin("huggingface", "dataset", "$", _huggingface),
    Plugin("internet_archive", "media", "$.response.docs", _internet_archive),
    Plugin("jikan", "media", "$.data", _jikan),
    Plugin("listennotes", "podcast", "$.results", _listennotes),
    Plugin("met_museum", "media", "$", _met_museum),
    Plugin("musicbrainz", "media", "$.recordings", _musicbrainz),
    Plugin("open_fda", "knowledge", "$.results", _open_fda),
    Plugin("open_food_facts", "knowledge", "$.products", _open_food_facts),
    Plugin("open_library", "book", "$.docs", _open_library),
    Plugin("open_meteo", "geo", "$.results", _open_meteo),
    Plugin("openalex", "academic", "$.results", _openalex),
    Plugin("openstreetmap", "geo", "$", _openstreetmap),
    Plugin("semantic_scholar", "academic", "$.data", _semantic_scholar),
    Plugin("spaceflight_news", "event", "$.results", _spaceflight_news),
    Plugin("stackexchange", "knowledge", "$.items", _stackexchange),
    Plugin("tavily", "web", "$.results", _tavily),
    Plugin("unpaywall", "academic", "$.results", _unpaywall),
    Plugin("usgs_earthquakes", "event", "$.features", _usgs_earthquakes),
    Plugin("wikidata", "knowledge", "$.search", _wikidata),
    Plugin("zenodo", "dataset", "$.hits.hits", _zenodo),
)
REGISTRY = {p.name: p for p in PLUGINS}


def register(plugin: Plugin) -> None:
    """Add or replace a source."""
    REGISTRY[plugin.name] = plugin


def listing(spark: SparkSession, configured: tuple[str, ...] = ()) -> DataFrame:
    """(source, content_type, configured) of the registry."""
    return spark.createDataFrame([(p.name, p.content_type, p.name in configured) for p in sorted(REGISTRY.values(), key=lambda p: p.name)], "source string, content_type string, configured boolean")


def records(landed: DataFrame, source: str = "source", payload: str = "payload", names: list[str] | None = None) -> DataFrame:
    """``landed`` without its payload, and ``record``: one row for each record of a response; null where a response is unreadable."""
    parsed = landed.where(F.col(source).isin(*(names or sorted(REGISTRY)))).withColumn("__v", F.try_parse_json(payload))
    found = F
    for plugin in (REGISTRY[n] for n in names or sorted(REGISTRY)):
        if plugin.entries:
            own = F.transform(F.regexp_extract_all(F.coalesce(F.col(payload), F.lit("")), F.lit(plugin.entries), F.lit(1)), lambda x: x.cast("variant"))
        else:
            own = F.coalesce(F.try_variant_get("__v", plugin.records, "array<variant>"), F.filter(F.array("__v"), lambda x: x.isNotNull()))
        found = found.when(F.col(source) == plugin.name, own)
    return parsed.select(*[c for c in landed.columns if c != payload], F.explode_outer(found).alias("record"))


def search_all(landed: DataFrame, source: str = "source", payload: str = "payload", names: list[str] | None = None) -> DataFrame:
    """Unified records of all (or the named) sources of one landed table, in one pass over it.

    A payload is a response or a single record; one that cannot be read gives a row
    with ``error`` set, and records with neither URL nor title give none.
    """
    rows = records(landed, source, payload, names)

    def unified(plugin: Plugin) -> Column:
        f = {"snippet": F.lit(""), "content": F.lit(""), "timestamp": F.lit(""), "authority": F.lit(0.0), "lang": F.lit("en"), "content_type": F.lit(plugin.content_type)} | plugin.fields(Record(F.col("record")))
        trimmed = {name: F.trim(f[name]) if name in ("title", "snippet") else f[name] for name in ("id", "url", "title", "snippet", "content", "content_type", "timestamp")}
        return F.struct(*[c.alias(name) for name, c in trimmed.items()], f["authority"].cast("double").alias("authority_score"), F.coalesce(F.nullif(f["lang"], F.lit("")), F.lit("en")).alias("lang"))

    chosen = F
    for name in names or sorted(REGISTRY):
        chosen = chosen.when(F.col(source) == name, unified(REGISTRY[name]))
    # explode of one element keeps the optimizer from repeating the choice for each field
    each = rows.select("*", F.explode(F.array(F.when(F.col("record").isNotNull(), chosen))).alias("__r"))
    named = each.select(*[c for c in rows.columns if c != "record"], "__r.*", F.when(F.col("record").isNull(), "unreadable payload").alias("error"))
    return named.where(F.col("error").isNotNull() | (F.coalesce("url", F.lit("")) != "") | (F.coalesce("title", F.lit("")) != ""))


def normalize(raw: DataFrame, plugin: Plugin, payload: str = "payload") -> DataFrame:
    """Unified records of one source's payloads."""
    return search_all(raw.withColumn("source", F.lit(plugin.name)), payload=payload, names=[plugin.name])


def unknown(requested: DataFrame, spark: SparkSession) -> DataFrame:
    """Requested names that no plugin has."""
    return requested.join(F.broadcast(listing(spark).select("source")), "source", "left_anti")  # the registry is some dozens of names


def merge_engines(results: DataFrame, *, engine_order: str = "engine_ord", pos: str = "pos", url: str = "url") -> DataFrame:
    """Results of several engines in order of request, first wins by URL without its trailing slash."""
    from ..operators.dedup import first_wins, url_key

    return first_wins(results, url_key(F.col(url)), engine_order, pos)


def relaxation(attempts: DataFrame, attempt: str = "attempt") -> DataFrame:
    """Search options by attempt: backends take turns, filters go from the second on, safe search from the third."""
    a = F.col(attempt)
    return attempts.withColumns(
        {
            "backend": F.element_at(F.array(F.lit("auto"), F.lit("html"), F.lit("lite")), (F.pmod(a, F.lit(3)) + 1).cast("int")),
            "timelimit": F.when(a < 1, F.lit("set")),
            "filters": F.when(a < 1, F.lit("set")),
            "safesearch": F.when(a < 2, "moderate").otherwise("off"),
        }
    )
