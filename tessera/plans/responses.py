"""One made-up response of each provider, and the records it holds: (id, url, title, snippet, content, content type, timestamp, authority, lang)."""

from __future__ import annotations

import json

_ARXIV = """<feed xmlns="http://www.w3.org/2005/Atom"><title>all</title>
<entry><id>http://arxiv.org/abs/2101.00001v2</id><updated>2021-02-01T00:00:00Z</updated><published>2021-01-01T00:00:00Z</published>
<title>On  Tides
 and Rocks</title><summary> We measure
 tides &amp; rocks. </summary><author><name>A. B</name></author>
<link href="https://arxiv.org/abs/2101.00001v2" rel="alternate" type="text/html"/><link title="pdf" href="https://arxiv.org/pdf/2101.00001v2" type="application/pdf"/></entry>
<entry><id>http://arxiv.org/abs/hep/9</id><title>No link</title><summary>s</summary></entry></feed>"""

RESPONSES: dict[str, tuple[object, list[tuple]]] = {
    "art_institute_chicago": (
        {"data": [{"id": 27, "title": "Bay", "artist_display": "A. Painter\nFrench, 1840", "date_display": "1877", "medium_display": "Oil", "image_id": "x"}, {"id": 28, "title": "Untitled"}]},
        [("27", "https://www.artic.edu/artworks/27", "Bay", "A. Painter | 1877 | Oil", "", "media", "1877", 0.4, "en"), ("28", "https://www.artic.edu/artworks/28", "Untitled", "", "", "media", "", 0.4, "en")],
    ),
    "arxiv": (
        _ARXIV,
        [("2101.00001v2", "https://arxiv.org/abs/2101.00001v2", "On Tides and Rocks", "We measure tides & rocks.", "", "academic", "2021-01-01T00:00:00Z", 0.5, "en"), ("9", "http://arxiv.org/abs/hep/9", "No link", "s", "", "academic", "", 0.5, "en")],
    ),
    "bitbucket": (
        {"values": [{"uuid": "{u}", "name": "pump", "full_name": "w/pump", "description": "<b>A pump</b>", "language": "python", "links": {"html": {"href": "https://bitbucket.org/w/pump"}}, "updated_on": "2024-01-02"}, {"name": "bare", "full_name": "w/bare", "created_on": "2023-05-05"}]},
        [("{u}", "https://bitbucket.org/w/pump", "pump", "A pump [Language: python]", "", "code", "2024-01-02", 0.7, "en"), ("w/bare", "https://bitbucket.org/w/bare", "bare", "Bitbucket repository w/bare", "", "code", "2023-05-05", 0.5, "en")],
    ),
    "core": (
        {"data": [{"id": 5, "title": "Core paper", "doi": "10.1/c", "abstract": "An abstract", "citationCount": 50, "yearPublished": "2019", "language": "fr"}]},
        [("5", "https://doi.org/10.1/c", "Core paper", "An abstract", "", "academic", "2019", 0.25, "fr")],
    ),
    "crossref": (
        {"message": {"items": [{"DOI": "10.2/x", "title": ["Cross"], "abstract": "<jats:p>Text</jats:p>", "is-referenced-by-count": 600, "published": {"date-parts": [[2020, 3, 1]]}}, {"title": [], "URL": "https://x.example/2"}]}},
        [("10.2/x", "https://doi.org/10.2/x", "Cross", "Text", "", "academic", "2020-3-1", 1.0, "en"), ("", "https://x.example/2", "", "", "", "academic", "", 0.0, "en")],
    ),
    "data_gov": (
        {"result": {"results": [{"id": "d1", "name": "water-levels", "title": "Water levels", "notes": "<p>Daily <i>levels</i></p>", "metadata_created": "2018-01-01"}]}},
        [("d1", "https://catalog.data.gov/dataset/water-levels", "Water levels", "Daily levels", "", "dataset", "2018-01-01", 0.4, "en")],
    ),
    "doaj": (
        {"results": [{"id": "a1", "bibjson": {"title": "Open", "abstract": "Abs", "year": "2021", "month": "7", "author": [{"name": "A"}, {"name": "B"}, {"name": "C"}, {"name": "D"}], "journal": {"title": "J"}}}, {"bibjson": {"title": "By DOI", "identifier": {"doi": "10.3/d"}, "link": [{"type": "other", "url": "u0"}, {"type": "fulltext", "url": "https://f.example/p.pdf"}]}}]},
        [("a1", "https://doaj.org/article/a1", "Open", "Authors: A, B, C | Journal: J | Year: 2021", "Abs", "academic", "2021-7", 0.5, "en"), ("10.3/d", "https://f.example/p.pdf", "By DOI", "", "", "academic", "", 0.5, "en")],
    ),
    "europe_pmc": (
        {"resultList": {"results": [{"pmcid": "PMC1", "pmid": "9", "title": "Cells", "abstractText": "On cells", "citedByCount": 20, "firstPublicationDate": "2017-02-03"}, {"pmid": "10", "title": "Only a number"}]}},
        [("PMC1", "https://europepmc.org/article/PMC/PMC1", "Cells", "On cells", "", "academic", "2017-02-03", 0.1, "en"), ("10", "https://europepmc.org/article/MED/10", "Only a number", "", "", "academic", "", 0.0, "en")],
    ),
    "exa": (
        {"results": [{"id": "e1", "url": "https://e.example/1", "title": "Exact", "text": "Long text", "highlights": ["one", "two"], "score": 0.75, "published_date": "2024-02-02"}, {"url": "", "title": ""}]},
        [("e1", "https://e.example/1", "Exact", "one\ntwo", "Long text", "web", "2024-02-02", 0.75, "en")],
    ),
    "firecrawl": (
        {"data": [{"link": "https://f.example/1", "name": "Fire", "markdown": "# Body", "summary": "Sum"}, {"title": "Shot", "image": "https://f.example/i.png"}]},
        [("https://f.example/1", "https://f.example/1", "Fire", "Sum", "# Body", "web", "", 0.0, "en"), ("Shot", "https://f.example/i.png", "Shot", "", "", "media", "", 0.0, "en")],
    ),
    "gdelt": (
        {"articles": [{"url": "https://g.example/a", "title": "Flood", "domain": "g.example", "language": "German", "seendate": "20240101T000000Z"}, {"title": "No address for this one here", "seendate": "2024"}]},
        [("https://g.example/a", "https://g.example/a", "Flood", "Flood", "", "event", "20240101T000000Z", 0.3, "German"), ("gdelt-2024-No address for this ", "", "No address for this one here", "No address for this one here", "", "event", "2024", 0.3, "en")],
    ),
    "gitlab": (
        [{"id": 3, "name": "tool", "path_with_namespace": "g/tool", "star_count": 125, "forks_count": 4, "last_activity_at": "2024-03-03"}, {"id": 4, "name": "other", "path_with_namespace": "g/other", "web_url": "https://gitlab.example/g/other", "description": " Described "}],
        [("3", "https://gitlab.com/g/tool", "tool", "GitLab project g/tool — 125 stars, 4 forks", "", "code", "2024-03-03", 0.25, "en"), ("4", "https://gitlab.example/g/other", "other", "Described", "", "code", "", 0.0, "en")],
    ),
    "gutenberg": (
        {"results": [{"id": 84, "title": "Monster", "authors": [{"name": "S, M"}], "subjects": ["A", "B", "C", "D"], "download_count": 2500}]},
        [("84", "https://www.gutenberg.org/ebooks/84", "Monster", "Authors: S, M | Subjects: A, B, C", "", "book", "", 0.25, "en")],
    ),
    "hackernews": (
        {"hits": [{"objectID": "11", "title": "Show", "points": 250, "num_comments": 7, "author": "pg", "created_at": "2024-01-01"}, {"objectID": "12", "story_title": "Ask", "url": "https://h.example", "story_text": "<p>Why?</p>"}]},
        [("11", "https://news.ycombinator.com/item?id=11", "Show", "Points: 250 | Comments: 7 | Author: pg", "", "event", "2024-01-01", 0.5, "en"), ("12", "https://h.example", "Ask", "Why?", "", "event", "", 0.0, "en")],
    ),
    "huggingface": (
        [{"id": "org/set", "downloads": 20000, "likes": 100, "cardData": {"description": "Card"}, "lastModified": "2024-01-05"}, {"id": "org/none"}],
        [("org/set", "https://huggingface.co/datasets/org/set", "org/set", "Card", "", "dataset", "2024-01-05", 0.3, "en"), ("org/none", "https://huggingface.co/datasets/org/none", "org/none", "Dataset org/none", "", "dataset", "", 0.0, "en")],
    ),
    "internet_archive": (
        {"response": {"docs": [{"identifier": "film1", "title": ["Film", "Alt"], "description": ["<b>Old</b> film", "x"], "downloads": 500, "date": "1930", "language": ["eng", "fre"]}, {"identifier": "t2", "title": "Talk", "description": "Plain", "language": "ger"}]}},
        [("film1", "https://archive.org/details/film1", "Film", "Old film", "", "media", "1930", 0.1, "en"), ("t2", "https://archive.org/details/t2", "Talk", "Plain", "", "media", "", 0.0, "ger")],
    ),
    "jikan": (
        {"data": [{"mal_id": 1, "url": "https://m.example/1", "title": "Bebop", "type": "TV", "episodes": 26, "score": 8.5, "status": "Finished", "synopsis": "Space", "year": 1998}]},
        [("1", "https://m.example/1", "Bebop", "TV | 26 eps | Score: 8.5 | Finished", "Space", "media", "1998", 0.85, "en")],
    ),
    "listennotes": (
        {"results": [{"id": "l1", "title_original": "Ep 1", "podcast_title_original": "Cast", "audio": "https://l.example/a.mp3", "description_original": "<p>On it</p>", "pub_date_ms": 1700000000000}]},
        [("l1", "https://l.example/a.mp3", "Ep 1 — Cast", "On it", "", "podcast", "1700000000000", 0.4, "en")],
    ),
    "met_museum": (
        {"objectID": 45, "title": "Vase", "artistDisplayName": "Potter", "objectDate": "1900", "medium": "Clay", "department": "Art", "objectURL": "https://met.example/45"},
        [("45", "https://met.example/45", "Vase", "Potter | 1900 | Clay | Art", "", "media", "1900", 0.4, "en")],
    ),
    "musicbrainz": (
        {"recordings": [{"id": "r1", "title": "Song", "length": 215999, "artist-credit": [{"name": "X"}, {"name": "Y"}], "releases": [{"title": "LP"}, {"title": "EP"}, {"title": "CD"}], "first-release-date": "1999-09"}]},
        [("r1", "https://musicbrainz.org/recording/r1", "Song", "Artists: X, Y | Releases: LP, EP | Length: 215s", "", "media", "1999-09", 0.3, "en")],
    ),
    "open_fda": (
        {"results": [{"safetyreportid": "77", "receivedate": "20200101", "patient": {"patientonsetage": "44", "patientsex": "2", "drug": [{"medicinalproduct": "P"}, {"medicinalproduct": "Q"}, {"medicinalproduct": "R"}], "reaction": [{"reactionmeddrapt": "Rash"}, {}]}}]},
        [("77", "https://open.fda.gov/data/faers/", "FDA Adverse Event: P, Q", "Drugs: P, Q, R | Reactions: Rash | Age: 44 | Sex: female", "", "knowledge", "20200101", 0.6, "en")],
    ),
    "open_food_facts": (
        {"products": [{"code": "301", "product_name": "Spread", "brands": "N", "quantity": "400 g", "nutriments": {"energy-kcal_100g": 539}, "ingredients_text": "Sugar"}, {"generic_name": "Loose"}]},
        [("301", "https://world.openfoodfacts.org/product/301", "Spread", "Brand: N | Quantity: 400 g | Energy: 539 kcal/100g", "Sugar", "knowledge", "", 0.3, "en"), ("Loose", "", "Loose", "", "", "knowledge", "", 0.3, "en")],
    ),
    "open_library": (
        {"docs": [{"key": "/works/OL1W", "title": "Ring", "author_name": ["T"], "subject": ["Fantasy", "Elves"], "edition_count": 10, "first_publish_year": 1954}]},
        [("/works/OL1W", "https://openlibrary.org/works/OL1W", "Ring", "Authors: T | Subjects: Fantasy, Elves", "", "book", "1954", 0.2, "en")],
    ),
    "open_meteo": (
        {"results": [{"id": 2950159, "name": "Berlin", "admin1": "Land Berlin", "country": "Germany", "latitude": 52.5, "longitude": 13.25, "current": {"time": "2024-01-01T00:00", "temperature_2m": 3.5, "apparent_temperature": 1, "relative_humidity_2m": 80, "wind_speed_10m": 12.25}}]},
        [("2950159", "https://open-meteo.com/en/docs?latitude=52.5&longitude=13.25", "Weather: Berlin, Land Berlin, Germany", "Current: 3.5°C (feels like 1°C) | Humidity: 80% | Wind: 12.25 km/h", "", "geo", "2024-01-01T00:00", 0.5, "en")],
    ),
    "openalex": (
        {"results": [{"id": "https://openalex.org/W1", "doi": "https://doi.org/10.5/w", "title": "Works", "abstract_inverted_index": {"of": [1], "All": [0], "it": [2]}, "cited_by_count": 125, "publication_date": "2016-06-06", "language": "de"}, {"id": "https://openalex.org/W2", "display_name": "Shown"}]},
        [("W1", "https://doi.org/10.5/w", "Works", "All of it", "", "academic", "2016-06-06", 0.25, "de"), ("W2", "https://doi.org/W2", "Shown", "", "", "academic", "", 0.0, "en")],
    ),
    "openstreetmap": (
        [{"osm_id": 240109189, "osm_type": "node", "lat": "52.5", "lon": "13.3", "display_name": "Berlin, Germany", "importance": 0.82}, {"osm_id": 6, "place_id": 99, "name": "Nowhere", "display_name": "Nowhere, Sea"}],
        [("N240109189", "https://www.openstreetmap.org/?mlat=52.5&mlon=13.3#map=18/52.5/13.3", "Berlin", "Berlin, Germany", "", "geo", "", 0.82, "en"), ("99", "", "Nowhere", "Nowhere, Sea", "", "geo", "", 0.0, "en")],
    ),
    "semantic_scholar": (
        {"data": [{"paperId": "p1", "title": "Scholar", "tldr": {"text": "Short"}, "citationCount": 60, "influentialCitationCount": 15, "externalIds": {"DOI": "10.6/s"}, "year": 2015}]},
        [("p1", "https://doi.org/10.6/s", "Scholar", "Short", "", "academic", "2015", 0.3, "en")],
    ),
    "spaceflight_news": (
        {"results": [{"id": 8, "url": "https://s.example/8", "title": "Lift-off", "summary": "It flew.", "published_at": "2024-04-04"}]},
        [("8", "https://s.example/8", "Lift-off", "It flew.", "", "event", "2024-04-04", 0.4, "en")],
    ),
    "stackexchange": (
        {"items": [{"question_id": 1, "title": "How?", "link": "https://so.example/1", "score": 40, "answer_count": 2, "view_count": 300, "creation_date": 1600000000, "body": "<p>So</p>"}, {"question_id": 2, "title": "Why?", "link": "https://so.example/2", "score": 400, "answer_count": 0, "view_count": 9}]},
        [("1", "https://so.example/1", "How?", "So", "", "knowledge", "1600000000", 0.4, "en"), ("2", "https://so.example/2", "Why?", "Score: 400 | Answers: 0 | Views: 9", "", "knowledge", "0", 1.0, "en")],
    ),
    "tavily": (
        {"results": [{"url": "https://t.example/1", "title": "Tav", "content": "Found", "score": 5}, {"_is_image": True, "url": "https://t.example/i.png", "description": ""}]},
        [("https://t.example/1", "https://t.example/1", "Tav", "Found", "Found", "web", "", 0.5, "en"), ("https://t.example/i.png", "https://t.example/i.png", "Tavily image result", "", "", "media", "", 0.0, "en")],
    ),
    "unpaywall": (
        {"results": [{"response": {"doi": "10.7/u", "title": "Open", "is_oa": True, "oa_status": "gold", "best_oa_location": {"url": "https://u.example/p"}, "published_date": "2014-01-01"}}, {"doi": "10.7/v", "title_": "Shut", "oa_status": "closed"}]},
        [("10.7/u", "https://u.example/p", "Open", "Open access article (status: gold)", "", "academic", "2014-01-01", 0.6, "en"), ("10.7/v", "https://doi.org/10.7/v", "Shut", "Open access article (status: closed)", "", "academic", "", 0.3, "en")],
    ),
    "usgs_earthquakes": (
        {"features": [{"id": "us1", "properties": {"mag": 6.1, "place": "10 km S of X", "title": "M 6.1 - X", "time": 1700000000000, "url": "https://q.example/us1", "tsunami": 1, "alert": "green"}, "geometry": {"coordinates": [1, 2, 3]}}]},
        [("us1", "https://q.example/us1", "M 6.1 - X", "Magnitude: 6.1 | Location: 10 km S of X | Tsunami: Yes | Alert: green", "", "event", "1700000000000", 0.61, "en")],
    ),
    "wikidata": (
        {"search": [{"id": "Q64", "label": "Berlin", "description": "capital of Germany"}]},
        [("Q64", "https://www.wikidata.org/wiki/Q64", "Berlin", "capital of Germany", "", "knowledge", "", 0.6, "en")],
    ),
    "zenodo": (
        {"hits": {"hits": [{"id": 123, "metadata": {"title": "Set", "description": "<p>Data</p>", "publication_date": "2022-02-02"}, "files": [{"key": "a", "downloads": 150}, {"key": "b", "downloads": 100}]}]}},
        [("123", "https://zenodo.org/records/123", "Set", "Data", "", "dataset", "2022-02-02", 0.25, "en")],
    ),
}
FIELDS = ("id", "url", "title", "snippet", "content", "content_type", "timestamp", "authority_score", "lang")


def payloads() -> list[tuple[str, str]]:
    return [(name, body if isinstance(body, str) else json.dumps(body, ensure_ascii=False)) for name, (body, _) in RESPONSES.items()]


def expected_sql() -> str:
    """The records as a VALUES list."""
    text = lambda v: "CAST(" + repr(v) + " AS DOUBLE)" if isinstance(v, float) else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    rows = ", ".join("(" + ", ".join(text(v) for v in (name, *record)) + ")" for name, (_, records) in RESPONSES.items() for record in records)
    return f"SELECT * FROM (VALUES {rows}) v(source, {', '.join(FIELDS)})"
