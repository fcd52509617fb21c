"""Navigation, headings, sections and paragraphs of cleaned texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import structure, text
from tessera.operators import documents

WIKI = """Appearance
Read  Edit  View history
Personal tools
What links here  Permanent link  Page information
Cite this page  Data item

Basalt is a fine-grained volcanic rock. It forms when
lava cools quickly at the surface of a planet. Basalt makes up
most of the floor of the oceans, and it is found on other planets as well.

History
The word was used by Roman writers for a hard stone from the south.
Basalt was described as a volcanic rock in 1774. The dispute about
its origin was settled in the next century.

Formation
Basalt forms by partial melting of the mantle. It rises through cracks and
spreads over wide areas, which are known as traps. It can cool in columns
of six sides.
"""

BLOG = """Navigation
Home  About  Blog  Contact  Search
Subscribe to our letter
Cookie settings  Privacy policy

The Future of Small Ferries

Small ferries are changing the way that islands are served. From the north
to the south, new boats are being built to solve problems that were thought
to require a bridge.

Open Questions

Despite the progress, several questions remain. Batteries are heavy, and the
winter is long. Keeping the timetable in a storm is an active field of work.
"""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "line",
    [
        "", "too short", "Deutsch | English | Español | Français", "Start » World » Europe » Rivers of the north", "home contact and the weather of today", "We use cookies on this site to help you",
        "1234 5678 9012 3456 7890 abc", "Appearance Read Edit View history", "hereRelated changesUpload fileSpecial pagesPermanent", "Rocks (kinds of natural stone)", "Read the whole story at our site",
        "List of rocks and stones List of hills and mountains", "Альфа βήτα अक्षर альфа βήτα अक्षर альфа", "Related questions\nHow deep is it?\nWhat is it made of?\nWhere is it found?",
    ],
)
def test_navigation(spark, line):
    assert one(spark, structure.is_navigation(F.lit(line)))


@pytest.mark.parametrize(
    "line",
    [
        "Basalt is a fine-grained volcanic rock that forms from lava.", "| kind of rock | where it is found | how hard it is |", "see https://host/path/to/file and the other one for how it is done",
        "The function readFile is what opens it, and closeFile is what ends it.",
    ],
)
def test_no_navigation(spark, line):
    assert not one(spark, structure.is_navigation(F.lit(line)))


def head(spark, line, *ahead, copies=1):
    return one(spark, structure.heading(F.lit(line), F.array(*[F.lit(x) for x in ahead]).cast("array<string>"), F.lit(copies)))


def test_headings(spark):
    prose = "It was found in a quarry near the river. Nobody had looked there before, as it was far away."
    assert head(spark, "Early History", prose) == "Early History"
    assert head(spark, "## *Early* History", prose) is None  # marked ones are the sections' own business
    assert head(spark, "**Early** History", prose) is None
    assert head(spark, "Early `History`", prose) == "Early History"
    for line in ("early history", "It ends here.", "A label:", "References", "Search the site", "Edit page", "One that goes on in lower case letters", "X" * 81):
        assert head(spark, line, prose) is None
    assert head(spark, "Early History", "", "", "short") is None
    assert head(spark, "Early History", prose, copies=3) is None


def sections(spark, body):
    rows = documents.sections(spark.createDataFrame([(1, body)], "id long, body string"), "id", "body").collect()
    return {r["section"]: r["lines"] for r in rows}


def test_sections(spark):
    found = sections(spark, WIKI)
    assert not {"Appearance", "Personal tools", "What links here"} & set(found)
    assert {"History", "Formation"} <= set(found) and found["History"][1].startswith("Basalt was described")
    assert any(x.startswith("Basalt is a fine-grained") for lines in found.values() for x in lines)
    found = sections(spark, BLOG)
    assert "Navigation" not in found and any("Despite the progress" in x for x in found["Open Questions"])
    marked = sections(spark, "# One\nThis is a line of the first part. It goes on.\nAnd this is another. It ends.\nGREAT DEPTHS\nlow words\n# One\nThe first part again. It goes on here.")
    assert marked["One"][-1].startswith("The first part again") and len(marked["One"]) == 3 and "GREAT DEPTHS" not in marked
    assert sections(spark, "") == {} and sections(spark, None) == {}


def paragraphs(spark, body):
    return one(spark, structure.paragraphs(F.lit(body)))


def test_paragraphs(spark):
    found = paragraphs(spark, WIKI)
    assert len(found) >= 2 and "Basalt is a fine-grained" in " ".join(found) and "Appearance" not in " ".join(found)
    assert [p[:13] for p in paragraphs(spark, BLOG)] == ["Small ferries", "Despite the p"]
    assert paragraphs(spark, "") == [] and paragraphs(spark, None) == []


def test_grouped_lines(spark):
    lines = ["What links here", "Related changes", "The first line is long enough to be kept. It says something.", "The second goes on with it and ends here.", "A third one follows. It is the last of them.", "New matter begins here, after a full stop. It goes on for a while."]
    assert paragraphs(spark, "\n".join(lines)) == [" ".join(lines[2:5]), lines[5]]
    first, second = "First part, with words enough. It is over now.", "Second part, with words enough. Many ideas are in it."
    assert paragraphs(spark, f"{first}\nHistory\n{second}") == [first, second]
    assert paragraphs(spark, f"{first}\nEarly History of Basalt\n{second}") == [first, f"Early History of Basalt {second}"]
    assert paragraphs(spark, "no stop in here and not long") == []


def opening(spark, body):
    return one(spark, structure.opening_paragraph(structure.paragraphs(F.lit(body)), F.lit(body)))


def test_opening_paragraph(spark):
    assert opening(spark, WIKI).startswith("Basalt is a fine-grained") and opening(spark, BLOG).startswith("Small ferries")
    assert opening(spark, "Rock Types (Handbook)vte Basalt is a volcanic rock. " + "It is found in many places of the earth. " * 4).startswith("Basalt is a volcanic rock.")
    assert opening(spark, "The word Basalt is a volcanic rock. " + "It is found in many places of the earth. " * 4).startswith("The word")
    assert opening(spark, "a line of forty characters or more without a stop") == "a line of forty characters or more without a stop"
    assert opening(spark, "") == ""


def test_structured(spark):
    rows = spark.createDataFrame([(1, WIKI, "https://en.wikipedia.org/wiki/Basalt"), (2, BLOG, "https://blog.example"), (3, None, None), (4, "&amp; ﬁne", "https://x.example/a")], "pos long, body string, url string")
    got = {r["pos"]: r for r in documents.structured(rows, "pos", "body", "url").collect()}
    assert [got[i]["content_type"] for i in (1, 2, 3, 4)] == ["encyclopedia", "blog", "unknown", "unknown"]
    assert got[1]["content_quality_score"] == 0.45 and got[3]["content_quality_score"] == 0.0 and got[3]["content_sections"] == {}
    assert got[1]["first_paragraph"].startswith("Basalt is") and got[1]["sentences_count"] > len(got[1]["sample_sentences"]) == 5
    assert got[4]["cleaned_content"] == "& fine" and got[4]["readability"] is None


def test_phrases_bared_by_others(spark):
    assert one(spark, text.without_phrases(F.lit("about home | x\nus and more"))) == ""
    assert one(spark, text.without_phrases(F.lit("An Advertisement for rocks"))) == "An  for rocks"
