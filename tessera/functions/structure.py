"""Columns on the structure of a cleaned text: navigation, headings, paragraphs, the opening paragraph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FLAGS, TOKEN, alpha_ratio, let, strip

# Single words of navigation, signs of consent banners, and words that begin an action.
NAVIGATION_WORDS = (
    "home", "about", "contact", "sitemap", "privacy", "terms", "cookie", "cookies", "disclaimer", "accessibility", "copyright", "donate", "help", "search",
    "navigation", "menu", "toggle", "tools", "languages", "contents",
)
CONSENT = ("cookie", "consent", "gdpr", "ccpa")
ACTIONS = ("read", "edit", "view", "download", "printable", "subscribe", "follow")
# Labels that are no heading, alone or as the first of up to three words, and words that make three words or fewer an action.
LABELS = (
    "toggle", "navigation", "tools", "search", "menu", "footer", "header", "sidebar", "actions", "settings", "options", "preferences", "languages", "language",
    "share", "print", "download", "export", "import", "help", "about", "contact", "privacy", "terms", "cookie", "cookies", "disclaimer", "license", "licence",
    "copyright", "accessibility", "skip to content", "table of contents", "on this page", "in this article", "related pages", "see also", "external links",
    "further reading", "bibliography", "notes", "citations", "sources", "references", "download pdf", "printable version", "appearance", "donate", "upload file",
    "contribute", "edit this page", "create account", "log in",
)
SINGLE_ACTIONS = (
    "edit", "view", "read", "share", "print", "download", "search", "toggle", "donate", "upload", "help", "tools", "login", "logout", "signup", "register", "subscribe",
)
# Function words of English, and the scripts whose mixture is noise.
FUNCTION_WORDS = tuple(
    "the a an is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as into through during "
    "before after above below between under again further then once here there when where why how all each every both few more most other some such no nor not only own same "
    "so than too very just because but and or if while although this that these those which who whom what it its they them their we us our you your he him his she her hers".split()
)
SCRIPTS = (
    r"Ͱ-Ͽ", r"Ѐ-ӿ", r"؀-ۿ", r"ऀ-ॿ", r"฀-๿", r"一-鿿", r"가-힯", r"぀-ゟ", r"゠-ヿ",
    r"ក-៿", r"ༀ-࿿", r"က-႟", r"ሀ-፿", r"֐-׿",
)
# First words that a sentence may begin with, so that they are no prefix to trim.
OPENERS = ("the", "this", "that", "these", "those", "some", "many", "each", "every", "both", "no", "an", "a")
CAMEL = r"[a-z]+[A-Z][a-z]+"
STOP = r"[.!?](\s|$)"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(FLAGS + pattern))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FLAGS + r"(\S+)"), F.lit(1))


def _one_of(word: Column, values: tuple[str, ...]) -> Column:
    return F.array_contains(F.array(*[F.lit(v) for v in values]), word)


def is_table_row(text: Column) -> Column:
    """Cells between bars with substance: rules of a table, long cells, links or code, not single words."""
    cells = F.filter(F.transform(F.split(text, r"\|"), strip), lambda c: c != "")
    total = lambda cs: F.aggregate(cs, F.lit(0), lambda a, c: a + F.length(c))
    rich = lambda c: (F.length(c) > 20) | c.contains("://") | c.contains("`")
    filled = lambda cs: F.exists(cs, lambda c: c.contains(" ")) & ((total(cs) > 5 * F.size(cs)) | F.exists(cs, rich))
    judged = let(cells, lambda cs: (F.size(cs) >= 3) & (F.forall(cs, lambda c: c.rlike(FLAGS + r"^[\s:-]+$")) | filled(cs)))
    return text.contains("|") & judged


def is_navigation(paragraph: Column) -> Column:
    """Whether a paragraph, without white space at its ends, is navigation or other furniture."""

    def judged(m: Column) -> Column:
        p, low, names, words = m["p"], m["low"], m["names"], m["words"]
        length, n_names, n_words = F.length(p), F.size(names), F.size(words)
        ends, camel = p.rlike("[.!?]"), _count(p, CAMEL)
        hits = F.size(F.filter(names, lambda w: _one_of(w, NAVIGATION_WORDS)))
        bars = (_count(p, r"\|") >= 2) & ~p.rlike(FLAGS + r"[^\s|]\s+[^\s|]")
        lists = bars & (p.rlike(FLAGS + r"^(\w+\s*\|\s*){3,}$") | p.rlike(FLAGS + r"\S\s*\|\s*\S{2,}\s*\|\s*\S"))
        capitals = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
        scripts = sum((p.rlike(f"[{s}]").cast("int") for s in SCRIPTS), F.lit(0))
        english = F.size(F.filter(F.regexp_extract_all(low, F.lit("([a-z']+)"), F.lit(1)), lambda w: _one_of(w, FUNCTION_WORDS)))
        lines = F.split(p, "\n")
        questions = (
            (F.size(lines) >= 3) & (F.length(strip(lines[0])) < 50) & (F.size(_words(lines[0])) <= 5)
            & F.forall(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: strip(x).endswith("?"))
        )
        other = (
            lists
            | (_count(p, "[•·>»]") >= 2) & (length < 200)
            | (hits >= 2) & (n_names <= 8)
            | low.rlike("|".join(CONSENT)) & (n_names <= 12)
            | (F.length(F.regexp_replace(p, r"[^\p{L}]", "")) < 10)
            | ~ends & ((n_words >= 5) & (2 * capitals >= n_words) | (length < 50) & (camel > 0) | (camel >= 3) | (_count(p, "List of ") >= 2))
            | (_count(p, "[a-z](?=[A-Z])") >= 3) & ((length < 80) | ~ends)
            | (hits >= 3) & (n_words <= 12)
            | (n_names > 0) & _one_of(F.lower(F.get(words, F.lit(0))), ACTIONS) & (n_words <= 10)
            | (length < 80) & p.contains("(") & p.endswith(")") & p.rlike(r"^\p{Lu}") & ~ends
            | (scripts >= 3) & (english < 5)
            | questions
        )
        return (length < 20) | ~is_table_row(p) & other

    low = F.lower(paragraph)
    return let(F.struct(paragraph.alias("p"), low.alias("low"), F.regexp_extract_all(low, F.lit("([a-z]+)"), F.lit(1)).alias("names"), _words(paragraph).alias("words")), judged)


def heading(line: Column, ahead: Column, copies: Column) -> Column:
    """The title that a line is, else null.  ``ahead`` are the next five lines, ``copies`` how often the line stands in the text.

    A title is short, begins in upper case, ends in no stop, is no label of a user
    interface, stands before content and is not set in lower case behind its first word.
    """

    def judged(m: Column) -> Column:
        words, low = m["words"], m["low"]
        n, first = F.size(words), F.lower(F.get(words, F.lit(0)))
        rest = F.slice(words, 2, F.greatest(n - 1, F.lit(0)))
        small = F.size(F.filter(rest, lambda w: w.rlike(r"^\p{Ll}")))
        follows = F.aggregate(m["ahead"], F.lit(0.0), lambda a, x: a + _content_score(x))
        empty = F.size(F.filter(m["ahead"], lambda x: x == ""))
        good = (
            n.between(1, 12) & (F.length(line) <= 80) & line.rlike(r"^\p{Lu}") & ~line.rlike("[.!?:]$") & ~_one_of(low, LABELS)
            & ~((n <= 3) & (_one_of(first, LABELS) | F.exists(words, lambda w: _one_of(F.lower(w), SINGLE_ACTIONS))))
            & ~((follows <= 0) & (empty >= 2)) & (copies < 3) & (2 * small <= F.size(rest))
        )
        return F.when(good, F.nullif(strip(F.regexp_replace(line, "[#*_`]", "")), F.lit("")))

    return let(F.struct(_words(line).alias("words"), F.lower(line).alias("low"), F.transform(ahead, strip).alias("ahead")), judged)


def _content_score(line: Column) -> Column:
    length = F.length(line)
    text = F.when(line.rlike(FLAGS + r"[.!?]\s") & (length > 50), 2.0).when(length > 80, 1.0).when(length < 25, -0.5).otherwise(0.0)
    title = F.when(line.rlike(FLAGS + r"^[A-Z][A-Za-z\s]{3,50}:?$") & (F.size(_words(line)) < 10), -0.5).otherwise(0.0)
    return F.when(line == "", 0.0).otherwise(text + title)


def is_content(items: Column) -> Column:
    """Whether the lines of a section are content: two that read like it, one long one, or lines of very different length."""
    long = lambda x: (F.length(x) > 40) & F.lower(x).rlike("the |is |are |was ")
    reads = lambda x: x.rlike(FLAGS + STOP) | (F.length(x) > 80) | long(x)
    one = F.get(items, F.lit(0))
    lengths = F.transform(items, lambda x: F.length(x))
    varied = (F.array_max(lengths) > 100) & (F.array_max(lengths) > 3 * F.greatest(F.array_min(lengths), F.lit(1)))
    single = (F.length(one) > 150) | (F.length(one) >= 40) & one.rlike(FLAGS + STOP)
    return (F.size(F.filter(items, reads)) >= 2) | (F.size(items) == 1) & single | (F.size(items) >= 3) & varied


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def _grouped_lines(text: Column) -> Column:
    """Paragraphs of texts whose blank lines are lost: lines gathered up to navigation, headings and new beginnings behind a full stop."""

    def marked(lines: Column) -> Column:
        ordered = F.array_sort(lines)
        often = F.array_distinct(F.filter(ordered, lambda x, i: x == F.get(ordered, i + 2)))
        copies = lambda x, again: F.when(F.array_contains(again, x), 3).otherwise(1)
        return let(often, lambda again: F.transform(lines, lambda x, i: F.struct(x.alias("x"), is_navigation(x).alias("nav"), heading(x, F.slice(lines, i + 2, 5), copies(x, again)).isNotNull().alias("title"))))

    # state: finished groups, the open one and its number of lines
    state = "struct<done:array<string>,open:string,n:int>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n")).cast(state)

    def step(a: Column, line: Column) -> Column:
        x = line["x"]
        ended = a["open"].rlike(r"""[.!")]$""")
        complete = (a["n"] >= 4) | (a["n"] > 0) & ended
        begins = (a["n"] >= 3) & (F.length(x) > 10) & x.rlike(r"^\p{Lu}") & ended
        close = F.when(line["nav"], complete).when(line["title"], a["n"] > 0).otherwise(begins)
        done = F.when(close, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        alone = ~line["nav"] & (line["title"] | close | (a["n"] == 0))
        opened = F.when(line["nav"], F.when(close, F.lit("")).otherwise(a["open"])).when(alone, x).otherwise(F.concat(a["open"], F.lit(" "), x))
        n = F.when(line["nav"], F.when(close, 0).otherwise(a["n"])).when(alone, 1).otherwise(a["n"] + 1)
        return F.struct(done.alias("done"), opened.alias("open"), n.alias("n")).cast(state)

    groups = F.aggregate(let(_lines(text), marked), start, step, lambda a: F.concat(a["done"], F.when(a["n"] > 0, F.array(a["open"])).otherwise(F.array().cast("array<string>"))))
    length = lambda p: F.length(p)
    kept = lambda p: (length(p) >= 40) & ((length(p) >= 200) | p.rlike(FLAGS + r"[.!?]\s") | (length(p) >= 100) & (alpha_ratio(p) > 0.5))
    return F.filter(groups, kept)


def paragraphs(text: Column) -> Column:
    """Blank-line-separated paragraphs of 40 characters, 40 % letters and no navigation; lines are grouped where that gives one or none."""

    def of(t: Column) -> Column:
        parts = F.transform(F.split(t, FLAGS + r"\n\s*\n"), strip)
        good = F.filter(parts, lambda p: (F.length(p) >= 40) & (alpha_ratio(p) >= 0.4) & ~is_navigation(p))
        return let(good, lambda ps: F.when(F.size(ps) > 1, ps).otherwise(_grouped_lines(t)))

    return let(F.coalesce(text, F.lit("")), of)


def paragraph_score(paragraph: Column) -> Column:
    """How much a paragraph reads like prose: length, sentences, words of middle length, against camel case and short lines."""
    words = F.regexp_extract_all(paragraph, F.lit(f"({TOKEN})"), F.lit(1))
    middle = let(words, lambda ws: F.when(F.size(ws) > 0, F.least(3 * F.size(F.filter(ws, lambda w: F.length(w).between(5, 10))) / F.size(ws), F.lit(1.0))).otherwise(0.0))
    camel = _count(paragraph, CAMEL)
    lines = F.split(paragraph, "\n")
    short = F.size(F.filter(lines, lambda x: F.length(strip(x)) < 30)) > 0.4 * F.size(lines)
    score = (
        2.0 * F.least(F.length(paragraph) / 1500, F.lit(1.0)) + 2.0 * F.least(_count(paragraph, STOP) / 4, F.lit(1.0)) + middle
        - F.when(camel > 3, F.least(camel * 0.3, F.lit(2.0))).otherwise(0.0) - F.when(short, 1.0).otherwise(0.0)
    )
    return F.when(F.length(paragraph) < 40, 0.0).otherwise(F.greatest(score, F.lit(0.0)))


def opening_paragraph(found: Column, text: Column) -> Column:
    """The first of the paragraphs ``found`` that is no navigation and no infobox, else the best one, else the first line that will do.

    A prefix that is no sentence goes, where the words 'X is', 'X are', 'X was' or
    'X were' begin one within the first 150 characters.
    """
    infobox = lambda p: F.substring(p, 1, 200).rlike(CAMEL) & ~F.substring(p, 1, 200).rlike("[.!?]")
    plain = F.get(F.filter(found, lambda p: ~is_navigation(p) & ~infobox(p)), F.lit(0))
    scored = F.transform(found, lambda p, i: F.struct(paragraph_score(p).alias("score"), (-i).alias("i"), p.alias("p")))
    best = let(F.array_max(scored), lambda b: F.when(b["score"] > 1.0, b["p"]))
    line = F.get(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: (F.length(x) >= 40) & ~is_navigation(x)), F.lit(0))
    return let(F.coalesce(plain, best, line, F.lit("")), _without_prefix)


def _without_prefix(p: Column) -> Column:
    def cut(m: Column) -> Column:
        prefix = strip(F.substring(m["p"], F.lit(1), m["at"]))
        first = F.lower(F.get(_words(prefix), F.lit(0)))
        goes = (F.length(m["p"]) > 100) & (m["at"] > 0) & (prefix != "") & (F.length(prefix) < 100) & ~prefix.rlike("[.!?]$") & ~_one_of(first, OPENERS)
        return F.when(goes, strip(F.substring(m["p"], m["at"] + 1, F.length(m["p"])))).otherwise(m["p"])

    at = F.regexp_instr(F.substring(p, 2, 149), F.lit(FLAGS + r"\b([A-Z][a-z]+) (is|are|was|were) "))
    return let(F.struct(p.alias("p"), at.alias("at")), cut)
