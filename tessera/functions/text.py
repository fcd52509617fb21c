"""Text columns: tokens, stems, counts, cleaning, keywords, readability, quality signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode word characters; ``\\w`` would be ASCII here.
TOKEN = r"[\p{L}\p{N}_]+"

# Letters and numbers of Unicode 14 and 15, which RE2 knows and Java 17 does not.
LATER = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7D0-A7D1 A7D3 A7D5-A7D9 A7F2-A7F4 10570-1057A 1057C-1058A "
    "1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 10780-10785 10787-107B0 107B2-107BA 10F70-10F81 11071-11072 11075 1123F-11240 "
    "11740-11746 11AB0-11ABF 11F02 11F04-11F10 11F12-11F33 11F50-11F59 12F90-12FF0 1342F 13441-13446 16A70-16ABE 16AC0-16AC9 1AFF0-1AFF3 1AFF5-1AFFB "
    "1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1D2C0-1D2D3 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E4F0-1E4F9 1E7E0-1E7E6 1E7E8-1E7EB "
    "1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 31350-323AF"
)
_LATER = "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in LATER.split())
#: The same with letters that the Java version may not know; others are told by one comparison.
KNOWN_TOKEN = rf"[\p{{L}}\p{{N}}_[\x{{870}}-\x{{323AF}}&&[{_LATER}]]]+"
# Letters whose lower case hangs on the letters around, is two characters, or is a letter only since Unicode 16.
CASE_APART = (("\u0130", "i"), ("\u03a3", "\u03c3"), ("\ua7cb", " "), ("\ua7dc", " "))

# The stemmer's rules in order, as (suffix, replacement, shortest stem).
STEM_RULES: tuple[tuple[str, str, int], ...] = (
    ("ational", "ate", 3), ("tional", "tion", 3), ("iveness", "ive", 3), ("fulness", "ful", 3), ("ousness", "ous", 3),
    ("ization", "ize", 3), ("isation", "ise", 3), ("ousli", "ous", 3), ("entli", "ent", 3), ("ation", "ate", 3),
    ("alism", "al", 3), ("aliti", "al", 3), ("iviti", "ive", 3), ("biliti", "ble", 3), ("ous", "", 3),
    ("ies", "y", 2), ("ied", "y", 2), ("ing", "", 3), ("edly", "", 3), ("ed", "", 3),
    ("ly", "", 3), ("ful", "", 3), ("ness", "", 3), ("ment", "", 3), ("ents", "ent", 3),
    ("s", "", 3), ("e", "", 3),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once per row."""
    return F.transform(F.array(value), body)[0]


def stem_sql(word: str, ascii_test: str) -> str:
    """The stemmer as one CASE over a lower-case ``word``; the same text serves any SQL engine with left() and right()."""
    branches = []
    for suffix, new, least in STEM_RULES:
        cut = f"left({word}, length({word}) - {len(suffix)})"
        if suffix in ("ing", "ed"):
            last = f"right({cut}, 1)"
            fixed = (
                f"CASE WHEN {last} = left(right({cut}, 2), 1) THEN (CASE WHEN {last} IN ('l', 's', 'z') THEN {cut} ELSE left({cut}, length({cut}) - 1) END) "
                f"WHEN right({cut}, 2) = 'ie' THEN concat(left({cut}, length({cut}) - 2), 'y') ELSE {cut} END"
            )
        else:
            fixed = f"concat({cut}, '{new}')"
        branches.append(f"WHEN right({word}, {len(suffix)}) = '{suffix}' AND length({word}) >= {len(suffix) + least} THEN {fixed}")
    return f"CASE WHEN length({word}) <= 3 OR NOT ({ascii_test}) THEN {word} {' '.join(branches)} ELSE {word} END"


def stem(word: str) -> Column:
    """Stem of the column named ``word`` (lower case)."""
    return F.expr(stem_sql(word, f"length({word}) = octet_length({word})"))


def lowered(text: Column) -> Column:
    """Lower case letter by letter, as in the queries' SQL: İ is i, and Σ is σ at a word's end too."""
    for upper, own in CASE_APART:
        text = F.replace(text, F.lit(upper), F.lit(own))
    return F.lower(text)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(f"({KNOWN_TOKEN})"), F.lit(1))


def stem_word(word: str) -> str:
    """The stemmer on the driver, for query terms."""
    if len(word) <= 3 or not word.isascii():
        return word
    for suffix, new, least in STEM_RULES:
        if word.endswith(suffix) and len(word) - len(suffix) >= least:
            out = word[: len(word) - len(suffix)] + new
            if suffix in ("ing", "ed"):
                if out[-1] == out[-2]:
                    return out if out[-1] in "lsz" else out[:-1]
                return out[:-2] + "y" if out.endswith("ie") else out
            return out
    return word


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal ``term``."""
    if not term:
        return F.lit(0)
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def word_count(text: Column) -> Column:
    """Words separated by white space."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S+)"), F.lit(1)))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_hash(text: Column) -> Column:
    """SHA-256 of the lower-case text with single spaces, first 5,000 characters."""
    return F.sha2(F.substring(F.lower(collapse_space(F.coalesce(text, F.lit("")))), 1, 5000), 256)


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(text, F.lit(SPACES))


# ------------------------------------------------------------------- cleaning
# White space, control characters, lines that are no content, and phrases that are none to the end of their line.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
SEPARATOR_LINE = r"^[=*\-_~]{3,}$"
PAGE_NUMBER_LINE = r"^\s*\d+\s*$|^Page\s+\d+"
BREADCRUMB_LINE = r"^[A-Za-z]+\s*>\s*[A-Za-z]+(?:\s*>\s*[A-Za-z]+)*$"
NAVIGATION_PHRASES = (
    r"home\s*\|", r"about\s*us", r"contact\s*us", "sitemap", r"privacy\s*policy", r"terms\s*of\s*use", r"cookie\s*policy",
    r"accessibility\s*statement", r"legal\s*notice", r"copyright\s*©", r"all\s*rights\s*reserved",
)
SOCIAL_PHRASES = (r"follow\s*us\s*on", r"like\s*us\s*on", r"share\s*this\s*page", r"tweet\s*this", r"sponsored\s*content", "advertisement", r"promoted\s*by", r"partner\s*content")
#: Of this phrase the word alone goes.
WORD_ALONE = "advertisement"
#: Java flags for Python's reading of a pattern: Unicode classes, only \n ends a line.
FLAGS, ANY_CASE = "(?Ud)", "(?iUd)"


def normalized(text: Column) -> Column:
    """Entities unescaped, then NFKC.  Only texts with an entity or a character beyond ASCII go to Python."""
    from .html import unescape_nfkc

    changes = text.contains("&") | (F.length(text) != F.octet_length(text))
    return F.coalesce(unescape_nfkc(F.when(changes, text)), text)


def without_phrases(text: Column) -> Column:
    """Phrases go one after the other, as each may bare another; texts without one are left as they are."""
    phrases = NAVIGATION_PHRASES + SOCIAL_PHRASES

    def chain(t: Column) -> Column:
        for phrase in phrases:
            t = F.regexp_replace(t, ANY_CASE + phrase + ("" if phrase == WORD_ALONE else ".*"), "")
        return t

    return let(text, lambda t: F.when(t.rlike(ANY_CASE + "|".join(phrases)), chain(t)).otherwise(t))


def drop_repeated_headers(text: Column) -> Column:
    """In texts of over 10 lines, those under 80 characters and 5 words that occur over 3 times stay only at their first place."""

    def of_lines(lines: Column) -> Column:
        ordered = F.array_sort(F.filter(lines, lambda x: (F.length(x) < 80) & (F.regexp_count(x, F.lit(FLAGS + r"\S+")) < 5)))
        often = lambda o: F.array_distinct(F.filter(o, lambda x, i: x == F.get(o, i + 3)))
        once = lambda again: F.filter(lines, lambda x, i: ~F.array_contains(again, x) | (F.array_position(lines, x) == i + 1))
        return F.array_join(F.when(F.size(lines) > 10, let(let(ordered, often), once)).otherwise(lines), "\n")

    return let(F.split(text, "\n"), of_lines)


def clean(text: Column, normalize: bool = True) -> Column:
    """Cleaning chain: entities and NFKC, newlines, control characters, furniture lines, phrases, repeated headers, white space."""
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(F.regexp_replace(normalized(t) if normalize else t, r"\r\n?", "\n"), CONTROL, " ")
    furniture = f"{FLAGS}{SEPARATOR_LINE}|{PAGE_NUMBER_LINE}|{BREADCRUMB_LINE}"
    t = F.array_join(F.filter(F.transform(F.split(t, "\n"), strip), lambda x: ~x.rlike(furniture)), "\n")
    t = drop_repeated_headers(without_phrases(t))
    return strip(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def alpha_ratio(text: Column) -> Column:
    """Share of letters; 0 for an empty text."""
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(text, r"[^\p{L}]", "")).cast("double"), F.length(text)), F.lit(0.0))


# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "Prof", "etc", "vs", "Jan", "Feb", "Aug", "Sept", "Oct", "Nov", "Dec")
DOTTED = ("e.g.", "i.e.", "U.S.", "U.K.")


def sentences(text: Column) -> Column:
    """Sentences of over 15 characters; split behind .!? before A to Z, not behind an abbreviation."""
    short = "|".join(ABBREVIATIONS)
    guarded, open_again = F.regexp_replace(F.coalesce(text, F.lit("")), rf"({short})\.", "$1#"), lambda x: F.regexp_replace(x, f"({short})#", "$1.")
    for word in DOTTED:
        hidden = word.replace(".", "#")
        guarded = F.replace(guarded, F.lit(word), F.lit(hidden))
        open_again = (lambda inner, hidden, word: lambda x: F.replace(inner(x), F.lit(hidden), F.lit(word)))(open_again, hidden, word)
    parts = F.split(guarded, FLAGS + r"(?<=[.!?])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda x: strip(open_again(x))), lambda x: F.length(x) > 15)


def syllables(word: Column) -> Column:
    """Vowel groups; words of up to 3 letters count one."""
    return F.when(F.length(word) <= 3, F.lit(1)).otherwise(F.regexp_count(F.lower(word), F.lit("[aeiouy]+")))


def readability(text: Column) -> Column:
    """Struct of words, sentences, syllables, mean lengths and Flesch reading ease (at least 0); null for a text without a word or a sentence."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(f"({TOKEN})"), F.lit(1))
    total = lambda ws, of: F.aggregate(ws, F.lit(0), lambda a, w: a + of(w))
    counted = let(words, lambda ws: F.struct(F.size(ws).alias("w"), total(ws, syllables).alias("y"), total(ws, F.length).alias("c")))
    ease = lambda m, n: F.greatest(F.lit(0.0), 206.835 - 1.015 * (m["w"] / n) - 84.6 * (m["y"] / m["w"]))

    def of(m: Column, n: Column) -> Column:
        measures = F.struct(
            m["w"].alias("words"), n.alias("sentences"), m["y"].alias("syllables"),
            F.round(m["w"] / n, 1).alias("avg_sentence_length"), F.round(m["c"] / m["w"], 1).alias("avg_word_length"), ease(m, n).alias("flesch"),
        )
        return F.when((m["w"] > 0) & (n > 0), measures)

    return let(F.struct(counted.alias("m"), F.size(sentences(t)).alias("n")), lambda x: of(x["m"], x["n"]))


# Words that mark technical text, and patterns of code, references and list items.
TECHNICAL = (
    "function", "class", "method", "variable", "import", "def", "return", "if", "else", "for", "while", "try", "except", "database", "api", "server", "client",
    "json", "xml", "html", "css", "javascript", "python", "java",
)
CODE = (r"def\s+\w+\(.*\):", r"class\s+\w+:", r"import\s+\w+", r"print\(.*\)", r"console\.log\(.*\)", r"System\.out\.println\(.*\)", r"<[a-zA-Z][^>]*>")
REFERENCES = r"\[\d+\]|\(\d{4}\)|et al\.|pp\."
LIST_ITEM = r"^\s*(#+|\*+|\-+|\d+\.)\s+"


def content_signals(text: Column) -> Column:
    """Struct of six signs that a text is content."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(F.lower(t), F.lit(FLAGS + r"(\b[a-zA-Z]{3,}\b)"), F.lit(1))
    technical = F.array(*[F.lit(w) for w in TECHNICAL])
    counted = let(words, lambda ws: F.struct(F.size(ws).alias("n"), F.size(F.filter(ws, lambda w: F.array_contains(technical, w))).alias("technical")))
    return let(
        counted,
        lambda m: F.struct(
            (m["n"] > 100).alias("has_natural_language"),
            (m["technical"] > 5).alias("has_technical_terms"),
            t.rlike(FLAGS + "|".join(CODE)).alias("has_code_examples"),
            t.rlike(FLAGS + REFERENCES).alias("has_references"),
            (F.regexp_count(t, F.lit("(?Udm)" + LIST_ITEM)) > 2).alias("has_structure"),
            alpha_ratio(t).alias("content_density"),
        ),
    )


KEYWORD = r"\b[a-zA-Z'][a-zA-Z'-]{%d,}\b"


def keyword_tokens(text: Column, least: int = 4) -> Column:
    """Lower-case words of ``least`` characters or more, with apostrophes and hyphens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{FLAGS}({KEYWORD % (least - 1)})"), F.lit(1))
