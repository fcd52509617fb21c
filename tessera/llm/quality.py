"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  Its outcome is a bit of ``fail_bits``
and what it measured is a column, so policies (sets of rules with a version) and
ablations are bit arithmetic over the ledger and never read a text again.

Everything is a row-wise SQL expression: there is no shuffle and no Python, so a
hot source or copy group costs what its rows cost.  The query stores the ledger and
reads policies and the ablation (the rule whose removal would keep a document) off
it; ``ablations`` sums the same over a corpus.

Defined cases: a null or empty text has no word, every measurement 0 and fails
the word-count rule; a text of one very long word is one word; repeated rows are
judged one by one; further columns pass through ``with_ledger`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_REGEX, free_name, let, stored, text_or_empty

#: Words in a window of the repetition rule.
WINDOW = 8
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``test`` gets the measurements struct and tells whether the rule fails."""

    bit: int
    name: str
    test: object


def _rules() -> tuple[Rule, ...]:
    n = lambda m: m["n_words"]
    return (
        Rule(0, "too_few_words", lambda m: n(m) < 20),
        Rule(1, "repeated_words", lambda m: 100 * m["n_repeat_words"] > 30 * n(m)),
        Rule(2, "symbol_ratio", lambda m: 10 * m["n_symbols"] > n(m)),
        Rule(3, "duplicate_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
        Rule(4, "short_words", lambda m: m["word_chars"] < 2 * n(m)),
        Rule(5, "long_words", lambda m: m["word_chars"] > 20 * n(m)),
        Rule(6, "very_long", lambda m: n(m) > 1_000_000),
    )


RULES = _rules()


@dataclass(frozen=True)
class Policy:
    """A version of the set of rules whose failure rejects a document."""

    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


BASE_POLICY = Policy(1, ("too_few_words", "repeated_words"))
POLICY = Policy(2, ("too_few_words", "repeated_words", "symbol_ratio", "duplicate_lines", "short_words", "long_words"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more, from the window hashes in order."""

    def covered(ordered: Column) -> Column:
        same = lambda s, other: F.coalesce(s["h"] == other["h"], F.lit(False))
        twice = F.filter(ordered, lambda s, j: same(s, F.get(ordered, j - 1)) | same(s, F.get(ordered, j + 1)))
        starts = F.array_sort(F.transform(twice, lambda s: s["i"]))
        # least() passes over the null behind the last start, which then counts a whole window
        return let(starts, lambda p: _total(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.get(p, k + 1) - x).cast("long"))))

    ordered = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, covered))


def measurements(text: Column) -> Column:
    """Struct of what the rules look at: words, characters, symbols, lines, repetition."""

    def of_words(words: Column) -> Column:
        n = F.size(words)
        # a word is hashed once; a window is the hash of its words' hashes
        over = lambda hashes: F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
        windows = F.when(n >= WINDOW, let(F.transform(words, lambda w: F.xxhash64(w)), over)).otherwise(F.array().cast("array<bigint>"))
        return F.struct(n.cast("long").alias("n_words"), let(windows, _repeat_words).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        n = F.size(lines)
        return F.struct(n.cast("long").alias("n_lines"), (n - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    words = F.regexp_extract_all(text, F.lit(f"({WORD_REGEX})"), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_REGEX))
    return let(
        F.struct(let(words, of_words).alias("w"), let(lines, of_lines).alias("l")),
        lambda m: F.struct(
            m["w"]["n_words"].alias("n_words"),
            F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            m["l"]["n_lines"].alias("n_lines"),
            m["l"]["n_dup_lines"].alias("n_dup_lines"),
            m["w"]["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


def fail_bits(measured: Column) -> Column:
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.test(measured), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def with_ledger(docs: DataFrame, text: str = "text", name: str = "ledger") -> tuple[DataFrame, str]:
    """``docs`` and a struct column (its name is returned) of measurements and ``fail_bits``."""
    name = free_name(docs, name)
    measured = let(
        measurements(text_or_empty(text)),
        lambda m: F.struct(*[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")], fail_bits(m).alias("fail_bits")),
    )
    # explode of one element keeps the optimizer from copying the expression to each use
    return docs.select("*", F.explode(F.array(measured)).alias(name)), name


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, the measurements and ``fail_bits``."""
    judged, name = with_ledger(docs.select(doc_id, text), text)
    return judged.select(doc_id, f"{name}.*")


def passes(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """The ledger with ``policy_version`` and the verdict ``kept``."""
    return rows.withColumn("policy_version", F.lit(policy.version)).withColumn("kept", passes(F.col("fail_bits"), policy))


def ablations(rows: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that only it rejects."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    chosen = [r for r in RULES if r.name in policy.rules]
    sums = [
        c
        for r in chosen
        for c in (
            F.count_if(bits.bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias(f"{r.name}_failed"),
            F.count_if(bits == F.lit(1 << r.bit).cast("long")).alias(f"{r.name}_alone"),
        )
    ]
    row = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(bits == 0).alias("n_kept"), *sums)
    entries = [F.struct(F.lit(r.name).alias("rule"), F.col(f"{r.name}_failed").alias("n_failed"), F.col(f"{r.name}_alone").alias("n_only_this")) for r in chosen]
    return row.select(F.lit(policy.version).alias("policy_version"), "n_docs", "n_kept", F.explode(F.array(*entries)).alias("e")).select("policy_version", "n_docs", "n_kept", "e.*")


def sole_failure(bits: Column, policy: Policy = POLICY) -> Column:
    """The rule without which the policy would accept the document: the only one of its rules that fails; null if none or several do."""
    mine, out = bits.bitwiseAND(F.lit(policy.mask).cast("long")), F
    for rule in RULES:
        if rule.name in policy.rules:
            out = out.when(mine == F.lit(1 << rule.bit).cast("long"), rule.name)
    return out


def keep_good(docs: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """The documents that the policy accepts, with their own columns only."""
    judged, name = with_ledger(docs)
    return judged.where(passes(F.col(name)["fail_bits"], policy)).drop(name)


def quality_digest(docs: DataFrame) -> DataFrame:
    """The rows of the ``op10`` contract: the ledger is stored, policies and the ablation are read off it."""
    rows = apply_policy(stored(ledger(docs)))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(F.col("fail_bits"), BASE_POLICY)).alias("base_failed"), "kept", "fail_bits", "policy_version", sole_failure(F.col("fail_bits")).alias("sole_failure"),
    )


def oracle() -> str:
    """The digest in DuckDB SQL."""
    word = r"'[^\x20\x09-\x0D]+'"
    base, full = BASE_POLICY.mask, POLICY.mask
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, {word}) AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {word})) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least({WINDOW}, coalesce(next - i, {WINDOW}))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM rep) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END + CASE WHEN n_words > 1000000 THEN 64 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {base} <> 0 AS base_failed, fail_bits & {full} = 0 AS kept, fail_bits, CAST({POLICY.version} AS INTEGER) AS policy_version,
 CASE fail_bits & {full} {" ".join(f"WHEN {1 << r.bit} THEN '{r.name}'" for r in RULES if r.name in POLICY.rules)} END AS sole_failure FROM b"""
