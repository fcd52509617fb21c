"""Secret scans over an incremental ledger of content-addressed texts.

Every version of a text is addressed by its SHA-256.  The ledger holds one row
for each (blob, rules version) pair that was scanned, with the spans found, an
empty list where there is none.  A rules version stands for the rules that came
with it, so a new version scans old blobs for its own rules only.  A run asks the
ledger which pairs it lacks, scans each such blob once however many paths carry
it, appends, and joins findings back to all paths.

All of it is SQL functions: matches and the text between them come from
``regexp_extract_all`` and ``split`` under one pattern, and positions are running
sums of their lengths in code points.  Blobs are picked by their address alone
(a partial aggregate), so a group of copies that holds a third of the rows moves
as hashes, not as texts.  What is missing and what was found are written before
they are joined, so that a hot blob is a join that can be split.

Defined cases: null and empty texts are the empty blob and have no span; a null
doc_id is a path like any other; repeated rows and copies get the same spans;
extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``group`` (0: the whole match) must have ``least`` characters.

    ``hint`` is a plain string that every match contains, where there is one.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    hint: str = ""
    base: bool = False


# The three base kinds, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, base=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", hint="AKIA", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("pat", r"(?:ghp|gho|ghs|glpat|xox[abp])[_-][A-Za-z0-9-]{20,}"),
)
#: What each version brought; a blob is done when the ledger has all of them.
RULE_VERSIONS: dict[int, tuple[Rule, ...]] = {1: BASE_RULES, 2: ADDED_RULES}
RULES = BASE_RULES + ADDED_RULES

_SPANS = "array<struct<start:bigint,kind_order:int,kind:string,end:bigint>>"
def empty_ledger(spark: SparkSession) -> DataFrame:
    """(blob, rules_version, spans) without a row."""
    return spark.range(0).selectExpr("'' AS blob", "0 AS rules_version", f"CAST(array() AS {_SPANS}) AS spans")


def blob_address(text: Column) -> Column:
    return F.sha2(text, 256)


def _matches(text: Column, rule: Rule, order: int, wanted: Column) -> Column:
    """Array of (kind order, text lengths before each match, match lengths, whether it counts); empty without a match or where not ``wanted``."""
    length = lambda c: F.transform(c, lambda x: F.length(x).cast("long"))
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    found = F.arrays_zip(
        length(F.split(text, rule.pattern, -1)).alias("gap"),
        length(whole).alias("size"),
        F.transform(part, lambda x: F.length(x) >= rule.least).alias("good"),
    )
    seen = wanted & text.rlike(rule.pattern)
    if rule.hint:
        seen = wanted & text.contains(rule.hint) & seen
    rows = F.transform(found, lambda m, i: F.struct(F.lit(order).alias("kind_order"), i.alias("i"), m["gap"].alias("gap"), m["size"].alias("size"), m["good"].alias("good")))
    return F.when(seen, rows).otherwise(F.array().cast("array<struct<kind_order:int,i:int,gap:bigint,size:bigint,good:boolean>>"))


def _path(text: str) -> Column:
    """The id that leads to a text; its hash where there is none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.xxhash64(text_or_empty(text)).cast("string")).alias("path")


def unseen_pairs(docs: DataFrame, ledger: DataFrame, versions: dict[int, tuple[Rule, ...]] = RULE_VERSIONS, text: str = "text") -> DataFrame:
    """(blob, path, missing): the blobs that the ledger has not under each version, one path to each, and the versions it lacks."""
    wanted = F.array(*[F.lit(v) for v in sorted(versions)])
    blobs = docs.select(_path(text), blob_address(text_or_empty(text)).alias("blob")).groupBy("blob").agg(F.min("path").alias("path"))
    known = ledger.groupBy("blob").agg(F.collect_set("rules_version").alias("known"))
    missing = F.when(F.col("known").isNull(), wanted).otherwise(F.array_except(wanted, "known"))
    return blobs.join(known, "blob", "left").select("blob", "path", missing.alias("missing")).where(F.size("missing") > 0)


def scan(blobs: DataFrame, versions: dict[int, tuple[Rule, ...]] = RULE_VERSIONS) -> DataFrame:
    """(blob, rules_version, spans) of the (blob, text, missing) rows where something was found; spans sorted by start, then kind."""
    listed = [(v, r) for v in sorted(versions) for r in versions[v]]
    kinds, of_version = (F.array(*[F.lit(x) for x in xs]) for xs in ([r.kind for _, r in listed], [v for v, _ in listed]))
    matches = [_matches(F.col("text"), r, k, F.array_contains("missing", v)) for k, (v, r) in enumerate(listed)]
    found = blobs.select("blob", F.explode(F.concat(*matches)).alias("m")).select("blob", "m.*")
    in_order = Window.partitionBy("blob", "kind_order").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    which = F.col("kind_order") + 1
    placed = (
        found.repartition("blob").distinct()  # a path that stands twice in the table brings its blob twice
        .withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(in_order))
        .where("good")
        .select(
            "blob",
            F.element_at(of_version, which).alias("rules_version"),
            F.struct((F.col("end") - F.col("size")).alias("start"), "kind_order", F.element_at(kinds, which).alias("kind"), "end").alias("span"),
        )
    )
    return placed.groupBy("blob", "rules_version").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def update_ledger(docs: DataFrame, ledger: DataFrame, versions: dict[int, tuple[Rule, ...]] = RULE_VERSIONS, text: str = "text") -> DataFrame:
    """The rows to append to the ledger: one for each (blob, version) pair that it lacks."""
    missing = cut(unseen_pairs(docs, ledger, versions, text))
    texts = docs.select(_path(text), text_or_empty(text).alias("text"))
    # ids are the small side of the join, so texts need no sort; repeated ids are told apart by their address
    blobs = texts.join(missing.hint("shuffle_hash"), "path").where(blob_address(F.col("text")) == F.col("blob")).select("blob", "text", "missing")
    pairs = missing.select("blob", F.explode("missing").alias("rules_version"))
    return pairs.join(scan(blobs, versions), ["blob", "rules_version"], "left").select("blob", "rules_version", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame, versions: dict[int, tuple[Rule, ...]] = RULE_VERSIONS, text: str = "text") -> DataFrame:
    """(doc_id, blob, spans) for every path, from what the ledger has of its blob under ``versions``."""
    paths = docs.select("doc_id", blob_address(text_or_empty(text)).alias("blob"))
    found = ledger.where(F.col("rules_version").isin(sorted(versions)) & (F.size("spans") > 0))
    per_blob = cut(found.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans")))
    return paths.join(per_blob, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def secrets_digest(docs: DataFrame) -> DataFrame:
    """The rows of the ``op7`` contract: a ledger that starts empty is brought up to date and read."""
    rows = findings(docs, cut(update_ledger(docs, empty_ledger(docs.sparkSession))))
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    joined = lambda kept: F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter(spans, lambda s: s["kind_order"] < len(BASE_RULES))
    return rows.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        "blob",
    )


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The digest in DuckDB SQL."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, {quoted(r.pattern)}) AS gaps, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS hits, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS parts FROM d"
        for k, r in enumerate(rules)
    )
    listed = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE {where}), '')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS ({parts}),
x AS (SELECT doc_id, k, kind, least, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, parts FROM p WHERE len(hits) > 0),
l AS (SELECT doc_id, k, kind, i, length(hits[i]) AS size, length(parts[i]) >= least AS good, sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM x),
f AS (SELECT doc_id, k, kind, CAST(e - size AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM l WHERE good)
SELECT d.doc_id, {counts}, sha256({listed(f"k < {sum(r.base for r in rules)}")}) AS base_sha256, {listed("k IS NOT NULL")} AS spans, sha256(any_value(t)) AS blob
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""
