"""De-duplication: first wins by key, content hashes, near-duplicate titles and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, collapse_space, content_hash, let
from ..shared import stored
from . import graph

#: Words in a shingle of a fingerprint.
SHINGLE = 3


def first_wins(rows: DataFrame, key: Column, *order: str | Column, keep_empty: bool = False) -> DataFrame:
    """The first row of each ``key``; rows with an empty key go, or all stay with ``keep_empty``."""
    k = F.coalesce(key, F.lit(""))
    marked = rows.withColumn("__key", k)
    # rows with an empty key may be many: they take no part in the window
    full = marked.where(F.col("__key") != "").withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy(*order))).where(F.col("__n") == 1).drop("__n")
    if keep_empty:
        full = full.unionByName(marked.where(F.col("__key") == ""))
    return full.drop("__key")


def url_key(url: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", "")


def by_content(rows: DataFrame, text: str, *order: str) -> DataFrame:
    """The first row of each content hash."""
    return first_wins(rows, content_hash(F.col(text)), *order)


def title_key(title: Column) -> Column:
    """Lower case, no punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def entry_hash(guid: Column, url: Column, title: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (guid, url, title)]), 256)


def similar_title_pairs(rows: DataFrame, key: str, pos: str, threshold: float = 0.9) -> DataFrame:
    """(earlier, later) positions of rows whose title words have a Jaccard similarity over ``threshold``.

    Words are joined by rarity: two sets this similar share one of the
    first ``n - ceil(t n) + 1`` words of either in a common order, so only that
    prefix of each title is joined, and common words seldom are.
    """
    words = rows.select(F.col(pos).alias("pos"), F.array_distinct(F.split(key, " ")).alias("words")).where(F.size("words") > 0)
    each = words.select("pos", F.explode("words").alias("w"))
    counts = each.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    n = F.size("ordered")
    prefix = F.slice("ordered", 1, (n - F.ceil(F.lit(threshold) * n) + 1).cast("int"))
    ordered = (
        each.join(counts, "w").groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("s"))
        .select("pos", F.transform("s", lambda x: x["w"]).alias("ordered"))
    )
    keys = ordered.select("pos", "ordered", F.explode(prefix).alias("w"))
    a, b = keys.alias("a"), keys.alias("b")
    size_ok = F.least(F.size("a.ordered"), F.size("b.ordered")) >= threshold * F.greatest(F.size("a.ordered"), F.size("b.ordered"))
    pairs = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.pos") < F.col("b.pos")) & size_ok)
    common = F.size(F.array_intersect("a.ordered", "b.ordered"))
    j = common / (F.size("a.ordered") + F.size("b.ordered") - common)
    return pairs.where(j > threshold).select(F.col("a.pos").alias("earlier"), F.col("b.pos").alias("later")).distinct()


def greedy_keep(rows: DataFrame, pairs: DataFrame, pos: str) -> DataFrame:
    """Rows without an earlier kept neighbour in ``pairs`` (earlier, later).

    A row without an earlier neighbour stays; what it excludes is settled, and so
    on.  Pairs only point backwards, so the rounds end; each is checkpointed.
    """
    left = pairs
    gone = rows.select(F.col(pos).alias("pos")).limit(0)
    while not left.isEmpty():
        # keepers: named by a pair as earlier, and not later in any pair that is left
        keepers = left.select(F.col("earlier").alias("pos")).join(left.select(F.col("later").alias("pos")), "pos", "left_anti").distinct()
        out = graph.cut(left.join(keepers.withColumnRenamed("pos", "earlier"), "earlier").select(F.col("later").alias("pos")).distinct())
        gone = gone.union(out)
        left = graph.cut(
            left.join(out.withColumnRenamed("pos", "earlier"), "earlier", "left_anti").join(out.withColumnRenamed("pos", "later"), "later", "left_anti").select("earlier", "later")
        )
    return rows.join(gone.withColumnRenamed("pos", pos), pos, "left_anti")


def entries(rows: DataFrame, pos: str = "pos", threshold: float = 0.9) -> DataFrame:
    """Feed entries: first of each (guid, url, title), of each normal title, and none like an earlier kept title."""
    once = first_wins(rows, entry_hash(F.col("guid"), F.col("url"), F.col("title")), pos)
    titled = once.withColumn("__title", title_key(F.col("title")))
    judged = titled.where((F.col("__title") != "") & (F.trim(F.coalesce("url", F.lit(""))) != ""))
    other = titled.where(~((F.col("__title") != "") & (F.trim(F.coalesce("url", F.lit(""))) != "")))
    distinct = first_wins(judged, F.col("__title"), pos)
    kept = greedy_keep(distinct, similar_title_pairs(distinct, "__title", pos, threshold), pos)
    return kept.unionByName(other).drop("__title")


# ------------------------------------------------------------- near duplicates
def fingerprint_text(title: Column, url: Column, content: Column) -> Column:
    """Title, host without www. and the first 500 characters of the content."""
    host = F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), "^https?://([^/]+)", 1), r"www\.", "")
    return F.concat_ws(" ", F.trim(F.coalesce(title, F.lit(""))), host, F.substring(F.coalesce(content, F.lit("")), 1, 500))


def shingles(text: Column) -> Column:
    """Distinct runs of three words; the words themselves if there are fewer."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))
    return let(words, lambda w: F.array_distinct(F.when(F.size(w) < SHINGLE, w).otherwise(runs(w))))


def near_pairs(rows: DataFrame, pos: str, sets: str, threshold: float = 0.5) -> DataFrame:
    """(a, b, jaccard), a < b, of distinct sets at ``threshold`` or more; exact.

    Two sets this similar share one of the first n - ceil(t n) + 1 members of either
    in a common order.  The order is by rarity, so what many sets have is seldom
    joined.  ``rows`` must hold each set once (see ``clusters``).
    """
    own = stored(rows.where(F.size(sets) > 0).select(F.col(pos).alias("pos"), F.transform(sets, lambda x: F.xxhash64(x)).alias("s")))
    each = own.select("pos", F.explode("s").alias("x"))
    counts = stored(each.groupBy("x").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    # members of one set only join with nothing, but stand first in the order
    shared = each.join(counts, "x").groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "x"))), lambda m: m["x"]).alias("common"))
    n = F.size("s")
    room = (n - F.ceil(F.lit(threshold) * n) + 1 - (n - F.size("common"))).cast("int")
    keys = stored(own.join(shared, "pos").where(room > 0).select("pos", n.alias("n"), F.explode(F.slice("common", 1, room)).alias("x")))
    x, y = keys.alias("x"), keys.alias("y")
    size_ok = F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n")
    pairs = x.join(y, (F.col("x.x") == F.col("y.x")) & (F.col("x.pos") < F.col("y.pos")) & size_ok).select(F.col("x.pos").alias("a"), F.col("y.pos").alias("b")).distinct()
    joined = pairs.join(own.select(F.col("pos").alias("a"), F.col("s").alias("sa")), "a").join(own.select(F.col("pos").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return joined.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def clusters(rows: DataFrame, pos: str = "pos", threshold: float = 0.5) -> DataFrame:
    """``rows`` (title, url, content) and ``cluster``: the smallest pos of its near-duplicate component."""
    sets = F.array_sort(F.transform(shingles(fingerprint_text(F.col("title"), F.col("url"), F.col("content"))), lambda x: F.xxhash64(x)))
    marked = graph.cut(rows.select(pos, F.explode(F.array(sets)).alias("__s")).withColumn("__h", F.xxhash64("__s")))
    classes = marked.groupBy("__h").agg(F.min(pos).alias("rep"))
    reps = marked.select(pos, "__s").join(classes.select(F.col("rep").alias(pos)), pos, "left_semi").select(F.col(pos).alias("rep"), "__s")
    found = graph.components(near_pairs(reps, "rep", "__s", threshold).select("a", "b"))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("__h", F.coalesce("component", "rep").alias("cluster"))
    return rows.join(marked.join(named, "__h").select(pos, "cluster"), pos)


def collapse(rows: DataFrame, pos: str = "pos", threshold: float = 0.5) -> DataFrame:
    """One survivor (smallest pos) for each cluster, with ``duplicates``: the others' URLs in order."""
    marked = clusters(rows, pos, threshold)
    others = (
        marked.where((F.col(pos) != F.col("cluster")) & (F.coalesce("url", F.lit("")) != ""))
        .groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct(pos, "url"))).alias("d"))
        .select("cluster", F.transform("d", lambda x: x["url"]).alias("duplicates"))
    )
    return marked.where(F.col(pos) == F.col("cluster")).join(others, "cluster", "left").withColumn("duplicates", F.coalesce("duplicates", F.array().cast("array<string>"))).drop("cluster")


def dedupe_sentences(text: Column) -> Column:
    """Distinct sentences of a text in order, compared without case and punctuation."""
    parts = F.filter(F.split(collapse_space(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda x: x != "")
    bare = lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]+", ""))
    return let(parts, lambda p: let(F.transform(p, bare), lambda b: F.array_join(F.filter(p, lambda x, i: F.array_position(b, F.get(b, i)) == i + 1), " ")))
