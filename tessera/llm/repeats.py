"""Repeated windows of tokens over a corpus: the frame of the two substring operators.

A window is ``width`` tokens in a row (bytes, or words by their 64-bit hash) of
one text.  Windows that start at two places or more are found exactly, without a
row for each position:

1. *Anchors.*  In each window, among its first ``slack`` + 1 positions, the first
   one with the least hash of the tokens there is an anchor.  The choice looks at
   the window alone, so equal windows have equal anchors, about one for
   ``slack`` / 2 positions.  An anchor's key is the hash of the ``width - slack``
   tokens from it on, all inside the window.  Anchors are written once; keys met
   twice are counted from there by partial aggregation, written and joined back.
2. *Contexts.*  Each such anchor brings up to ``slack`` tokens from either side of
   its key.  Two occurrences share a window if and only if the tokens they share
   to the left and to the right number at least ``slack``.
3. *Groups.*  The anchors of one key meet and an index of their right contexts (a
   suffix array or a suffix tree, the operators differ in this) yields groups
   with a common right extension, deepest first; in each the left contexts tell
   how far its members agree.
4. *Large groups.*  A key at more than ``most`` places is split by longer prefixes
   (``_split``): the windows around an anchor are told apart by how many tokens
   they take from its left, in ranges that are quartered step by step.  All windows
   of a range hold the key and what every one of them takes from either side: that
   is the longer prefix.  Places that share all that a range reaches are covered,
   and one stands for them.  Prefixes at up to ``most`` such places are groups as
   in 3, larger ones go on; a range of one window leaves nothing to compare.
5. What is covered goes back to the texts, where runs are merged.

Equal texts are one text for all of this (a copy of a text covers it whole).  The
distinct texts are dealt by document once, into a bucketed table that serves all
steps without another exchange.

Texts are addressed by 128 bits.  Keys are 64-bit hashes, but a chance collision
of keys covers nothing unless the contexts agree as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_arrow, bucketed, stored

#: Starts handled at once, so that the arrays stay in a core's cache.
BLOCK = 1 << 15
_U = np.uint64
_POSITION_BITS = 20
#: What a row of the contexts is: an anchor's surroundings, or a cover that its own text settled (its end is the key).
CONTEXT, COVER = 0, 1
_BASE = 0x9E3779B97F4A7C15 | 1

#: From the right contexts (and the unit, bytes of a token): groups (common right tokens, members), children before parents.
GroupIndex = Callable[[list[bytes], int], Iterable[tuple[int, list[int]]]]


@dataclass(frozen=True)
class Frame:
    """What tells the byte and the word operator apart."""

    width: int
    slack: int
    unit: int  # bytes of a token in a context
    order: int  # tokens whose hash picks the anchor
    split: Callable[[str], object]  # text -> tokens
    hashes: Callable[[object], np.ndarray]  # tokens -> 64-bit hash of each
    contexts: Callable[[object, np.ndarray], np.ndarray]  # tokens, hashes -> array of the context's units
    join: Callable[[object, list[tuple[int, int]]], bytes]  # tokens, kept runs -> bytes
    index: GroupIndex
    #: Places of one key that a task holds at once.
    most: int = 1 << 11

    @property
    def key(self) -> int:
        return self.width - self.slack


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _BASE, _U), np.full(size, pow(_BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return _powers[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def _sums(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h) + 1, _U)
    np.cumsum(h * _power_tables(len(h))[0][: len(h)], out=out[1:])
    return out


def _runs(sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` tokens from each of ``at`` on, by their sums."""
    return _mix((sums[at + length] - sums[at]) * _power_tables(len(sums))[1][at])


def anchors(h: np.ndarray, frame: Frame) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) of the anchors of a text with token hashes ``h``."""
    starts = len(h) - frame.width + 1
    all_at, all_keys = [], []
    for a in range(0, max(starts, 0), BLOCK):
        b = min(a + BLOCK, starts)
        part = h[a : b + frame.width - 1]
        sums = _sums(part)
        n = b - a + frame.slack  # positions that can be anchors here
        places = np.arange(n)
        value = (_runs(sums, places, frame.order) >> _U(_POSITION_BITS) << _U(_POSITION_BITS)) | places.astype(_U)
        span, reach = 1, frame.slack + 1
        while span < reach:  # sliding minimum over ``reach`` positions by doubling
            step = min(span, reach - span)
            value = np.minimum(value[: len(value) - step], value[step:])
            span += step
        at = (value & _U((1 << _POSITION_BITS) - 1)).astype(np.int64)
        at = at[np.r_[True, at[1:] != at[:-1]]]
        all_at.append(at + a)
        all_keys.append(_runs(sums, at, frame.key))
    if not all_at:
        return np.empty(0, np.int64), np.empty(0, _U)
    at, keys = np.concatenate(all_at), np.concatenate(all_keys)
    new = np.r_[True, at[1:] != at[:-1]]
    return at[new], keys[new]


# -------------------------------------------------------------------- groups
def common(a: int, b: int, bits: int, unit: int) -> int:
    """Tokens that two contexts, as padded big-endian numbers of ``bits`` bits, share at their start."""
    return (bits - (a ^ b).bit_length()) // (8 * unit)


def group_cover(rights: list[bytes], lefts: list[bytes], frame: Frame) -> list[list[tuple[int, int]]]:
    """For each member of a key's group the (left, right) token extents of the windows it shares."""
    unit, slack = frame.unit, frame.slack
    bits = 8 * unit * slack
    cover: list[list[tuple[int, int]]] = [[] for _ in rights]
    same: dict[tuple[bytes, bytes], list[int]] = {}
    for i, pair in enumerate(zip(lefts, rights, strict=True)):
        same.setdefault(pair, []).append(i)
    distinct = list(same)
    for (left, right), members in same.items():
        if len(members) > 1 and (len(left) + len(right)) // unit >= slack:
            for i in members:
                cover[i].append((len(left) // unit, len(right) // unit))
    if len(distinct) == 1:
        return cover
    left_rank = {x: r for r, x in enumerate(sorted({p[0] for p in distinct}))}
    rank = [left_rank[p[0]] for p in distinct]
    number = [int.from_bytes(p[0].ljust(unit * slack, b"\0"), "big") for p in distinct]
    length = [len(p[0]) // unit for p in distinct]

    def agree(i: int, j: int) -> int:
        return min(length[i], length[j], common(number[i], number[j], bits, unit))

    # how far any other member agrees to the left: a member that has reached it is done, since children come first
    most = [0] * len(distinct)
    everyone = sorted(range(len(distinct)), key=rank.__getitem__)
    for i, j in zip(everyone, everyone[1:], strict=False):
        far = agree(i, j)
        most[i], most[j] = max(most[i], far), max(most[j], far)
    reached = [-1] * len(distinct)
    done = np.zeros(len(distinct), bool)
    for i, pair in enumerate(distinct):
        if len(same[pair]) > 1 and (len(pair[0]) + len(pair[1])) // unit >= slack:
            reached[i], done[i] = length[i], True
    ranks = np.array(rank)
    for depth, members in frame.index([p[1] for p in distinct], unit):
        need = slack - depth
        group = np.array(members)
        active = group[~done[group]]
        if not len(active):
            continue
        group = group[np.argsort(ranks[group], kind="stable")]
        ordered = ranks[group]
        low, high = (np.searchsorted(ordered, ranks[active], side=side) for side in ("left", "right"))
        for i, x, y in zip(active.tolist(), low.tolist(), high.tolist(), strict=True):
            if y - x > 1:  # another member has the same left context
                left = length[i]
            else:
                left = max(agree(i, int(group[x - 1])) if x else 0, agree(i, int(group[y])) if y < len(group) else 0)
            if left >= need and left > reached[i]:
                for k in same[distinct[i]]:
                    cover[k].append((left, depth))
                reached[i] = left
                done[i] = left >= most[i]
    return cover


# ------------------------------------------------------------------ dataflow
def address(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the texts there are; a hash of the text stands for an id that is null (``twin`` settles a clash)."""
    return docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("doc_id"), "text")


def _pass_columns(arrays: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names=names)


def covered(docs: DataFrame, frame: Frame) -> tuple[DataFrame, DataFrame]:
    """(address, copies, rep, twin, cid, times) of each distinct text and (rep, twin, tokens, removed, spans, kept_sha256) of those with a repeat.

    ``address`` is 128 bits of the text; inside, the pair of ``rep`` (its smallest
    doc_id) and ``twin`` (which numbers the texts of a repeated doc_id, so nearly
    always 0 and free to ship) stands for it.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    texts = _texts(docs)
    cid = F.xxhash64("text")
    each = texts.select("doc_id", address(F.col("text")).alias("address"), cid.alias("cid"))
    # rows that are alike in full are counted first: a class has to know how often its own row comes
    alike = each.groupBy("address", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.min("cid").alias("cid"))
    classes = alike.groupBy("address").agg(F.sum("times").alias("copies"), F.min("doc_id").alias("rep"), F.min_by("times", "doc_id").alias("times"), F.min("cid").alias("cid"))
    classes = stored(classes.withColumn("twin", F.row_number().over(Window.partitionBy("rep").orderBy("cid", "address")) - 1))

    def own(some: DataFrame) -> DataFrame:
        """The rows that stand for ``some`` of the classes; these are the small side, so texts are never sorted."""
        named = some.select("rep", "cid", "twin").hint("shuffle_hash")
        return texts.join(named, (F.col("doc_id") == F.col("rep")) & (cid.bitwiseXOR(F.col("cid")) == 0)).select("text", "rep", "twin")

    # the distinct texts; of a row that comes again one is taken
    picked, again = own(classes.where("times = 1")), classes.where("times > 1")
    if not again.isEmpty():
        picked = picked.unionByName(own(again).groupBy("rep", "twin").agg(F.first("text").alias("text")))
    distinct = bucketed(picked, "rep")

    def fetch(side: DataFrame, *columns: str) -> DataFrame:
        """Distinct texts with what ``side`` (rep, twin, ...) has for them.

        The twins meet in a difference and not as a key of the join: the texts
        stay as they are dealt, by rep.
        """
        named = side.select(F.col("rep").alias("own"), F.col("twin").alias("own_twin"), *columns).hint("shuffle_hash")
        return distinct.join(named, (F.col("rep") == F.col("own")) & (F.col("twin") - F.col("own_twin") == 0)).select("text", "rep", "twin", *columns)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, reps, twins, places, more = [], [], [], [], []
            for text, rep, twin in zip(batch.column("text"), batch.column("rep").to_pylist(), batch.column("twin").to_pylist(), strict=True):
                at, key = anchors(frame.hashes(frame.split(text.as_py())), frame)
                order = np.argsort(key, kind="stable")
                at, key = at[order], key[order]
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
                ends = np.r_[starts[1:], len(key)]
                keys.append(key[starts])
                places.append(at[starts])
                # a text gives one row for a key; further places, which periodic texts have, are packed
                more += [at[s + 1 : e].tobytes() if e - s > 1 else None for s, e in zip(starts.tolist(), ends.tolist(), strict=True)] if len(starts) < len(key) else [None] * len(starts)
                reps.append(np.full(len(starts), rep, np.int64))
                twins.append(np.full(len(starts), twin, np.int32))
            if keys:
                yield _pass_columns([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (reps, twins, places)), pa.array(more, pa.binary())], ["key", "rep", "twin", "at", "more"])

    marks = stored(distinct.select("text", "rep", "twin").mapInArrow(find, "key long, rep long, twin int, at long, more binary"))
    places = F.count(F.lit(1)) + F.coalesce(F.sum(F.octet_length("more")), F.lit(0)) / 8
    twice = stored(marks.groupBy("key").agg(places.cast("long").alias("places")).where("places > 1"))

    def listed(keys: DataFrame) -> DataFrame:
        """(rep, twin, marks): each text's anchors with one of ``keys``; one exchange serves the lists and their join with the texts."""
        return marks.join(keys.select("key"), "key").repartition("rep").groupBy("rep", "twin").agg(F.collect_list(F.struct("at", "key", "more")).alias("marks"))

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slack, size, unit = frame.slack, frame.key, frame.unit
        names = ["key", "kind", "rep", "twin", "at", "left", "right"]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        for batch in batches:
            for text, rep, twin, own in zip(batch.column("text"), batch.column("rep").to_pylist(), batch.column("twin").to_pylist(), batch.column("marks"), strict=True):
                tokens = frame.split(text.as_py())
                h = frame.hashes(tokens)
                units = frame.contexts(tokens, h)
                raw, back = units.tobytes(), units[::-1].tobytes()
                total, rows = len(h), []
                met: dict[tuple[int, bytes, bytes], list[int]] = {}
                for key, at in unpacked(own.as_py()):
                    low = total - at
                    met.setdefault((key, back[low * unit : (low + slack) * unit], raw[(at + size) * unit : (at + size + slack) * unit]), []).append(at)
                settled = []
                for (key, left, right), places in met.items():
                    if len(places) > 1 and (len(left) + len(right)) // unit >= slack:
                        # met again in this very text, as in a periodic one: covered already, and one of them stands for all
                        settled += [(at - len(left) // unit, at + size + len(right) // unit) for at in places]
                        places = places[:1]
                    rows += [(key, CONTEXT, rep, twin, at, left, right) for at in places]
                rows += [(end, COVER, rep, twin, start, b"", b"") for start, end in merged(settled)]
                for x in range(0, len(rows), 4096):
                    yield _pass_columns([pa.array(c, t) for c, t in zip(zip(*rows[x : x + 4096], strict=True), kinds, strict=True)], names)

    def contexts(keys: DataFrame) -> DataFrame:
        return fetch(listed(keys), "marks").mapInArrow(surround, "key long, kind int, rep long, twin int, at long, left binary, right binary")

    small, large = F.col("places") <= frame.most, twice.where(F.col("places") > frame.most)
    groups, known = [contexts(twice.where(small))], []
    if not large.isEmpty():
        more_groups, known = _split(stored(contexts(large), wide=True), frame)
        groups += more_groups
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = reduce(DataFrame.unionByName, groups).repartition(parts, "key", "kind").sortWithinPartitions("key", "kind", "rep", "twin", "at")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []

        def solve(rows: list[tuple]) -> None:
            if len(rows) < 2:
                return
            for row, extents in zip(rows, group_cover([r[6] for r in rows], [r[5] for r in rows], frame), strict=True):
                for left, right in set(extents):
                    out.append((row[2], row[3], row[4] - left, row[4] + frame.key + right))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            batch = _pass_columns([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["rep", "twin", "start", "end"])
            out.clear()
            return batch

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1] == COVER:
                    out.append((row[2], row[3], row[4], row[0]))
                    continue
                if held and held[0][0] != row[0]:
                    solve(held)
                    held = []
                held.append(row)
            if len(out) > 4096:
                yield flush()
        solve(held)
        if out:
            yield flush()

    found = reduce(DataFrame.unionByName, [met.mapInArrow(compare, "rep long, twin int, start long, end long"), *known])
    spans = found.groupBy("rep", "twin").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "twin", "tokens", "removed", "spans", "kept_sha256"]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            rows = []
            for text, rep, twin, listed in zip(batch.column("text"), batch.column("rep").to_pylist(), batch.column("twin").to_pylist(), batch.column("spans"), strict=True):
                tokens = frame.split(text.as_py())
                runs = merged([(s["start"], s["end"]) for s in listed.as_py()])
                kept = kept_runs(runs, len(tokens))
                rows.append((rep, twin, len(tokens), sum(e - s for s, e in runs), len(runs), hashlib.sha256(frame.join(tokens, kept)).hexdigest()))
            if rows:
                yield _pass_columns([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    results = fetch(spans, "spans").mapInArrow(remove, "rep long, twin int, tokens long, removed long, spans long, kept_sha256 string")
    return classes, results


def _split(rows: DataFrame, frame: Frame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of contexts whose keys stand at too many places: the smaller groups they fall into, and (rep, twin, start, end) of what is covered already.

    A window around an anchor takes x tokens from its left and ``slack`` - x from its
    right.  For a range of x, what all its windows hold is the longer prefix that
    places have to share; places that share even what any of its windows holds are
    covered as far as that goes, and one of them stands for all from there on.
    """
    unit, slack, size = frame.unit, frame.slack, frame.key
    place = ["rep", "twin", "at"]

    def code(*parts: Column) -> Column:
        return F.unhex(F.md5(F.concat(*parts)))

    def number(*values: Column) -> Column:
        return F.concat_ws(":", *[v.cast("string") for v in values], F.lit("")).cast("binary")

    def part(column: str, tokens: str) -> Column:
        return F.expr(f"substring({column}, 1, ({tokens}) * {unit})")

    length = lambda c: (F.octet_length(c) / unit).cast("long")
    known = [rows.where(F.col("kind") == COVER).select("rep", "twin", F.col("at").alias("start"), F.col("key").alias("end"))]
    groups: list[DataFrame] = []
    live, reach = rows.where(F.col("kind") == CONTEXT).select("key", *place, "left", "right", F.lit(0).alias("x")), slack + 1
    while True:
        here = live.withColumn("last", F.least(F.col("x") + (reach - 1), F.lit(slack)))
        some = (length("left") >= F.col("x")) & (length("right") >= slack - F.col("last")) & (length("left") + length("right") >= slack)
        left, right = part("left", "last"), part("right", f"{slack} - x")
        coded = here.where(some).select(
            "key", *place, "left", "right", "x", length(left).cast("long").alias("before"), length(right).cast("long").alias("after"),
            code(number(F.col("key"), F.col("x"), F.octet_length(left)), left, right).alias("whole"),
            code(number(F.col("key"), F.col("x")), part("left", "x"), part("right", f"{slack} - last")).alias("prefix"),
        )
        dealt = stored(coded)
        carried = ["prefix", "key", "left", "right", "x"]
        classes = stored(dealt.groupBy("whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*place, *carried)).alias("head")).select("whole", "n", "head.*"))
        repeated = dealt.join(classes.where("n > 1").select("whole"), "whole").where(F.col("before") + F.col("after") >= slack)
        known.append(repeated.select("rep", "twin", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + size + F.col("after")).alias("end")))
        met = classes.select(*carried, *place).join(stored(classes.groupBy("prefix").agg(F.count(F.lit(1)).alias("m")).where("m > 1")), "prefix")
        groups.append(met.where(F.col("m") <= frame.most).select(F.xxhash64("prefix").alias("key"), F.lit(CONTEXT).alias("kind"), *place, "left", "right"))
        large = met.where(F.col("m") > frame.most)
        if reach == 1 or large.isEmpty():
            return groups, known
        reach = _finer(reach, slack)
        ranges = F.filter(F.array(*[F.col("x") + j * reach for j in range(4)]), lambda x: x <= slack)
        live = large.select("key", *place, "left", "right", F.explode(ranges).alias("x"))


def _finer(reach: int, slack: int) -> int:
    """A quarter of a range; the first is the power of four whose fourfold holds all windows."""
    if reach <= slack:
        return reach // 4
    reach = 1
    while 4 * reach < slack + 1:
        reach *= 4
    return reach


def unpacked(marks: list[dict]) -> Iterator[tuple[int, int]]:
    for mark in marks:
        yield mark["key"], mark["at"]
        if mark["more"]:
            for at in np.frombuffer(mark["more"], np.int64).tolist():
                yield mark["key"], at


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
        else:
            runs.append((start, end))
    return runs


def kept_runs(runs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    kept, at = [], 0
    for start, end in runs:
        if start > at:
            kept.append((at, start))
        at = end
    return kept + ([(at, n)] if at < n else [])


def digest(docs: DataFrame, frame: Frame) -> DataFrame:
    """(doc_id, tokens, removed, spans, kept_sha256) for every row of ``docs``."""
    classes, results = covered(docs, frame)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [frame.split(t.as_py() or "") for t in batch.column("text")]
            shas = [hashlib.sha256(frame.join(t, [(0, len(t))] if len(t) else [])).hexdigest() for t in tokens]
            yield _pass_columns([batch.column("doc_id"), batch.column("address"), pa.array([len(t) for t in tokens], pa.int64()), pa.array(shas, pa.string())], ["doc_id", "address", "n", "sha"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), address(F.col("text")).alias("address"), "text").mapInArrow(count, "doc_id long, address binary, n long, sha string")
    # written out: the last join then deals both its sides itself and can split a text with very many copies
    known = stored(classes.join(results, ["rep", "twin"], "left").drop("rep", "twin", "cid", "times"))
    whole = (F.col("copies") > 1) & (F.col("n") >= frame.width)
    pick = lambda all_gone, part, none: F.when(whole, all_gone).otherwise(F.coalesce(part, none))
    return rows.join(known, "address", "left").select(
        "doc_id",
        F.col("n").alias("tokens"),
        pick(F.col("n"), F.col("removed"), F.lit(0).cast("long")).alias("removed"),
        pick(F.lit(1).cast("long"), F.col("spans"), F.lit(0).cast("long")).alias("spans"),
        pick(F.sha2(F.lit(""), 256), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"),
    )
