"""SimHash near-duplicates found with pivot distance tables.

1. Each text gets a 64-bit fingerprint; documents with one fingerprint form a
   class, so copies are never expanded into pairs.
2. Distinct fingerprints are dealt to small buckets.  Up to ``EXACT`` differing
   bits the buckets are exact: of four 16-bit blocks one must agree, and of the
   four quarters of the other 48 bits again one.
3. Inside a bucket a table of Hamming distances to ``PIVOTS`` reference
   fingerprints is kept, sorted by the first pivot.  By the triangle inequality
   a pair whose coordinates differ by more than the limit anywhere cannot link;
   what survives is verified on the fingerprints themselves.
4. A bucket returns a spanning forest of its links (at most one row for each
   fingerprint, never all pairs), and the components are joined up by
   alternating star contractions, with a checkpoint for each round.

Defined cases: null and empty texts and texts without a word have fingerprint
zero and link like any other; fewer words than a shingle make one shingle;
repeated rows and ties share a class, whose smallest doc_id represents it; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, cut, free_name, stored

EXACT = 3
PIVOTS = 24
#: Rows of a bucket compared at once.
BLOCK = 512
SEED = 42
#: Bands of minima that make candidates for shingle sets, and minima of a band.
BANDS, ROWS = 16, 4
#: Sets of one group that a task holds to ask, and to ask against.
GROUP = 1024


# ---------------------------------------------------------------- fingerprints
def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``k`` words of the text, A-Z in lower case."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= k:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    runs = zip(*(words[i:] for i in range(k)), strict=False)
    return np.fromiter((xxh64_intdigest(s, SEED) for s in map(b" ".join, runs)), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``; fp is the fingerprint as a signed long."""
    bound_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(text.as_py(), k)) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# ------------------------------------------------------------------- buckets
def exact_tables() -> list[list[int]]:
    """Sixteen lists of 28 bits: any two fingerprints with at most 3 differing bits agree on all bits of one."""
    tables = []
    for b in range(4):
        block = list(range(16 * b, 16 * b + 16))
        rest = [i for i in range(64) if i not in block]
        tables += [block + rest[12 * q : 12 * q + 12] for q in range(4)]
    return tables


def _keys(fps: np.ndarray, bits: list[int], table: int) -> np.ndarray:
    key = np.full(len(fps), table, np.uint64)
    for b in bits:
        key = (key << np.uint64(1)) | ((fps >> np.uint64(b)) & np.uint64(1))
    return key.view(np.int64)


def _pivots() -> np.ndarray:
    draw = random.Random(SEED + 1)
    return np.array([draw.getrandbits(64) for _ in range(PIVOTS)], np.uint64)


class _Forest:
    """Union-find over the places of a bucket, with an array of roots that lags behind by one chunk of pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def join(self, xs: np.ndarray, ys: np.ndarray) -> None:
        """Join the pairs; those that are joined already are not looked at again."""
        at, size = 0, 4096
        roots = self.roots()
        while at < len(xs):
            x, y = xs[at : at + size], ys[at : at + size]
            at += size
            apart = roots[x] != roots[y]
            x, y = x[apart], y[apart]
            if not len(x):
                size = min(2 * size, 1 << 18)
                continue
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                p, q = self.find(p), self.find(q)
                if p != q:
                    self.parent[max(p, q)] = min(p, q)
            roots = self.roots()


def bucket_links(fps: np.ndarray, reps: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within one bucket, as pairs (smaller rep, other rep)."""
    pivots = _pivots()
    table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    fps, reps, table = fps[order], reps[order], table[order]
    first, forest = table[:, 0], _Forest(len(fps))
    for a in range(0, len(fps), BLOCK):
        end = min(a + BLOCK, len(fps))
        last = int(np.searchsorted(first, first[end - 1] + limit, side="right"))
        for b in range(a, last, BLOCK):
            stop = min(b + BLOCK, last)
            near = np.ones((end - a, stop - b), bool)
            for p in range(PIVOTS):
                near &= np.abs(table[a:end, p, None] - table[None, b:stop, p]) <= limit
            i, j = np.nonzero(near)
            up = a + i < b + j
            i, j = a + i[up], b + j[up]
            good = np.bitwise_count(fps[i] ^ fps[j]) <= limit
            forest.join(i[good], j[good])
    roots = forest.roots()
    least_rep = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(least_rep, roots, reps)
    head = least_rep[roots]
    return [(int(h), int(r)) for h, r in zip(head, reps, strict=True) if h != r]


def links(nodes: DataFrame, limit: int = EXACT) -> DataFrame:
    """(u, v), u < v: enough links between class representatives (fp, rep), with distinct fp, to join what is connected."""
    spark = nodes.sparkSession
    tables = exact_tables()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for t, bits in enumerate(tables):
                yield pa.RecordBatch.from_arrays([pa.array(_keys(fps, bits, t)), *batch.columns], names=["key", *batch.schema.names])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(rows: pa.Table) -> pa.RecordBatch | None:
            key = rows.column("key").to_numpy()
            fps, reps = rows.column("fp").to_numpy().view(np.uint64), rows.column("rep").to_numpy()
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
            many = np.flatnonzero(ends - starts > 1)
            out: list[tuple[int, int]] = []
            for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
                out += bucket_links(fps[s:e], reps[s:e], limit)
            if out:
                uv = np.array(out, np.int64)
                return pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], names=["u", "v"])
            return None

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            change = np.flatnonzero(key != key[-1])
            if not len(change):  # the whole batch may belong to the bucket that is open
                if held and held[-1].column("key")[-1].as_py() != key[-1]:
                    if (found := solve(pa.Table.from_batches(held))) is not None:
                        yield found
                    held = []
                held.append(batch)
                continue
            split = int(change[-1]) + 1
            if (found := solve(pa.Table.from_batches([*held, batch.slice(0, split)]))) is not None:
                yield found
            held = [batch.slice(split)]
        if held and (found := solve(pa.Table.from_batches(held))) is not None:
            yield found

    dealt = nodes.select("fp", "rep").mapInArrow(deal, "key long, fp long, rep long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # within a bucket the order is by rep, so that results do not depend on the order of arrival
    met = dealt.repartition(parts, "key").sortWithinPartitions("key", "rep").mapInArrow(meet, "u long, v long")
    return met.distinct()


# ---------------------------------------------------------------- components
def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (u, v).

    Alternating large-star and small-star contractions; each keeps the components
    and ends in stars around their smallest nodes.  Minima are pre-aggregated and
    joined back, so a hub is a skewed join and no list is ever gathered.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.union(pairs.select(F.col("v"), F.col("u")))
        else:
            both = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # written, so that the join deals both sides itself and can split a hub
        least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        joined = both.join(least, "u")
        if large:
            moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where(F.col("u") != F.col("m")).select("u", F.col("m").alias("v")))
        return moved.where(F.col("u") != F.col("v")).distinct()

    def state(pairs: DataFrame) -> tuple:
        row = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        return tuple(row)

    pairs = cut(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now = state(pairs)
    while now[0]:
        pairs = cut(star(star(pairs, True), False))
        before, now = now, state(pairs)
        if before == now:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())


# ------------------------------------------------------------------ operators
def simhash_components(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) with links at up to ``EXACT`` differing bits."""
    marked = cut(fingerprints(docs, k))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = components(links(classes))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """The rows of the ``op8`` contract."""
    return simhash_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set of shingle hashes, each from ``ROWS`` minima under seeded permutations."""
    draw = np.random.default_rng(SEED)
    up, add = (draw.integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 12):
        x = shingles[None, at : at + (1 << 12)] * up + add
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        least = np.minimum(least, x.min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``similarity`` or more."""
    if min(len(a), len(b)) < (similarity - 1e-9) * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) >= similarity


def set_links(asked: list[tuple[int, int, np.ndarray]], against: list[tuple[int, int, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """(rep, rep) links of the (rep, component, set) rows ``asked`` with those ``against``, as many as connect what is apart."""
    names = {c: k for k, c in enumerate({c for _, c, _ in asked} | {c for _, c, _ in against})}
    forest = _Forest(len(names))
    sizes = np.array([len(x) for _, _, x in against])
    component = np.array([names[c] for _, c, _ in against])
    found = []
    for rep, own, x in asked:
        fits = np.minimum(sizes, len(x)) >= (similarity - 1e-9) * np.maximum(sizes, len(x))
        for j in np.flatnonzero(fits & (forest.roots()[component] != forest.find(names[own]))).tolist():
            p, q = forest.find(names[own]), forest.find(int(component[j]))
            if p != q and alike(x, against[j][2], similarity):
                found.append((rep, against[j][0]))
                forest.parent[max(p, q)] = min(p, q)
    return found


def _longs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    uv = np.array(rows, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], names=["u", "v"])


def _group_links(members: DataFrame, sets: DataFrame, joined: DataFrame, similarity: float, most: int) -> DataFrame:
    """(u, v) of the groups that ``joined`` (node, component) leaves in parts.

    Their members outside the group's largest part are asked against all, in
    blocks of about ``most``: what is inside that part is connected already.
    """
    own = members.join(joined, members["rep"] == joined["node"], "left").select("key", "n", "rep", "address", F.coalesce("component", "rep").alias("component"))
    own = stored(own.where("n > 2"))  # of two members the centre's comparison is all there is
    parts = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = parts.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.count(F.lit(1)).alias("parts"), F.max("size").alias("size"))
    open_groups = stored(largest.where("parts > 1").select("key", "largest", "size"))
    rows = own.join(open_groups, "key")
    blocks = lambda size: F.ceil(size / F.lit(float(most))).cast("int")
    asks, number = F.col("component") != F.col("largest"), F.xxhash64("address")
    all_blocks, ask_blocks = blocks(F.col("n")), blocks(F.col("n") - F.col("size"))
    every = lambda count: F.sequence(F.lit(0), count - 1)
    place = ["key", "rep", "address", "component"]
    asked = rows.where(asks).select(*place, F.pmod(number, ask_blocks).cast("int").alias("i"), F.explode(every(all_blocks)).alias("j"), F.lit(0).alias("role"))
    against = rows.select(*place, F.explode(every(ask_blocks)).alias("i"), F.pmod(number, all_blocks).cast("int").alias("j"), F.lit(1).alias("role"))
    dealt = asked.unionByName(against).join(sets, "address")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        now = None
        for batch in batches:
            for key, i, j, role, rep, component, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != now:
                    if found := set_links(*held, similarity):
                        yield _longs(found)
                    held, now = ([], []), (key, i, j)
                held[role].append((rep, component, np.frombuffer(shingles, np.uint64)))
        if found := set_links(*held, similarity):
            yield _longs(found)

    parts_wanted = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    met = dealt.select("key", "i", "j", "role", "rep", "component", "shingles").repartition(parts_wanted, "key", "i", "j").sortWithinPartitions("key", "i", "j", "role", "rep")
    return met.mapInArrow(meet, "u long, v long").distinct()


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """(u, v, c_address, address) of classes (rep, address, fp) to compare: what ``links`` joins, and each class with the first one of its fingerprint."""
    named = classes.where(F.col("rep").isNotNull()).select("rep", "address", "fp")
    heads = stored(named.groupBy("fp").agg(F.min(F.struct("rep", "address")).alias("head")).select("fp", "head.rep", "head.address"))
    at = lambda end, address: heads.select(F.col("rep").alias(end), F.col("address").alias(address))
    near = links(heads).join(at("u", "c_address"), "u").join(at("v", "address"), "v")
    same = named.join(heads.select("fp", F.col("rep").alias("u"), F.col("address").alias("c_address")), "fp").where(F.col("address") != F.col("c_address"))
    return near.select("u", "v", "c_address", "address").unionByName(same.select("u", F.col("rep").alias("v"), "c_address", "address"))


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, most: int = GROUP) -> DataFrame:
    """(doc_id, component_id) on ``k``-word shingle sets of at least ``similarity``.

    Each set has its fingerprint, and pivot distance tables in exact buckets find
    what lies within ``EXACT`` bits, as for ``simhash_components``.  Sets at the
    limit differ in about ten bits, so that is not all: sets that agree on one of
    ``BANDS`` bands of ``ROWS`` minima are a group (a pair at 0.8 is with 99.98 %,
    one at 0.85 with 99.999 %); of groups with the same members one is looked at.
    All comparisons are exact, on the sets.  First come the pairs of the pivot
    tables, and each member of a group with its centre, one pair for each, however
    large the group; what that leaves in parts is compared in full by ``_group_links``.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), k)) for t in batch.column("text")]
            addresses = pa.array([hashlib.md5(x.tobytes()).digest() for x in sets], pa.binary())
            fps = pa.array(np.array([fingerprint(x) for x in sets], np.uint64).view(np.int64))
            keys = pa.array([band_keys(x).tolist() if len(x) else [] for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), addresses, fps, keys], names=["doc_id", "address", "fp", "keys"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # rows that repeat an id stand in one partition
        for batch in batches:
            rows = []
            for text, address in zip(batch.column("text"), batch.column("address").to_pylist(), strict=True):
                if address not in seen and hashlib.md5(own := np.unique(shingle_hashes(text.as_py(), k)).tobytes()).digest() == address:  # not another text of the same id
                    seen.add(address)
                    rows.append((address, own))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], names=["address", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(*(batch.column(c) for c in ("shingles", "c_shingles")), strict=True)
            yield batch.select(["u", "v"]).filter(pa.array([alike(*(np.frombuffer(x.as_py(), np.uint64) for x in p), similarity) for p in pairs], pa.bool_()))

    marked = stored(texts.mapInArrow(mark, "doc_id long, address binary, fp long, keys array<long>"))
    classes = stored(marked.groupBy("address").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    met = stored(fingerprint_pairs(classes))
    bands = classes.where(F.col("rep").isNotNull()).select(F.explode("keys").alias("key"), "rep", "address")
    shared = stored(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = stored(bands.join(shared, "key"))
    seen = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col("address")))
    groups = members.groupBy("key", "n").agg(F.min(F.struct("rep", "address")).alias("center"), seen(1).alias("a"), seen(2).alias("b"))
    members = stored(members.join(stored(groups.groupBy("n", "a", "b").agg(F.min("key").alias("key"), F.min("center").alias("center")).select("key", "center")), "key"))
    wanted = members.select("rep", "address").union(met.select("u", "c_address")).union(met.select("v", "address")).distinct()
    sets = stored(texts.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("rep")).select("text", "address").mapInArrow(fetch, "address binary, shingles binary"), wide=True)
    central = members.where(F.col("address") != F.col("center.address")).select(F.col("center.rep").alias("u"), F.col("rep").alias("v"), F.col("center.address").alias("c_address"), "address")
    pairs = central.unionByName(met).distinct()
    both = pairs.join(sets, "address").join(sets.select(F.col("address").alias("c_address"), F.col("shingles").alias("c_shingles")), "c_address")
    linked = stored(both.select("u", "v", "shingles", "c_shingles").mapInArrow(verify, "u long, v long"), wide=True)
    found = components(linked.unionByName(_group_links(members, sets, components(linked), similarity, most)))
    ends = classes.select("address", "rep").join(found, F.col("rep") == F.col("node"), "left").select("address", F.coalesce("component", "rep").alias("component_id"))
    return marked.select("doc_id", "address").join(ends, "address").select("doc_id", "component_id")


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without near-duplicates of a kept one: the smallest doc_id of each group stays.

    Rows that repeat a doc_id stand or fall together.
    """
    grouped, name = near_duplicates(docs, k, similarity), free_name(docs, "gone")
    gone = grouped.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"].cast("long") == F.col(name), "left_anti")
