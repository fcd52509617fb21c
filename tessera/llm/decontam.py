"""Benchmark decontamination with CGK embeddings and bit-sampling LSH.

A document leaks an item if some run of its words lies within ``1 - similarity``
of the item's words in edit distance (word insertions, deletions, changes), in
lower case and without punctuation.

1. Items of about one length (within ``GROWTH``) form a size class.  In documents
   the windows of each class are those word positions behind which enough q-grams
   of benchmark items follow: a run within e edits of an item of n words keeps at
   least n - q + 1 - e q of the item's q-grams, so no leak is lost.  Which q-grams
   items have is told by a bit map of fixed size.
2. The CGK random walk embeds a window as a sequence of symbols: a shared random
   bit for each (step, word) tells whether the walk moves on.  Sequences at a
   small edit distance get embeddings at a small Hamming distance.  ``WALKS``
   independent walks are sampled, each several times at ``SAMPLE`` steps; a sample
   is the key of a bucket.  ``tests/llm`` measures the recall at the edit limit.
3. Buckets meet as tables: the keys of windows (those that a second bit map of
   fixed size lets through) are joined with the keys of items, and each distinct
   pair of window and item is verified by its exact semi-global edit distance.

Nothing of the benchmark reaches the driver but the two bit maps and one row for
each size class.  A passage that very many documents leak makes rows in proportion
to those documents, and what it meets are the few items with its key.

Defined cases: null and empty texts leak nothing and null, empty or word-less
items match nothing; equal items are reported each by its item_id; repeated
documents are reported as often as they stand there; of equal matches the first
in the text counts; empty tables give an empty result; extra columns are ignored
(``drop_leaking`` passes them through).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, free_name, stored

SIMILARITY = 0.8
SAMPLE = 3
WALKS = 10
#: Words of an item for each word between windows.
STRIDE = 10
#: Lengths of a size class differ by less than this factor.
GROWTH = 1.1
MOST_Q = 4
SEED = 11
#: Bits of each map, by their logarithm; a fuller map lets more windows through and loses none.
MAP_BITS = 26
#: Words of documents with windows that are embedded at once, and numbers in the arrays for it.
HELD_WORDS = 200_000
EMBEDDED = 4_000_000
#: Words whose hash a worker remembers.
REMEMBERED = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_U = np.uint64


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n + 1e-9)


def gram_size(n: int, similarity: float = SIMILARITY) -> int:
    """Words of a q-gram of which an item of ``n`` words keeps one through all edits allowed."""
    return min(MOST_Q, n // (edits_allowed(n, similarity) + 1))


def size_class(n: int) -> int:
    return int(np.log(n) / np.log(GROWTH) + 1e-9)


class _Hashes(dict):
    """Words to 64-bit numbers, never 0."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = number = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) or 1
        return number

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), _U, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(32))


_FACTORS = _mixed(np.arange(1, 2 * max(MOST_Q, SAMPLE), dtype=_U)) | _U(1)


def gram_hashes(ids: np.ndarray, q: int) -> np.ndarray:
    if len(ids) < q:
        return np.empty(0, _U)
    h = np.full(len(ids) - q + 1, q, _U)
    for i in range(q):
        h += ids[i : len(ids) - q + 1 + i] * _FACTORS[i]
    return _mixed(h)


# ------------------------------------------------------------------ bit maps
def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the 64-bit word, and the bit in it."""
    place = hashes >> _U(64 - MAP_BITS)
    return (place >> _U(6)).astype(np.int64), _U(1) << (place & _U(63))


def has(bit_map: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    word, bit = _places(hashes)
    return (bit_map[word] & bit) != 0


# ---------------------------------------------------------------- embeddings
@dataclass(frozen=True)
class SizeClass:
    number: int
    low: int  # least and most words of its items
    high: int
    similarity: float

    @property
    def lengths(self) -> range:
        return range(self.low, self.high + 1)

    @property
    def q(self) -> int:
        return min(gram_size(n, self.similarity) for n in self.lengths)

    @property
    def need(self) -> int:
        """q-grams that a leaking run has in common with its item, at least."""
        return max(1, min(n - self.q + 1 - self.q * edits_allowed(n, self.similarity) for n in self.lengths))

    @property
    def edits(self) -> int:
        return edits_allowed(self.high, self.similarity)

    @property
    def stride(self) -> int:
        """Words from one window to the next; a run begins within half of it from a window, which costs an edit or two."""
        return max(1, self.low // STRIDE)

    @property
    def tables(self) -> int:
        """Samples of a walk: longer walks drift apart further at the same rate of edits."""
        return min(40, 8 + self.low // 8)

    @property
    def steps(self) -> int:
        """Steps of a walk through the shortest item of the class, which moves on at every other one."""
        return max(1, 2 * self.low - self.low // 10)


def _walk_keys(steps: int) -> np.ndarray:
    return np.stack([_mixed(np.arange(steps, dtype=_U) + _U((SEED + w) << 32)) for w in range(WALKS)], axis=1)


def _samples(size: SizeClass) -> np.ndarray:
    """(walks, tables, SAMPLE) steps of the class's walks."""
    return (np.random.default_rng(SEED).random((WALKS, size.tables, SAMPLE)) * size.steps).astype(np.int64)


def embedded(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int) -> np.ndarray:
    """(steps, walks, starts) symbols of the walks from ``starts``; ``words`` holds a 0 at each of ``ends``, which no walk passes."""
    keys = _walk_keys(steps)
    at = np.repeat(starts[None, :], WALKS, axis=0)
    out = np.empty((steps, WALKS, len(starts)), _U)
    for step in range(steps):
        out[step] = words[at]
        move = _mixed(out[step] + keys[step][:, None]) >> _U(63)
        at = np.minimum(at + move.astype(np.int64), ends)
    return out


def bucket_keys(symbols: np.ndarray, size: SizeClass) -> np.ndarray:
    """(starts, walks * tables) keys of the sampled symbols."""
    walks = np.arange(WALKS)[:, None, None]
    picked = symbols[_samples(size), walks]  # (walks, tables, SAMPLE, starts)
    key = _mixed(np.arange(WALKS * size.tables, dtype=_U) + _U(size.number << 32)).reshape(WALKS, size.tables, 1)
    for s in range(SAMPLE):
        key = key + picked[:, :, s] * _FACTORS[s]
    return _mixed(key).reshape(WALKS * size.tables, -1).T


def item_keys(ids: np.ndarray, size: SizeClass) -> np.ndarray:
    words = np.append(ids, _U(0))
    return bucket_keys(embedded(words, np.zeros(1, np.int64), np.array([len(ids)]), size.steps), size)[0]


# ------------------------------------------------------------------- windows
class Finder:
    """Windows of documents that fall into a bucket with an item, by the bit maps."""

    def __init__(self, classes: list[SizeClass], grams: bytes, keys: bytes):
        self.classes = classes
        self.grams, self.keys = (np.frombuffer(zlib.decompress(x), _U) for x in (grams, keys))
        self.facts = [(c, c.q, c.need, c.high + c.edits, c.stride) for c in classes]
        self.sizes = sorted({q for _, q, _, _, _ in self.facts})
        self.held: list[tuple[tuple, np.ndarray, list[tuple[int, np.ndarray]]]] = []
        self.words = 0

    def add(self, label: tuple, ids: np.ndarray) -> bool:
        """Take a document in if it has a window; true when ``flush`` is due."""
        sums = {}
        for q in self.sizes:
            seen = has(self.grams, gram_hashes(ids, q))
            if seen.any():
                sums[q] = np.concatenate([[0], np.cumsum(seen)])
        windows = []
        for k, (_, q, need, span, stride) in enumerate(self.facts):
            if q in sums:
                total, last = sums[q], len(sums[q]) - 1
                starts = np.arange(0, len(ids), stride)
                low, high = np.minimum(np.maximum(starts - stride // 2, 0), last), np.minimum(starts + stride // 2 + span - q + 1, last)
                starts = starts[total[high] - total[low] >= need]
                if len(starts):
                    windows.append((k, starts))
        if windows:
            self.held.append((label, ids, windows))
            self.words += len(ids)
        return self.words >= HELD_WORDS

    def flush(self) -> Iterator[tuple]:
        """(label, class number, first, words around, distinct keys) for each run of windows with a bucket; words[0] is word ``first``."""
        if not self.held:
            return
        base = np.cumsum([0] + [len(ids) + 1 for _, ids, _ in self.held])
        words = np.concatenate([np.append(ids, _U(0)) for _, ids, _ in self.held])
        lists: dict[int, list[np.ndarray]] = {}
        for offset, (_, _, windows) in zip(base.tolist(), self.held, strict=False):
            for k, starts in windows:
                lists.setdefault(k, []).append(starts + offset)
        of_class = {k: np.concatenate(x) for k, x in lists.items()}
        every = np.unique(np.concatenate(list(of_class.values())))
        steps = max(self.classes[k].steps for k in of_class)
        hits: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        size = max(64, EMBEDDED // (steps * WALKS))
        for a in range(0, len(every), size):
            part = every[a : a + size]
            doc = np.searchsorted(base, part, side="right") - 1
            symbols = embedded(words, part, base[doc + 1] - 1, steps)
            for k, starts in of_class.items():
                mine = starts[np.searchsorted(starts, part[0]) : np.searchsorted(starts, part[-1], side="right")]
                if len(mine):
                    found = bucket_keys(symbols[: self.classes[k].steps][:, :, np.searchsorted(part, mine)], self.classes[k])
                    good = has(self.keys, found)
                    some = good.any(axis=1)
                    if some.any():
                        hits.setdefault(k, []).append((mine[some], found[some], good[some]))
        for k, parts in hits.items():
            size_class_, _, _, span, stride = self.facts[k]
            starts, found, good = (np.concatenate(x) for x in zip(*parts, strict=True))
            doc = np.searchsorted(base, starts, side="right") - 1
            for run in np.split(np.arange(len(starts)), np.flatnonzero((np.diff(starts) > span) | (np.diff(doc) > 0)) + 1):
                label, ids, _ = self.held[doc[run[0]]]
                offset = base[doc[run[0]]]
                first = max(0, int(starts[run[0]] - offset) - size_class_.edits - stride)
                around = ids[first : int(starts[run[-1]] - offset) + span + stride + 1]
                yield label, size_class_.number, first, around, np.unique(found[run][good[run]])
        self.held, self.words = [], 0


# -------------------------------------------------------------- verification
def least_edits(item: np.ndarray, words: np.ndarray, anywhere: bool = True) -> np.ndarray:
    """For each end in ``words`` the least edits that turn ``item`` into a run up to there, from anywhere or from the first word."""
    steps = np.arange(len(words) + 1)
    row = np.zeros_like(steps) if anywhere else steps
    for i, word in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] + (words != _U(word)), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    return row


def best_run(item: np.ndarray, words: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best run of ``words``, the first of equal ones, if it is near enough."""
    ends = least_edits(item, words)
    cost = int(ends.min())
    if cost > edits:
        return None
    end = int(ends.argmin())
    low = max(0, end - len(item) - cost)
    # backwards from the end gives the start; of several the one nearest to the item's length, then the first
    lengths = np.flatnonzero(least_edits(item[::-1], words[low:end][::-1], anywhere=False) == cost)
    best = min(lengths.tolist(), key=lambda x: (abs(x - len(item)), -x))
    return cost, end - best, end


# ------------------------------------------------------------------ dataflow
def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _items(benchmark: DataFrame, similarity: float) -> tuple[DataFrame, list[SizeClass]]:
    """(item, item_id, size, class, words) of the items with a word, and their size classes."""
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("size", pa.int64()), ("class", pa.int64()), ("words", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            rows = []
            for item, item_id, text in zip(*(batch.column(c) for c in ("item", "item_id", "text")), strict=True):
                ids = hashes.of(text.as_py())
                if len(ids):
                    rows.append((item.as_py(), item_id.as_py(), len(ids), size_class(len(ids)), ids.tobytes()))
            if rows:
                yield _batch(rows, schema)

    numbered = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    items = stored(numbered.mapInArrow(read, "item long, item_id long, size long, class long, words binary"))
    # one row a class, and classes grow with the logarithm of the longest item
    sizes = items.groupBy("class").agg(F.min("size").alias("low"), F.max("size").alias("high")).orderBy("class").collect()
    return items, [SizeClass(r["class"], r["low"], r["high"], similarity) for r in sizes]


def _bit_map(rows: DataFrame, hashes_of) -> bytes:
    """The packed map of the hashes that ``hashes_of`` gives for a batch; at most 2 ** (MAP_BITS - 6) rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes in hashes_of(batch):
                word, bit = _places(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], names=["word", "bits"])

    found = rows.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), _U)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(_U)
    return zlib.compress(out.tobytes(), 1)


def _with_keys(items: DataFrame, classes: dict[int, SizeClass]) -> DataFrame:
    """(item, class, keys) of the items' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [item_keys(np.frombuffer(w.as_py(), _U), classes[n]).view(np.int64).tolist() for w, n in zip(batch.column("words"), batch.column("class").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("class"), pa.array(keys, pa.list_(pa.int64()))], names=["item", "class", "keys"])

    return items.select("item", "class", "words").mapInArrow(run, "item long, class long, keys array<long>")


def leaking_rows(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(row, address, doc_id, item_id, start_word, end_word, edits, item_words); ``row`` numbers the rows of ``docs`` and ``address`` is 128 bits of the text."""
    spark = docs.sparkSession
    bound_arrow(spark)
    items, classes = _items(benchmark, similarity)
    by_number = {c.number: c for c in classes}
    sizes = sorted({c.q for c in classes})
    gram_map = _bit_map(items.select("words"), lambda batch: (gram_hashes(np.frombuffer(w.as_py(), _U), q) for w in batch.column("words") for q in sizes))
    with_keys = stored(_with_keys(items, by_number))
    key_map = _bit_map(with_keys.select("keys"), lambda batch: (np.array(k.as_py(), np.int64).view(_U) for k in batch.column("keys")))
    item_side = with_keys.select("item", "class", F.explode("keys").alias("key")).distinct()
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("address", pa.binary()), ("class", pa.int64()), ("first", pa.int64()), ("words", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, hashes = Finder(classes, gram_map, key_map), _Hashes()

        def found() -> Iterator[pa.RecordBatch]:
            rows = [(row, doc_id, address, number, first, words.tobytes(), keys.view(np.int64).tolist()) for (row, doc_id, address), number, first, words, keys in finder.flush()]
            for a in range(0, len(rows), 1024):
                yield _batch(rows[a : a + 1024], schema)

        for batch in batches:
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_py()
                if finder.add((row, doc_id, hashlib.md5((raw or "").encode()).digest()), hashes.of(raw)):
                    yield from found()
        yield from found()

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    windows = stored(numbered.mapInArrow(scan, "row long, doc_id long, address binary, class long, first long, words binary, keys array<long>").withColumn("window", F.monotonically_increasing_id()))
    pairs = windows.select("window", "class", F.explode("keys").alias("key")).join(item_side, ["class", "key"]).select("window", "item").distinct()
    named = pairs.join(windows.select("window", "row", "doc_id", "address", "first", "words"), "window").join(items.select("item", "item_id", F.col("words").alias("item_ids")), "item")
    result = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("address", pa.binary()), ("item", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64()), ("item_words", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, doc_id, address, item, item_id, first, words, item_ids in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "address", "item", "item_id", "first", "words", "item_ids")), strict=True):
                ids = np.frombuffer(item_ids, _U)
                best = best_run(ids, np.frombuffer(words, _U), edits_allowed(len(ids), similarity))
                if best:
                    rows.append((row, doc_id, address, item, item_id, first + best[1], first + best[2], best[0], len(ids)))
            if rows:
                yield _batch(rows, result)

    verified = named.select("row", "doc_id", "address", "item", "item_id", "first", "words", "item_ids").mapInArrow(verify, "row long, doc_id long, address binary, item long, item_id long, start_word long, end_word long, edits long, item_words long")
    best = verified.groupBy("row", "item").agg(F.min(F.struct("edits", "start_word", "end_word", "item_words", "item_id", "doc_id", "address")).alias("m"))
    return best.select("row", "m.address", "m.doc_id", "m.item_id", "m.start_word", "m.end_word", "m.edits", "m.item_words")


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, edits, item_words) for each document and item that it leaks."""
    return leaking_rows(docs, benchmark, similarity).select("doc_id", "item_id", "start_word", "end_word", "edits", "item_words")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    # leaking is up to the text alone, so copies stand or fall together; the addresses are written, and broadcast only if Spark finds them small
    address = free_name(docs, "leaking_text")
    gone = stored(leaking_rows(docs, benchmark, similarity).select(F.col("address").alias(address)).distinct())
    return docs.join(gone, F.unhex(F.md5("text")) == F.col(address), "left_anti")


def decontamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The leaks with ``similarity``, to six places."""
    return leaks(docs, benchmark).withColumn("similarity", F.round(1 - F.col("edits") / F.col("item_words"), 6))
