"""Language identification with language-bitmask n-gram filters.

Training counts letter trigrams (lower case, a word's edges count) for each
language over all training documents, exactly: a task adds up what it reads and
the sums are grouped by language and trigram.  A language contains the trigrams
that make up at least ``RATE`` of its own, so at most 1 / ``RATE`` of them,
whatever the corpus holds, and that were met ``LEAST_COUNT`` times, so that a
slip of the pen is no evidence.

The model is one bit-sliced Bloom filter: an array of 64-bit masks with one bit
for each language, filled by OR in the cluster.  The AND of the ``HASHES`` masks
of a trigram is the set of all languages that contain it, from one lookup.  A
document's language is decided by the popcount of each bit over its trigrams,
corrected for that bit's false positive rate: (hits - n f) / (1 - f).

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a
text of letters that no language knows gets the language with the most training
documents, score 0; ties go to the first language by name; repeated rows get
equal rows; without training documents every text is ``und``; more than 64
languages are refused with an error; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, cut

#: Least share of a language's trigrams, and least count, of one that it contains.
RATE = 1e-5
LEAST_COUNT = 3
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
HASHES = 3
LANGUAGES = 64
#: Characters handled at once.
CHUNK = 1_000_000
#: Distinct trigrams of a language that a task holds before it hands its sums on.
HELD = 1 << 20
#: Stands for the documents of a language among its trigrams, which are not negative.
DOCUMENTS = -1

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def trigrams(text: str) -> Iterator[np.ndarray]:
    """The trigrams around each letter of ``text``, as 63-bit numbers, a chunk at a time."""
    low = text.lower()
    letters = _letter_table()
    for at in range(0, len(low), CHUNK):
        piece = (low[at - 1] if at else " ") + low[at : at + CHUNK] + (low[at + CHUNK : at + CHUNK + 1] or " ")
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(letters[codes], codes, np.uint32(0)).astype(np.uint64)
        middle = np.flatnonzero(codes[1:-1]) + 1
        yield (codes[middle - 1] << np.uint64(42)) | (codes[middle] << np.uint64(21)) | codes[middle + 1]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    masks: np.ndarray  # SLOTS masks of 64 bits
    false_rate: np.ndarray  # of each language
    fallback: int

    def sets(self, grams: np.ndarray) -> np.ndarray:
        """For each trigram the mask of all languages that contain it."""
        out = None
        for slot in slots(grams):
            got = self.masks[slot]
            out = got if out is None else out & got
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        hits, n = np.zeros(len(self.languages)), 0
        for grams in trigrams(text or ""):
            sets = self.sets(grams)
            n += len(grams)
            hits += [np.count_nonzero(sets & np.uint64(1 << b)) for b in range(len(self.languages))]
        if not n or not self.languages:
            return "und", 0.0
        true = np.maximum((hits - n * self.false_rate) / (1 - self.false_rate), 0)
        if not true.sum():
            return self.languages[self.fallback], 0.0
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / true.sum())


def slots(grams: np.ndarray) -> list[np.ndarray]:
    """Two hashes make all: first + i * second."""
    h = _mixed(grams + np.uint64(0x51ED27))
    first, second = h >> np.uint64(64 - SLOT_BITS), (h & np.uint64(SLOTS - 1)) | np.uint64(1)
    return [((first + np.uint64(i) * second) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def count_trigrams(training: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each trigram occurs in (text, lang); gram ``DOCUMENTS`` counts the rows."""
    bound_arrow(training.sparkSession)

    def rows(lang: str, parts: list[tuple[np.ndarray, np.ndarray]], docs: int) -> pa.RecordBatch:
        grams, n = summed(parts)
        grams, n = np.r_[grams.astype(np.int64), DOCUMENTS], np.r_[n, docs]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        every, which = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return every, np.bincount(which, np.concatenate([n for _, n in parts]), len(every)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for lang in set(batch.column("lang").to_pylist()):
                texts = batch.filter(pc.equal(batch.column("lang"), lang)).column("text")
                docs[lang] = docs.get(lang, 0) + len(texts)
                held = sums.setdefault(lang, [])
                fresh: list[np.ndarray] = []
                for text in texts:
                    fresh += trigrams(text.as_py())
                    if sum(map(len, fresh)) > CHUNK:
                        held[:] = [summed([*held, np.unique(np.concatenate(fresh), return_counts=True)])]
                        fresh = []
                if fresh:
                    held[:] = [summed([*held, np.unique(np.concatenate(fresh), return_counts=True)])]
                if held and len(held[0][0]) > HELD:
                    yield rows(lang, sums.pop(lang), docs.pop(lang))
        for lang, held in sums.items():
            yield rows(lang, held or [(np.empty(0, np.uint64), np.empty(0, np.int64))], docs[lang])

    return training.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(training: DataFrame) -> Model:
    """The filter of (text, lang) rows; rows with a null in either are left out.

    What reaches the driver is bounded: a row for each language and at most
    ``SLOTS`` slots.
    """
    counts = cut(count_trigrams(training.where(F.col("text").isNotNull() & F.col("lang").isNotNull())))
    real = F.when(F.col("gram") != DOCUMENTS, F.col("n"))
    totals = counts.groupBy("lang").agg(F.sum(real).alias("total"), F.max(real).alias("most"), F.max(F.when(F.col("gram") == DOCUMENTS, F.col("n"))).alias("docs"))
    known = totals.orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(known) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    masks = np.zeros(SLOTS, np.uint64)
    if not known:
        return Model((), masks, np.zeros(0), 0)
    languages = tuple(r["lang"] for r in known)
    # one row a language: bounded by LANGUAGES
    bits = counts.sparkSession.createDataFrame([(r["lang"], int(np.uint64(1 << b).astype(np.int64)), float(max(min(LEAST_COUNT, r["most"] or 0), RATE * (r["total"] or 0)))) for b, r in enumerate(known)], "lang string, bit long, least double")
    members = counts.where(F.col("gram") != DOCUMENTS).join(F.broadcast(bits), "lang").where(F.col("n") >= F.col("least"))
    sets = members.groupBy("gram").agg(F.bit_or("bit").alias("mask"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slot in slots(batch.column("gram").to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(slot), batch.column("mask")], names=["slot", "mask"])

    filled = sets.mapInArrow(place, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks[filled.column("slot").to_numpy()] = filled.column("mask").to_numpy().view(np.uint64)
    fill = np.array([np.count_nonzero(masks & np.uint64(1 << b)) / SLOTS for b in range(len(languages))])
    return Model(languages, masks, fill**HASHES, max(range(len(languages)), key=lambda b: (known[b]["docs"], -b)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) from the texts alone."""
    bound_arrow(docs.sparkSession)
    packed = (model.languages, zlib.compress(model.masks.tobytes(), 1), model.false_rate, model.fallback)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(packed[0], np.frombuffer(zlib.decompress(packed[1]), np.uint64), packed[2], packed[3])
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_digest(docs: DataFrame) -> DataFrame:
    """The rows of the ``op1`` contract: learned where crc32(doc_id) mod 5 is not 0."""
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
