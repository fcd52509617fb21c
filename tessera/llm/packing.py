"""Best-fit packing planned on a histogram of lengths.

1. Documents are tokenized where they lie; each becomes pieces of at most
   ``capacity`` tokens (only longer ones are cut) with a checksum, and the pieces
   are written once to the shared checkpoint folder.
2. The plan sees only the histogram: how many pieces have each length, at most
   ``capacity`` rows.  Best fit decreasing then runs over counts: all sequences
   with one and the same filling are one group, and a whole run of equal pieces
   is placed into a group at a time.
3. A piece of length L and rank r among the pieces of that length takes slot r of
   L.  Ranks come from counts for each (bucket, length) and a row number inside
   it, so no length, however common, is ranked in one task.

The plan's runs are joined by length and rank range; they depend on the number of
distinct lengths and not on the number of documents, and are broadcast only up to
``BROADCAST_RUNS`` (beyond it the join is an ordinary one on length).

Defined cases: null and empty texts are one piece holding the end id alone;
repeated rows are packed as often as they stand there; a very long text fills
whole sequences and its rest is packed like any piece; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_arrow, cut

CAPACITY = 2048
END_ID = 0
BROADCAST_RUNS = 200_000
#: Words whose ids a worker remembers.
CACHE_WORDS = 300_000
TOKENIZER = "word_bpe_49k.json"
# Characters that Python's str.split() takes for white space and the tokenizer does not.
_PYTHON_ONLY_SPACE = re.compile("[\x1c-\x1f]")
# Unicode White_Space.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


#: Words of characters below U+0250: in composed form already, of settled letter classes, and no special token.
_PLAIN = re.compile("[!-;=-~\xa1-\u024f]+")
#: Marks that are a piece of their own behind letters.
_MARKS = "!\"#$%&'()*+,-./:;=?@[\\]^_`{|}~"
# Fixed value: the tokenizer's pattern of pieces.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


_BYTE_CHARACTERS = _byte_characters()


def _packed(ids: list[int]) -> bytes:
    codes = array("I", ids)
    if sys.byteorder == "big":
        codes.byteswap()
    return codes.tobytes()


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class _Words(dict):
    """Words and their ids; a word that is not known yet is asked for once."""

    def __init__(self, ask: Callable[[str], bytes]):
        self.ask = ask

    def __missing__(self, word: str) -> bytes:
        code = self[word] = self.ask(word)
        return code


class WordEncoder:
    """Ids of a text as little-endian 32-bit bytes, by remembered white-space-separated words.

    The tokenizer drops white space and no token spans it, so a text's ids are
    those of its words in order.  Two generations of words are kept: what was not
    met during a whole generation is forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.ids = _Words(self._word)
        self.old: dict[str, bytes] = {}
        self.pieces = _Words(self._piece)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(_BYTE_CHARACTERS.__getitem__, piece.encode()))
        return _packed([t.id for t in self.model.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        """Plain words skip the tokenizer's general text handling and go to its model piece by piece."""
        if (kept := self.old.get(word)) is not None:
            return kept
        if not _PLAIN.fullmatch(word):
            return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        low = word.lower()
        stem = low.rstrip(_MARKS)
        if stem.isalpha():  # most words: letters, and marks behind them
            return self.pieces[stem] if len(stem) == len(low) else self.pieces[stem] + self.pieces[low[len(stem) :]]
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(low)))

    def encode(self, text: str) -> bytes:
        words = _SPACE.split(text) if _PYTHON_ONLY_SPACE.search(text) else text.split()
        if len(self.ids) > CACHE_WORDS:
            self.ids, self.old = _Words(self._word), self.ids
        if len(self.pieces) > CACHE_WORDS:
            self.pieces.clear()
        return b"".join(map(self.ids.__getitem__, words))


_encoders: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """One encoder for each worker process, so that its words outlive a task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str | Callable[[], str] = default_tokenizer_path, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece; ``tokenizer`` is a path, or a function that gives it on the executor."""
    bound_arrow(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = None, end_id.to_bytes(4, "little")
        for batch in batches:
            encoder = encoder or encoder_for(tokenizer() if callable(tokenizer) else tokenizer)
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, last rank, first sequence, offset) of best fit decreasing over counts.

    The pieces of a length with ranks first to last take ``offset`` in sequences
    first sequence, first sequence + 1, and so on.
    """
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free room: (first sequence, sequences)
    runs, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        room = length
        while left:
            while room <= capacity and not rooms[room]:
                room += 1
            if room > capacity:
                # no open sequence has room: open as many as the rest of this length fills
                opened = -(-left // (capacity // length))
                rooms[capacity].append((sequences, opened))
                sequences += opened
                room = capacity
                continue
            first, count = rooms[room].pop()
            take = min(left, count)
            if count > take:
                rooms[room].append((first + take, count - take))
            runs.append((length, rank, rank + take - 1, first, capacity - room))
            rooms[room - length].append((first, take))
            rank, left = rank + take, left - take
            if room - length >= length:  # the fuller sequences just made still have room, and fit better
                room -= length
    return runs


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` and ``rank``, from 0, among the rows of one length; ties and repeated rows rank in any order."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = dealt.withColumn("within", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    return within.join(base, ["bucket", "length"]).withColumn("rank", F.col("base") + F.col("within")).drop("bucket", "base", "within")


def pack(docs: DataFrame, tokenizer: str | Callable[[], str] = default_tokenizer_path, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The rows of the ``op3`` contract: each piece with its sequence and offset."""
    spark = docs.sparkSession
    rows = cut(pieces(docs, tokenizer, capacity, end_id))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs = plan(histogram, capacity)
    slots = spark.createDataFrame(runs, "slot_length long, first long, last long, sequence long, offset long")
    if len(runs) <= BROADCAST_RUNS:
        slots = F.broadcast(slots)
    placed = ranked(rows).join(slots, (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("first"), F.col("last")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
