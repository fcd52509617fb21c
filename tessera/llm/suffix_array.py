"""Suffix-array de-duplication: bytes covered by 400-byte strings that also start elsewhere.

The anchors of one key (see ``repeats``) are suffixes with a common prefix.  They
are sorted into a suffix array with the lengths of the prefixes that neighbours
share; a scan with a stack then yields the common-prefix intervals as a tree,
children first.  Each interval is a repeat with all its occurrences, not only
neighbours.  Sorting an interval's members by what stands to their left shows how
far they agree there: where a pair goes on to the left the repeat is not
left-maximal and is extended, where it differs it ends.

Defined cases: null and empty texts have no byte and keep none; texts shorter
than the window lose nothing; repeated rows and equal texts of a window or more
are removed whole, each; overlapping occurrences inside one text count; matches
never cross texts; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Frame, digest

WIDTH = 400
SLACK = 200


def shared_prefix(a: bytes, b: bytes, unit: int) -> int:
    """Tokens that two contexts share at their start."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n // unit
    return (8 * n - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length()) // (8 * unit)


def intervals(suffixes: list[bytes], unit: int) -> Iterator[tuple[int, list[int]]]:
    """(common tokens, members) of every common-prefix interval of two suffixes or more, children before parents."""
    array = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    stack: list[tuple[int, int]] = []  # (common prefix, left end) of the open intervals
    for i in range(1, len(array) + 1):
        shared = shared_prefix(suffixes[array[i - 1]], suffixes[array[i]], unit) if i < len(array) else -1
        left = i - 1
        while stack and stack[-1][0] > shared:
            depth, left = stack.pop()
            yield depth, array[left:i]
        if shared >= 0 and (not stack or stack[-1][0] < shared):
            stack.append((shared, left))


def _byte_hashes() -> np.ndarray:
    return np.random.default_rng(400).integers(0, 2**64, 256, np.uint64)


_BYTE_HASHES = _byte_hashes()


def _hashes(raw: bytes) -> np.ndarray:
    return _BYTE_HASHES[np.frombuffer(raw, np.uint8)]


FRAME = Frame(
    width=WIDTH,
    slack=SLACK,
    unit=1,
    order=12,
    split=lambda text: text.encode("utf-8", "surrogatepass"),
    hashes=_hashes,
    contexts=lambda raw, h: np.frombuffer(raw, np.uint8),
    join=lambda raw, kept: b"".join(raw[s:e] for s, e in kept),
    index=intervals,
)


def suffix_array_digest(docs: DataFrame, frame: Frame = FRAME) -> DataFrame:
    """The rows of the ``op2`` contract."""
    rows = digest(docs, frame)
    return rows.select("doc_id", F.col("tokens").alias("n_bytes"), F.col("removed").alias("n_removed"), F.col("spans").alias("n_spans"), "kept_sha256")
