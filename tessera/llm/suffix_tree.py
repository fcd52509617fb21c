"""Substring de-duplication of words: prefix-partitioned suffix trees.

Suffixes are partitioned by a prefix (the anchor key of ``repeats``); a partition
that would not fit is split by longer prefixes there.  Each part becomes a tree:
a node is extended as far as all its suffixes agree, then split by the next word.
Internal nodes deep enough for a window are the repeats, with all suffixes below
as occurrences; what their members share to the left completes the window.

Defined cases: null and empty texts have no word; texts of fewer words than the
window lose nothing; texts that differ in white space alone are equal; repeated
rows of a window or more are removed whole, each; overlapping occurrences inside
one text count; one very long word is one word; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Frame, digest
from .suffix_array import shared_prefix

WIDTH = 35
SLACK = 19


def internal_nodes(suffixes: list[bytes], unit: int) -> Iterator[tuple[int, list[int]]]:
    """(common tokens, members) of the tree's internal nodes, children before parents."""
    nodes: list[tuple[int, list[int]]] = []
    open_nodes = [(0, list(range(len(suffixes))))] if len(suffixes) > 1 else []
    while open_nodes:
        depth, members = open_nodes.pop()
        first = suffixes[members[0]]
        depth = min(shared_prefix(first, suffixes[i], unit) for i in members[1:])
        nodes.append((depth, members))
        children: dict[bytes, list[int]] = {}
        for i in members:
            token = suffixes[i][depth * unit : (depth + 1) * unit]
            if token:
                children.setdefault(token, []).append(i)
        open_nodes += [(depth + 1, group) for group in children.values() if len(group) > 1]
    yield from reversed(nodes)


def _hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


FRAME = Frame(
    width=WIDTH,
    slack=SLACK,
    unit=8,
    order=1,
    split=lambda text: text.encode("utf-8", "surrogatepass").split(),  # bytes: exactly the ASCII white space
    hashes=_hashes,
    contexts=lambda words, h: h.astype(">u8"),
    join=lambda words, kept: b" ".join(w for s, e in kept for w in words[s:e]),
    index=internal_nodes,
)


def suffix_tree_digest(docs: DataFrame, frame: Frame = FRAME) -> DataFrame:
    """The rows of the ``op9`` contract."""
    rows = digest(docs, frame)
    return rows.selectExpr("doc_id", "tokens AS n_words", "removed AS n_removed", "kept_sha256")


def oracle(width: int = WIDTH) -> str:
    """The digest in DuckDB SQL: every window of every text."""
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + {width - 1}], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {width - 2})) AS i FROM w)),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {width})) AS j FROM win WHERE g IN (SELECT g FROM twice)),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM each e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = e.doc_id AND g.j = e.j) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
