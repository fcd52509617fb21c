"""Search queries are literals: they are parsed on the driver into terms for column predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .text import stem_word

_PHRASE = re.compile(r'"([^"]+)"')


@dataclass(frozen=True)
class Terms:
    required: tuple[str, ...]
    excluded: tuple[str, ...]
    phrases: tuple[str, ...]


def parse(query: str, bare_required: bool = False) -> Terms:
    """``+required``, ``-excluded`` and ``"phrases"``.

    Bare words are required if there is no ``+`` word, or always with ``bare_required``.
    """
    phrases = tuple(p.lower().strip() for p in _PHRASE.findall(query))
    required, excluded, bare = [], [], []
    for token in _PHRASE.sub("", query).lower().split():
        (required if token[0] == "+" else excluded if token[0] == "-" else bare).append(token.lstrip("+-") if token[0] in "+-" else token)
        if bare_required and token[0] not in "+-":
            required.append(bare.pop())
    keep = lambda xs: tuple(x for x in xs if x)
    return Terms(keep(required) or keep(bare), keep(excluded), phrases)


def stems(query: str) -> list[str]:
    """Stemmed tokens in order, repeats included."""
    return [stem_word(t) for t in re.findall(r"\w+", query.lower())]
