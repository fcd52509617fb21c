"""Ids of words on the short path of the packing operator."""

from __future__ import annotations

import random

from tessera.llm import packing


class _Barred:
    def findall(self, _):
        raise AssertionError("letters with marks behind them need no pattern")


def test_words_of_letters_and_marks_need_no_pattern(monkeypatch):
    encoder = packing.WordEncoder(packing.default_tokenizer_path())
    text = "Word word. wörd### Éa'' ª% ßa,"
    want = packing._packed(encoder.tokenizer.encode(text, add_special_tokens=False).ids)
    monkeypatch.setattr(packing, "_PIECE", _Barred())
    assert encoder.encode(text) == want


def test_odd_words_have_the_tokenizers_ids():
    encoder, dice = packing.WordEncoder(packing.default_tokenizer_path()), random.Random(7)
    letters = "abcXYZäßÉªºĐİſƒ0129'´’.,;:!?#%&*()-_=+/\\|~^`\"$[]{}@<>×÷¡¿…ж中́ᴬ\x00"
    words = ["".join(dice.choices(letters, k=dice.randint(1, 7))) for _ in range(3000)] + ["don't", "it's.", "I'll,", "''s", "a's'", "İ.", "K."]
    for word in words:
        assert encoder.encode(word) == packing._packed(encoder.tokenizer.encode(word, add_special_tokens=False).ids), word
