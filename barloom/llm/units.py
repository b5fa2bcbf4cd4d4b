"""Cutting texts into units whose tokens do not depend on what stands around them."""

from __future__ import annotations

import re
from collections.abc import Callable

#: White space that only some of the libraries' patterns take for white space.
_RARE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
_UNITS = re.compile(r"\s*\S+|\s+").findall


def units(text: str) -> list[str]:
    """White space with the word behind it, in order; joined they are the text.

    A byte-level pre-tokenizer always cuts between a character and white space behind it, so the
    tokens of a text are those of its units one after another. Texts with rare white space stay
    whole.
    """
    return [text] if _RARE(text) else _UNITS(text)


class Memo(dict):
    """What a function gives for units seen before; emptied when it holds ``limit`` of them."""

    def __init__(self, compute: Callable, limit: int = 400_000) -> None:
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, unit: str):
        if len(self) >= self.limit:
            self.clear()
        value = self[unit] = self.compute(unit)
        return value
