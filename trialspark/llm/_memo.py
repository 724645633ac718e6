"""Tokenizer libraries inside Python workers, with a bounded memo of text units.

A unit is a run of the six white-space characters and the word after it (or the word alone). Natural text repeats its words,
so each worker asks the library once for a unit and remembers the answer in two generations of bounded size.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

#: Entries of one generation; two generations are kept, about 200 bytes an entry.
MEMO_ENTRIES = 200_000


@lru_cache(maxsize=4)
def bpe_library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def piece_library(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


class Memo:
    """``lookup(units)`` gives one value for each unit; ``encode`` is asked for the missing ones, many at a time."""

    def __init__(self, encode: Callable[[list[str]], list], entries: int = MEMO_ENTRIES):
        self.encode, self.entries = encode, entries
        self.young: dict = {}
        self.old: dict = {}

    def lookup(self, units: list[str]) -> list:
        got = list(map(self.young.get, units))
        if None in got:
            old, new = self.old, {}
            for unit, value in zip(units, got, strict=True):
                if value is None:
                    new[unit] = old.get(unit)
            missing = [u for u, v in new.items() if v is None]
            if missing:
                new.update(zip(missing, self.encode(missing), strict=True))
            got = [new[u] if v is None else v for u, v in zip(units, got, strict=True)]
            if len(self.young) + len(new) > self.entries:
                self.old, self.young = self.young, {}
            if len(new) <= self.entries:
                self.young.update(new)
        return got
