"""Splitting text into pretokens, and a bounded memo; shared by the byte-pair operators."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import regex


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a .tiktoken file (read once per worker)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def splitter(pattern: str):
    """``findall`` of the pretoken pattern."""
    return regex.compile(pattern).findall


class Memo(dict):
    """piece -> function(piece); starts anew when ``most`` pieces are held, so memory is bounded
    however many distinct pieces there are."""

    def __init__(self, function, most: int = 400_000, longest: int = 64):
        super().__init__()
        self.function, self.most, self.longest = function, most, longest

    def __missing__(self, piece):
        value = self.function(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = value
        return value


class Recent(dict):
    """piece -> function(piece) for the pieces met of late: when ``most`` are held they become the
    older half, and an older piece that is met again is new; so common pieces stay, and at most twice
    ``most`` are held."""

    def __init__(self, function, most: int = 200_000, longest: int = 64):
        super().__init__()
        self.function, self.most, self.longest, self.older = function, most, longest, {}

    def __missing__(self, piece):
        value = self.older.get(piece)
        if value is None:
            value = self.function(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = value
        return value


class Chunks:
    """``function`` over the stretches of a text between single spaces, each with the space before
    it: with a pattern in which a single space between two other characters always begins a
    pretoken (as all GPT-2-like patterns do) no pretoken crosses such a border.  Stretches
    repeat, so most of them are looked up and the pattern runs only over new ones."""

    def __init__(self, function: Callable, most: int = 400_000):
        self.first = function
        self.rest = Memo(lambda chunk: function(" " + chunk), most)

    def __call__(self, text: str) -> Iterator:
        if not text:
            return
        if two_blanks(text) or text[0].isspace() or text[-1].isspace():
            chunks = lone_space.split(text)
        else:
            chunks = text.split(" ")
        yield self.first(chunks[0])
        yield from map(self.rest.__getitem__, chunks[1:])


two_blanks = re.compile(r"\s\s").search
lone_space = re.compile(r"(?<=\S) (?=\S)")
