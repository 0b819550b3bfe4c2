"""Texts cut into pieces that a byte-level tokenizer never merges across, and caches over them.

In the GPT-2 pattern a space before a non-space always starts a new token, so a
text may be cut before every space that has a non-space on either side, and at a
line feed between non-spaces, which is a token of its own.  Each piece then
tokenizes by itself as it does inside the text.  Most pieces recur, so their
result (a count or ids, anything that ``+`` joins) is kept in a bounded cache.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from typing import TypeVar

T = TypeVar("T", int, bytes)

#: Whitespace runs with a space or line feed inside: cutting there could split one token.
UNSAFE = re.compile(r"\s (?:\s|\Z)|\s\n|\n\s")
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
MARKS = frozenset(".,;:!?")
#: Below this code point every Unicode version that the libraries know has the same letters.
SETTLED = "԰"
CACHE_ENTRIES, CACHE_LENGTH = 400_000, 64


class Cache(dict):
    """Results by piece, in two generations of CACHE_ENTRIES: when the young one is full it becomes the old one."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str):
        out = self.old.get(piece)
        if out is None:
            out = self.make(piece)
        if len(piece) <= CACHE_LENGTH:
            self.learn((piece,), (out,))
        return out

    def learn(self, pieces: Iterable[str], results: Sequence) -> None:
        """Remember results without asking ``make``."""
        if len(self) + len(results) > CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self.update(zip(pieces, results))


def byte_symbols(vocab: dict[str, int]) -> list[int]:
    """The symbol of each byte: printable Latin-1 characters stand for themselves, the others for 256 and up in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [vocab[chr(b if b in printable else next(shifted))] for b in range(256)]


def segments(text: str, specials: Sequence[str]) -> list[str]:
    """The text cut at special tokens, which stand as items of their own (longest first where they overlap)."""
    if not any(s in text for s in specials):
        return [text]
    pattern = "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))
    return [x for x in re.split(f"({pattern})", text) if x]


def is_word(piece: str) -> bool:
    return piece.isalpha() and (piece.isascii() or max(piece) < SETTLED)


class PieceReader:
    """Results of all pieces of a text: ``word`` for a space or none and then letters only, ``piece`` for any other,
    ``special`` for a special token."""

    def __init__(self, specials: Sequence[str], word: Callable[[str], T], piece: Callable[[str], T],
                 special: Callable[[str], T]):
        self.specials, self.special, self.word, self.piece = list(specials), special, word, piece
        self.plain = Cache(lambda p: self._make("", p))
        self.spaced = Cache(lambda p: self._make(" ", p))

    def _make(self, space: str, rest: str):
        if is_word(rest):
            return self.word(space + rest)
        if rest and rest[-1] in MARKS and is_word(rest[:-1]):
            return (self.spaced if space else self.plain)[rest[:-1]] + self.plain[rest[-1]]
        return self.piece(space + rest)

    def results(self, text: str) -> list:
        out = []
        for part in segments(text, self.specials):
            if part in self.specials:
                out.append(self.special(part))
            elif UNSAFE.search(part):
                first, *rest = SAFE_SPACE.split(part)
                out.append(self.plain[first])
                out.extend(map(self.spaced.__getitem__, rest))
            else:
                for k, line in enumerate(part.split("\n")):
                    if k:
                        out.append(self.plain["\n"])
                    first, *rest = line.split(" ")
                    if first:
                        out.append(self.plain[first])
                    out.extend(map(self.spaced.__getitem__, rest))
        return out
