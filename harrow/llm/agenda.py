"""Merging many short symbol sequences at once by their agendas of adjacent pairs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np

#: The rank of a pair that joins to nothing.
NEVER = 1 << 60
#: Spreads keys over the slots of a table.
MIX = 0x9E3779B97F4A7C15


class PairTable:
    """What pairs of symbol numbers join to: (left << 20 | right) -> rank << 20 | joined; numbers are below 2 ** 20."""

    def __init__(self, joins: Mapping[int, int]):
        # open addressing, a tenth full; -1 is an empty slot and joins to nothing
        bits = max(8, (10 * len(joins)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.joined_to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int64)
        pairs = np.fromiter(joins, np.int64, len(joins))
        for key, slot in zip(pairs.tolist(), self._slots(pairs).tolist()):
            while self.keys[slot] != -1:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.joined_to[slot] = key, joins[key]

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(MIX)) >> self.shift).view(np.int64)

    def _looked_up(self, left: np.ndarray, right: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """What pairs join to, NEVER where they stand ``apart`` or one is negative; one more entry ends the last sequence."""
        key = left << 20 | right
        key[apart | (key < 0)] = -1
        slot = self._slots(key)
        there = self.keys[slot]
        out = np.append(self.joined_to[slot], NEVER)
        astray = np.flatnonzero(there != key)
        while len(astray):
            out[astray] = NEVER
            astray = astray[self.keys[slot[astray]] != -1]  # an empty slot ends the search
            slot[astray] = (slot[astray] + 1) & self.mask
            same = self.keys[slot[astray]] == key[astray]
            out[astray[same]] = self.joined_to[slot[astray[same]]]
            astray = astray[~same]
        return out

    def merge(self, symbol: np.ndarray, owner: np.ndarray) -> Iterator[tuple[list[int], list[bytes], list[bool]]]:
        """Owners, little-endian 32-bit numbers, and whether one is negative, of every sequence, in no certain order.

        ``owner`` says, in runs, to which sequence a symbol belongs.  The agenda
        of a sequence is the stretch of one array with the ranks of its adjacent
        pairs.  In each round the best pair of every sequence is popped, the
        leftmost of equal ones, and joined; sequences whose agenda is empty are
        done.  Negative symbols join to nothing.
        """
        symbol, owner = symbol.astype(np.int64), owner.astype(np.int64)
        agenda = self._looked_up(symbol[:-1], symbol[1:], owner[:-1] != owner[1:])
        while len(symbol):
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            size = np.diff(begin, append=len(symbol))
            best = np.minimum.reduceat(agenda, begin)
            done = best == NEVER
            if done.any():
                gone = np.repeat(done, size)
                yield _each(owner[gone], symbol[gone])
                symbol, owner, agenda = symbol[~gone], owner[~gone], agenda[~gone]
                size, best = size[~done], best[~done]
                if not len(symbol):
                    break
            at = np.flatnonzero(agenda == np.repeat(best, size))
            at = at[np.diff(owner[at], prepend=-1) != 0]
            symbol[at] = best & 0xFFFFF
            kept = np.ones(len(symbol), bool)
            kept[at + 1] = False
            agenda[at + 1] = agenda[at]
            place = at - np.arange(len(at))
            symbol, owner, agenda = symbol[kept], owner[kept], agenda[kept]
            for i in (place, place[place > 0] - 1):
                j = np.minimum(i + 1, len(symbol) - 1)
                agenda[i] = self._looked_up(symbol[i], symbol[j], (owner[i] != owner[j]) | (i == j))[:len(i)]


def _each(owner: np.ndarray, symbol: np.ndarray) -> tuple[list[int], list[bytes], list[bool]]:
    data = symbol.astype("<i4").tobytes()
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    edges = [*(4 * begin).tolist(), len(data)]
    return owner[begin].tolist(), [data[a:b] for a, b in zip(edges, edges[1:])], (np.minimum.reduceat(symbol, begin) < 0).tolist()
