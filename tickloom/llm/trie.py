"""Elias-Fano sequences and one level of an n-gram trie over flat buffers.

A buffer can be written, read back or memory-mapped as it is: opening one makes views, no copies.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQB")


class EliasFano:
    """A non-decreasing sequence of whole numbers: low bits in fixed width, high bits as the gaps of a unary bit vector."""

    def __init__(self, buffer):
        self.size, words, self.width = _HEAD.unpack_from(buffer, 0)
        at = _HEAD.size
        self.low = np.frombuffer(buffer, "<u8", words, at)
        high = np.frombuffer(buffer, np.uint8, offset=at + 8 * words)
        bits = np.unpackbits(high, bitorder="little")
        self.ones = np.flatnonzero(bits)[:self.size]
        # Elements before each value of the high bits.
        self.bucket = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(bits == 0)))
        self.bucket[1:] -= np.arange(len(self.bucket) - 1)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        width = max(0, (top // max(1, n)).bit_length() - 1)
        high = (values >> np.uint64(width)).astype(np.int64)
        bits = np.zeros(n + (int(high[-1]) if n else 0) + 1, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.zeros(-(-n * width // 64) + 1, np.uint64)
        if width:
            low = values & np.uint64((1 << width) - 1)
            start = np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (start >> np.uint64(6)).astype(np.int64), start & np.uint64(63)
            np.bitwise_or.at(words, word, low << shift)
            spills = np.flatnonzero(shift > np.uint64(64 - width))
            np.bitwise_or.at(words, word[spills] + 1, low[spills] >> (np.uint64(64) - shift[spills]))
        return _HEAD.pack(n, len(words), width) + words.tobytes() + np.packbits(bits, bitorder="little").tobytes()

    def access(self, i: np.ndarray) -> np.ndarray:
        """The elements at some places."""
        high = (self.ones[i] - i).astype(np.int64)
        if not self.width:
            return high
        start = np.asarray(i, np.uint64) * np.uint64(self.width)
        word, shift = (start >> np.uint64(6)).astype(np.int64), start & np.uint64(63)
        low = self.low[word] >> shift
        over = shift > np.uint64(64 - self.width)
        low[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return (high << self.width) | (low & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def successor(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each value the first place in [low, high) that holds it or more, ``high`` if none does."""
        bucket = np.minimum(values >> self.width, len(self.bucket) - 1)
        last = np.append(self.bucket, self.size)[bucket + 1]
        a, b = np.clip(self.bucket[bucket], low, high), np.clip(last, low, high)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            less = self.access(middle) < values[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
            open_ = open_[a[open_] < b[open_]]
        return a


class Level:
    """Successors of contexts with a 16-bit code each, and a code of every context.

    The successors of a context are stored on top of the last stored value of the context before, so the whole sequence
    does not decrease; pointers tell where each context's begin.
    """

    def __init__(self, buffer):
        sizes = struct.unpack_from("<4Q", buffer, 0)
        at, view, parts = 32, memoryview(buffer), []
        for size in sizes:
            parts.append(view[at:at + size])
            at += size
        self.contexts, self.pointers, self.successors = (EliasFano(p) for p in parts[:3])
        self.context_codes = np.frombuffer(parts[3], "<u2")
        self.codes = np.frombuffer(view[at:], "<u2")

    @staticmethod
    def encode(context: np.ndarray, word: np.ndarray, codes: np.ndarray, contexts: np.ndarray, context_codes: np.ndarray) -> bytes:
        """``context`` and ``word`` in ascending order; ``contexts`` the distinct ones with their codes."""
        first = np.searchsorted(context, contexts)
        ends = np.append(first[1:], len(context))
        base = np.concatenate(([0], np.cumsum(word[ends - 1])[:-1])) if len(contexts) else np.zeros(0, np.int64)
        stored = word + np.repeat(base, ends - first)
        parts = [EliasFano.encode(contexts), EliasFano.encode(np.append(first, len(context))), EliasFano.encode(stored),
                 context_codes.astype("<u2").tobytes()]
        return struct.pack("<4Q", *map(len, parts)) + b"".join(parts) + codes.astype("<u2").tobytes()

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each context (-1: unknown) and the place of each word among its successors (-1: none)."""
        # Neighbours with the same context share its search.
        new = np.concatenate((np.ones(1, bool), context[1:] != context[:-1]))[:len(context)]
        run, own = np.cumsum(new) - 1, context[new]
        known, none = self.contexts.size, np.zeros(len(own), np.int64)
        number = self.contexts.successor(own, none, none + known)
        at = np.flatnonzero(number < known)
        at = at[self.contexts.access(number[at]) == own[at]]
        numbers, low, high, base = none - 1, none.copy(), none.copy(), none.copy()
        numbers[at] = number[at]
        low[at], high[at] = self.pointers.access(number[at]), self.pointers.access(number[at] + 1)
        base[at] = np.where(low[at] > 0, self.successors.access(np.maximum(low[at] - 1, 0)), 0)
        numbers, low, high, stored = numbers[run], low[run], high[run], word + base[run]
        place = np.full(len(context), -1, np.int64)
        at = np.flatnonzero(numbers >= 0)
        found = self.successors.successor(stored[at], low[at], high[at])
        hit = found < high[at]
        hit[hit] = self.successors.access(found[hit]) == stored[at][hit]
        place[at[hit]] = found[hit]
        return numbers, place
