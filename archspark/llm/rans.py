"""Static range asymmetric numeral coding of token ids, vectorised over interleaved lanes.

A shared table gives every id that occurs a frequency; frequencies sum to 2**PRECISION. A block of ids is laid out in
rows of LANES; lane j codes column j with its own 64-bit state. Rows are coded from the last to the first, so that decoding
runs forward; states give off 32 bits at a time, and the lanes that do so in one row write in lane order.
"""

from __future__ import annotations

import zlib

import numpy as np

PRECISION = 18
LANES = 1024
BLOCK = LANES * 512
LOWEST = np.uint64(1 << 31)
_32 = np.uint64(32)
_SLOTS = np.uint64(1 << PRECISION)


class Table:
    """Frequencies and running sums by id, and the id of each slot."""

    def __init__(self, frequencies: np.ndarray):
        self.frequencies = frequencies.astype(np.uint64)
        if int(self.frequencies.sum()) != 1 << PRECISION:
            raise ValueError("frequencies must sum to 2**PRECISION")
        self.below = np.cumsum(self.frequencies) - self.frequencies
        self.ids = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)
        self.limit = self.frequencies << np.uint64(63 - PRECISION)
        slots = np.arange(1 << PRECISION, dtype=np.uint64)
        self.step = self.frequencies[self.ids]
        self.rest = slots - self.below[self.ids]

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Table:
        """Every counted id gets 1 at least; the rest goes by share, the largest remainder first."""
        counts = np.asarray(counts, np.float64)
        used = counts > 0
        if not used.any():
            used = np.arange(len(counts)) == 0
            counts = used.astype(np.float64)
        free = (1 << PRECISION) - int(used.sum())
        if free < 0:
            raise ValueError("more ids than slots")
        exact = counts / counts.sum() * free
        whole = np.floor(exact).astype(np.int64)
        rest = free - int(whole.sum())
        whole[np.argsort(-(exact - whole), kind="stable")[:rest]] += 1
        return cls(whole + used)

    def to_bytes(self) -> bytes:
        return self.frequencies.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        return cls(np.frombuffer(data, "<u4").astype(np.int64))

    @property
    def checksum(self) -> int:
        return zlib.crc32(self.to_bytes())


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """The lanes' last states, then the 32-bit words in the order in which a decoder takes them."""
    n = len(ids)
    lanes = min(LANES, max(1, n))
    state = np.full(lanes, LOWEST, np.uint64)
    words: list[np.ndarray] = []
    frequencies, below, limit = table.frequencies[ids], table.below[ids], table.limit[ids]
    for row in range((n - 1) // lanes, -1, -1) if n else ():
        at = slice(row * lanes, (row + 1) * lanes)
        f = frequencies[at]
        x = state[: len(f)]
        full = np.flatnonzero(x >= limit[at])
        if len(full):
            words.append(x[full].astype(np.uint32))
            x[full] >>= _32
        q = x // f
        x += q * (_SLOTS - f)  # q * slots + x % f
        x += below[at]
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    return state.astype("<u8").tobytes() + stream.astype("<u4").tobytes()


def decode_block(data: bytes, n: int, table: Table) -> np.ndarray:
    lanes = min(LANES, max(1, n))
    state = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
    stream = np.frombuffer(data, "<u4", offset=8 * lanes).astype(np.uint64)
    out = np.empty(n, np.uint32)
    at, mask, shift = 0, np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
    for start in range(0, n, lanes):
        x = state[: min(lanes, n - start)]
        slot = x & mask
        part = table.ids[slot]
        out[start : start + len(x)] = part
        x = table.step[slot] * (x >> shift) + table.rest[slot]
        low = np.flatnonzero(x < LOWEST)
        if len(low):
            x[low] = (x[low] << _32) | stream[at : at + len(low)]
            at += len(low)
        state[: len(x)] = x
    if at != len(stream) or not (state == LOWEST).all():
        raise ValueError("block is damaged")
    return out
