"""A Bloom filter over 64-bit hashes; methods take and give whole arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS_PER_HASH, PROBES = 16, 4


class Bloom:
    def __init__(self, capacity: int, bits: np.ndarray | None = None) -> None:
        size = 1 << max(10, (max(capacity, 1) * BITS_PER_HASH - 1).bit_length())
        self.mask = np.uint64(size - 1)
        self.bits = np.zeros(size // 8, np.uint8) if bits is None else bits

    def _places(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = (hashes >> np.uint64(29)) | np.uint64(1)
        for i in range(PROBES):
            at = (hashes + step * np.uint64(i)) & self.mask
            yield (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for byte, bit in self._places(hashes):
            np.bitwise_or.at(self.bits, byte, bit)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for byte, bit in self._places(hashes):
            found &= (self.bits[byte] & bit) != 0
        return found
