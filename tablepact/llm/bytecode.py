"""Unsigned numbers in one to four bytes, with their lengths in separate control bytes."""

from __future__ import annotations

import numpy as np

# For each control byte the byte counts of its four numbers.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def packed(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned numbers of at most 32 bits."""
    width = numbers.dtype.itemsize
    lengths = np.ones(len(numbers), np.uint8)
    for k in range(1, width):
        lengths += numbers >= 1 << 8 * k
    codes = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    codes[:len(numbers)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    every = np.ascontiguousarray(numbers, f"<u{width}").view(np.uint8).reshape(-1, width)
    return control.tobytes(), every[np.arange(width, dtype=np.uint8) < lengths[:, None]].tobytes()


def unpacked(control: bytes, data: bytes, count: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    places = np.cumsum(lengths, dtype=np.int64) - lengths
    held = np.frombuffer(data, np.uint8)
    numbers = held[places].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        longer = np.flatnonzero(lengths > k)
        numbers[longer] |= held[places[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return numbers
