"""A compressed bitmap over non-negative ordinals, on numpy.

Ordinals are split into containers of 65,536; a container is kept as a sorted ``uint16`` array
while it holds at most 4,096 values and as 1,024 64-bit words beyond that, whichever is smaller.
"""

from __future__ import annotations

import numpy as np

ARRAY_MAX = 4096


def _pack(low: np.ndarray) -> np.ndarray:
    if len(low) <= ARRAY_MAX:
        return low.astype(np.uint16)
    bits = np.zeros(1 << 16, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _values(box: np.ndarray) -> np.ndarray:
    if box.dtype == np.uint16:
        return box.astype(np.int64)
    return np.flatnonzero(np.unpackbits(box.view(np.uint8), bitorder="little"))


def _has(box: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each of ``low`` whether ``box`` holds it."""
    if box.dtype == np.uint16:
        at = np.searchsorted(box, low)
        at[at == len(box)] = 0
        return box[at] == low if len(box) else np.zeros(len(low), bool)
    return (box[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1) == 1


class Bitmap:
    """An immutable set of ordinals with AND, AND-NOT and rank."""

    def __init__(self, boxes: dict[int, np.ndarray]):
        self.boxes = boxes

    @classmethod
    def of(cls, ordinals) -> Bitmap:
        x = np.unique(np.asarray(ordinals, np.int64))
        high = x >> 16
        starts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(x) else []
        ends = [*starts[1:], len(x)] if len(x) else []
        return cls({int(high[s]): _pack(x[s:e] & 0xFFFF) for s, e in zip(starts, ends)})

    def ordinals(self) -> np.ndarray:
        parts = [(h << 16) + _values(b) for h, b in sorted(self.boxes.items())]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return sum(len(b) if b.dtype == np.uint16 else int(np.bitwise_count(b).sum()) for b in self.boxes.values())

    def andnot(self, other: Bitmap) -> Bitmap:
        """The ordinals of this bitmap that ``other`` lacks."""
        return self._combine(other, keep=False)

    def __and__(self, other: Bitmap) -> Bitmap:
        return self._combine(other, keep=True)

    def _combine(self, other: Bitmap, keep: bool) -> Bitmap:
        out = {}
        for h, a in self.boxes.items():
            b = other.boxes.get(h)
            if b is None:
                if not keep:
                    out[h] = a
                continue
            if a.dtype == b.dtype == np.uint64:
                words = a & b if keep else a & ~b
                n = int(np.bitwise_count(words).sum())
                if n:
                    out[h] = words if n > ARRAY_MAX else _values(words).astype(np.uint16)
            else:
                low = _values(a)
                low = low[_has(b, low) == keep]
                if len(low):
                    out[h] = _pack(low)
        return Bitmap(out)
