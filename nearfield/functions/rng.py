"""A small seeded generator whose numbers don't depend on partitions or library versions."""

from __future__ import annotations

from collections.abc import MutableSequence

import numpy as np

_MASK = (1 << 64) - 1
#: Fixed values of SplitMix64.
_GAMMA, _MUL_1, _MUL_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def floats(first: int, index: np.ndarray) -> np.ndarray:
    """What :meth:`SplitMix64.next_f64` gives as the numbers ``index``, from 0, of a generator in the state ``first``."""
    return (integers(first, index) >> np.uint64(11)) * 2.0**-53


def integers(first: int, index: np.ndarray) -> np.ndarray:
    """The same numbers as :meth:`SplitMix64.next_u64` gives them."""
    z = np.uint64(first) + (index.astype(np.uint64) + np.uint64(1)) * np.uint64(_GAMMA)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(_MUL_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(_MUL_2)
    return z ^ (z >> np.uint64(31))


class SplitMix64:
    def __init__(self, seed: int):
        self.state = (seed + _GAMMA) & _MASK

    def next_u64(self) -> int:
        self.state = z = (self.state + _GAMMA) & _MASK
        z = ((z ^ (z >> 30)) * _MUL_1) & _MASK
        z = ((z ^ (z >> 27)) * _MUL_2) & _MASK
        return z ^ (z >> 31)

    def skip(self, n: int) -> None:
        """As after ``n`` numbers."""
        self.state = (self.state + n * _GAMMA) & _MASK

    def next_f64(self) -> float:
        """From 0 up to but not including 1, in steps of 2^-53."""
        return (self.next_u64() >> 11) * 2.0**-53

    def below(self, n: int) -> int:
        return self.next_u64() % n

    def shuffle(self, items: MutableSequence) -> None:
        for last in range(len(items) - 1, 0, -1):
            other = self.below(last + 1)
            items[last], items[other] = items[other], items[last]
