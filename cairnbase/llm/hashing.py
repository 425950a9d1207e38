"""Rolling 64-bit hashes of byte strings in numpy, the same wherever a string stands."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_POWER: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of them at least."""
    if len(_POWER.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POWER["up"], _POWER["down"] = _powers(int(BASE), size), _powers(pow(int(BASE), -1, 1 << 64), size)
    return _POWER["up"], _POWER["down"]


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which substring() takes hashes; data: bytes as unsigned integers."""
    up, _ = tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return total


def substring(total: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes, not yet mixed, of the strings from start to stop."""
    return (total[stop] - total[start]) * tables(len(total))[1][start]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)
