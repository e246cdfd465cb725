"""Hashed character n-grams of many short strings at once."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _kind(n: int, seed: int) -> np.uint64:
    """What keeps n-grams of different lengths and seeds apart, far from any difference of two characters."""
    return np.uint64((n + 64 * seed) * int(_MIX) % 2**64)


def hashed_grams(words: list[str], sizes: tuple[int, ...], bits: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of each n-gram of `<word>`, and of `<word>` itself where it is shorter than all of them; a
    bucket is under 2**bits."""
    marked = [f"<{w}>" for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    end = np.repeat(start + size, size)
    at, rows, found = np.arange(len(code)), [], []
    rolled = np.zeros(len(code), np.uint64)
    for n in range(1, max(sizes) + 1):
        # rolled[i] covers code[i : i + n]
        rolled = rolled[: len(code) - n + 1] * _STEP + code[n - 1 :] if n > 1 else code.copy()
        if n in sizes:
            fits = np.flatnonzero(at[: len(rolled)] + n <= end[: len(rolled)])
            rows.append(owner[fits])
            found.append(rolled[fits] + _kind(n, seed))
    tiny = np.flatnonzero(size < min(sizes))
    if len(tiny):
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(size.max()), _STEP, np.uint64))
        rows.append(tiny)
        found.append(np.add.reduceat(code * power[at - start[owner]], start)[tiny] + _kind(63, seed))
    row, key = np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(found) if found else np.zeros(0, np.uint64)
    key = (key ^ (key >> np.uint64(31))) * _MIX
    return row, (key >> np.uint64(64 - bits)).astype(np.int64)
