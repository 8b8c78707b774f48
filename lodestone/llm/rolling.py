"""Rolling hashes of all windows of a text, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        step = _BASE if kind == "up" else _INVERSE
        grown = np.full(max(n, 2 * len(have)), step, np.uint64)
        grown[0] = 1
        have = _powers[kind] = np.multiply.accumulate(grown)
    return have[:n]


def codes(text: str) -> np.ndarray:
    """Code points; lone surrogates stay as they are."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def windows(code: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` codes (equal windows have equal hashes, wherever they stand)."""
    n = len(code) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        run = np.zeros(len(code) + 1, np.uint64)
        mixed = (code.astype(np.uint64) + np.uint64(1)) * _MIX
        np.cumsum((mixed ^ (mixed >> np.uint64(29))) * _power("up", len(code)), out=run[1:])
        h = (run[width:] - run[:-width]) * _power("down", n)
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
    return h


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of ``width`` values (two running minima over blocks)."""
    n = len(values)
    if n < width:
        return values[:0]
    top = np.iinfo(values.dtype).max
    padded = np.concatenate([values, np.full(-n % width, top, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])
