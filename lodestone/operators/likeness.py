"""Pairs of names of one or two lists that are alike: Ratcliff and Obershelp's ratio, or shared words, for many pairs at a time.

No pair is left out. The characters that the ratio matches are a common subsequence, so its length bounds the ratio; it is
found for a name and all names of a list at once, with a bit for each character (Hyyrö's algorithm). Only pairs that reach
the ratio by this bound, or share enough words, are measured, character by character, thousands of them at a time.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np

#: Pairs measured at a time, and pairs of one step of it (what fits the cache).
MANY, STEP = 65536, 2048
#: difflib takes frequent characters for junk in texts of this length: names as long, or not in ASCII, are measured by difflib itself.
LONG = 200


def _odd(name: str) -> bool:
    return len(name) >= LONG or not name.isascii()


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every column: length and starts of the longest run of ``a`` that is in ``b``, the first in ``a``, then in ``b``."""
    wide, n = b.shape
    best, end = np.zeros(n, np.uint8), np.zeros(n, np.int32)
    prev, cur, same, most = np.zeros((wide + 1, n), np.uint8), np.zeros((wide + 1, n), np.uint8), np.empty((wide, n), bool), np.empty(n, np.uint8)
    for i in range(len(a)):
        np.equal(b, a[i], out=same)
        np.add(prev[:-1], 1, out=cur[1:])
        np.multiply(cur[1:], same.view(np.uint8), out=cur[1:])
        np.max(cur, axis=0, out=most)
        np.copyto(end, i, where=most > best)
        np.maximum(best, most, out=best)
        prev, cur = cur, prev
    at = end - best + 1
    fits, lanes = np.ones((wide, n), bool), np.arange(n)
    for t in range(int(best.max(initial=0))):
        over = best <= t
        fits[: wide - t] &= (b[t:] == a[np.minimum(at + t, len(a) - 1), lanes]) | over
        fits[wide - t :] &= over
    to = np.zeros(n, np.int32)
    for j in reversed(range(wide)):
        np.copyto(to, j, where=fits[j])
    return best.astype(np.int32), at, to


def matched(codes: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The characters that difflib's SequenceMatcher matches between the names ``i`` and ``j``; a row of ``codes`` is a name of ASCII, under ``LONG``."""
    total, zero = np.zeros(len(i), np.int64), np.zeros(len(i), np.int32)
    # pair, and from where to where in either name
    todo = np.stack([np.arange(len(i), dtype=np.int32), zero, size[i].astype(np.int32), zero, size[j].astype(np.int32)])

    def window(names: np.ndarray, lo: np.ndarray, n: np.ndarray, pad: int) -> np.ndarray:
        places = np.arange(n.max())[:, None]
        got = codes.ravel().take(names * codes.shape[1] + lo + places, mode="clip")
        np.copyto(got, pad, where=places >= n)
        return got

    while True:
        todo = todo[:, (todo[2] > todo[1]) & (todo[4] > todo[3])]
        if not todo.shape[1]:
            return total
        todo, parts = todo[:, np.argsort(((todo[4] - todo[3]) * LONG + todo[2] - todo[1]).astype(np.uint16), kind="stable")], []
        for s in range(0, todo.shape[1], STEP):
            k, alo, ahi, blo, bhi = todo[:, s : s + STEP]
            n, x, y = _longest(window(i[k], alo, ahi - alo, 254), window(j[k], blo, bhi - blo, 255))
            np.add.at(total, k, n)
            x, y, some = x + alo, y + blo, n > 0
            parts += [np.stack([k, alo, x, blo, y])[:, some], np.stack([k, x + n, ahi, y + n, bhi])[:, some]]
        todo = np.concatenate(parts, axis=1)


def _encoded(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Names as rows of codes, odd ones as blank, and the lengths."""
    raw = [b"" if _odd(x) else x.encode() for x in names]
    size = np.array([len(x) for x in raw], np.int64)
    codes = np.full((len(raw), max(1, int(size.max(initial=0)))), 255, np.uint8)
    for r, x in enumerate(raw):
        codes[r, : len(x)] = np.frombuffer(x, np.uint8)
    return codes, size


def pairs(left: list[str], right: list[str] | None, ratio: float, overlap: float) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a name of ``left`` and one of ``right`` (None: of two of ``left``) that reach ``ratio`` or ``overlap``, shared words of those of the longer name.

    Yields the names in order, two arrays of places in it, the lesser name first, and the ratio and overlap of each pair.
    """
    names = sorted({*left, *(right or ())})
    place = {x: r for r, x in enumerate(names)}
    codes, size = _encoded(names)
    words = [set(x.split()) for x in names]
    count = np.array([len(x) for x in words], np.int64)
    enough = np.array([next((c for c in range(1, m + 1) if c / m >= overlap), m + 1) for m in range(int(count.max(initial=0)) + 1)])
    odd = np.array([_odd(x) for x in names], bool)

    mine = np.array(sorted({place[x] for x in left}, key=lambda r: size[r]), np.int64)
    other = mine if right is None else np.array(sorted({place[x] for x in right}, key=lambda r: size[r]), np.int64)
    sizes, counts, odds = size[other], count[other], odd[other]
    holders: dict[str, list[int]] = {}
    for q, r in enumerate(other):
        for w in words[r]:
            holders.setdefault(w, []).append(q)
    holding = {w: np.array(qs) for w, qs in holders.items()}
    bits = np.zeros((256, len(other)), np.uint64)
    for p in range(min(64, codes.shape[1])):
        bits[codes[other, p], np.arange(len(other))] |= np.uint64(1 << p)
    beyond = np.maximum(sizes - 64, 0)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def measured() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x, y, shared = (np.concatenate(v) for v in zip(*held, strict=True))
        held.clear()
        x, y = np.minimum(x, y), np.maximum(x, y)
        m, n = matched(codes, size, x, y), size[x] + size[y]
        r = _rounded(2 * m, n)
        full = _divided(2 * m, n)
        for k in np.flatnonzero(odd[x] | odd[y]):
            full[k] = _plain(names[x[k]], names[y[k]], 0.0 if shared[k] >= enough[max(count[x[k]], count[y[k]])] else ratio)
            r[k] = round(full[k], 6)
        longer = np.maximum(count[x], count[y])
        good = (full >= ratio) | (shared >= enough[longer])
        return names, x[good], y[good], r[good], _rounded(shared, longer)[good]

    waiting = 0
    for p, r in enumerate(mine):
        from_ = p + 1 if right is None else 0
        shared = np.zeros(len(other), np.int64)
        for w in words[r]:
            if w in holding:
                shared[holding[w]] += 1
        maybe = shared >= enough[np.maximum(count[r], counts)]
        if odd[r]:
            maybe[:] = True
        else:
            maybe |= odds
            n = int(size[r])
            lo = max(from_, int(np.searchsorted(sizes, n * ratio / (2 - ratio) - 1)))
            hi = int(np.searchsorted(sizes, n * (2 - ratio) / ratio + 1, "right"))
            if hi > lo:
                maybe[lo:hi] |= 2 * (_common(bits[:, lo:hi], codes[r, :n]) + beyond[lo:hi]) >= ratio * (n + sizes[lo:hi]) - 1e-9
        hit = np.flatnonzero(maybe[from_:]) + from_
        hit = hit[other[hit] != r]
        if len(hit):
            held.append((np.full(len(hit), r), other[hit], shared[hit]))
            waiting += len(hit)
        if waiting >= MANY:
            yield measured()
            waiting = 0
    if held:
        yield measured()


def _common(bits: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``name`` and the first 64 characters of every name of ``bits``."""
    free = np.full(bits.shape[1], ~np.uint64(0))
    met, up = np.empty_like(free), np.empty_like(free)
    for c in name:
        np.bitwise_and(free, bits[c], out=met)
        np.add(free, met, out=up)
        np.subtract(free, met, out=free)
        np.bitwise_or(free, up, out=free)
    return 64 - np.bitwise_count(free).astype(np.int64)


def _divided(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    return np.divide(up, down, out=np.zeros(len(up)), where=down > 0)


def _rounded(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Fractions to six places as Python rounds them."""
    each, back = np.unique(up * (1 << 32) + down, return_inverse=True)
    return np.array([round((k >> 32) / d, 6) if (d := k & 0xFFFFFFFF) else 0.0 for k in each.tolist()], float)[back] if len(up) else np.zeros(0)


def _plain(a: str, b: str, ratio: float) -> float:
    """difflib's ratio; 0 where its bounds don't reach ``ratio``."""
    m = difflib.SequenceMatcher(None, a, b)
    return m.ratio() if m.real_quick_ratio() >= ratio and m.quick_ratio() >= ratio else 0.0
