"""Sets of word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

#: A-Z to a-z, and the white space that parts words to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers, and those of its inverse, up to n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, _U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    joined = b" ".join(texts).translate(_TABLE) + b" "
    data = np.frombuffer(joined, np.uint8)
    word = data != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    powers, inverse = _grow(len(data))
    sums = np.concatenate([[_U(0)], np.cumsum((data.astype(_U) + _U(1)) * powers, dtype=_U)])
    hashes = _mix((sums[ends] - sums[starts]) * inverse[starts])
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, begins)
    run = np.zeros(max(0, len(hashes) - k + 1), _U)
    for j in range(k):
        run = _mix(run * _U(0xD6E8FEB86659FD93) + hashes[j : j + len(run)] + _U(k))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(run[a : b - k + 1]))
        elif b > a:
            one = np.zeros(1, _U)
            for j in range(a, b):
                one = _mix(one * _U(0xD6E8FEB86659FD93) + hashes[j : j + 1] + _U(b - a))
            out.append(one)
        else:
            out.append(np.zeros(0, _U))
    return out


def shingle_sets(texts: list[str | None], k: int = 5, piece: int = 1 << 18) -> list[np.ndarray]:
    """Each text's distinct shingles of k words, sorted by hash; with fewer words the whole text is one; null has none."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    with np.errstate(over="ignore"):
        for text in texts:
            held.append((text or "").encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size >= piece:
                out += _sets(held, k)
                held, size = [], 0
        return out + (_sets(held, k) if held else [])
