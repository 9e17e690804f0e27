"""64-bit hashes of the lower-cased words of many texts at once.

Words are runs of bytes other than ASCII white space, A-Z lower-cased, as the operators' contracts have it. A word's hash is
a polynomial over random values of its bytes, modulo 2 ** 64, mixed; all words of a stretch of texts come from one running
sum. Words of more than LONG bytes, for which such polynomials are known to collide, get a cryptographic hash instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Bytes of text that are hashed together, about; a longer text is taken alone.
STRETCH = 1 << 19
LONG = 255

_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True
_base = np.uint64(0xD1B54A32D192ED03)
_inverse = np.uint64(pow(int(_base), -1, 1 << 64))


def digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


_value = np.array([digest(bytes([b]).lower()) | 1 for b in range(256)], np.uint64)


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, modulo 2 ** 64, and of its inverse."""
    up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (_base, _inverse))
    return up, down


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h ^ np.uint64(salt)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _words(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
    blank = _blank[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    first, end = edges[0::2], edges[1::2]
    up, down = powers(max(2 * STRETCH, 1 << (data.size - 1).bit_length()))
    sums = np.cumsum(_value[data] * up[: data.size])
    h = mixed((sums[end - 1] - sums[first - 1]) * down[first])
    for i in np.flatnonzero(end - first > LONG).tolist():
        h[i] = digest(data[first[i] : end[i]].tobytes().lower())
    text_ends = np.cumsum([len(p) + 1 for p in parts])
    return h, np.append(0, np.searchsorted(first, text_ends))


def hashed(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order (null: none)."""
    lo = 0
    while lo < len(texts):
        parts: list[bytes] = []
        size = 0
        for text in texts[lo:]:
            part = text.encode("utf-8", "surrogatepass") if text else b""
            if parts and size + len(part) > STRETCH:
                break
            parts.append(part)
            size += len(part)
        h, at = _words(parts)
        yield from (h[a:b] for a, b in zip(at.tolist(), at[1:].tolist()))
        lo += len(parts)


def sums_of(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n neighbouring words (none if there are fewer), not mixed."""
    size = max(0, h.size - n + 1)
    total = np.zeros(size, np.uint64)
    factors = powers(2 * STRETCH)[0]
    for k in range(n if size else 0):
        total += h[k : k + size] * factors[k + 1]
    return total


def extremes(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op (minimum or maximum) of every `width` neighbouring values."""
    size = 1
    while 2 * size <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: x.size - (width - size)], x[width - size :]) if size < width else x


def winnowed(total: np.ndarray, width: int) -> np.ndarray:
    """Places of values that are the smallest of some `width` neighbouring ones."""
    if total.size <= width:
        return np.array([int(total.argmin())]) if total.size else np.zeros(0, np.int64)
    low = extremes(total, width, np.minimum)
    pad = np.zeros(width - 1, total.dtype)
    return np.flatnonzero(extremes(np.concatenate([pad, low, pad]), width, np.maximum) == total)
