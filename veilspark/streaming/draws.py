"""Uniform draws by key, those of many records at once."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest as digest

#: The first 64 bytes of XXH3's secret, as it reads them.
_SECRET = np.frombuffer(bytes.fromhex("b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248ee03590e6813a264c"), "<u8")
_LOW, _HALF = np.uint64((1 << 32) - 1), np.uint64(32)
#: Keys of so many bytes are hashed together.
SHORTEST, LONGEST = 17, 64
_TENS = 10 ** np.arange(1, 19, dtype=np.int64)


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The upper and the lower half of a * b, taken as 128 bits, by exclusive or."""
    a0, a1, b0, b1 = a & _LOW, a >> _HALF, b & _LOW, b >> _HALF
    one = a1 * b0 + (a0 * b0 >> _HALF)
    two = a0 * b1 + (one & _LOW)
    return (a * b) ^ (a1 * b1 + (one >> _HALF) + (two >> _HALF))


def hashes(keys: np.ndarray) -> np.ndarray:
    """XXH3 with 64 bits of keys of one length, a row of bytes each."""
    n, size = keys.shape
    word = lambda at: np.ascontiguousarray(keys[:, at : at + 8]).view("<u8")[:, 0]
    out = np.full(n, size * 0x9E3779B185EBCA87 % 2**64, np.uint64)
    for j in range((size + 31) // 32):
        for at, s in ((16 * j, 4 * j), (size - 16 * j - 16, 4 * j + 2)):
            out += _fold(word(at) ^ _SECRET[s], word(at + 8) ^ _SECRET[s + 1])
    out ^= out >> np.uint64(37)
    out *= np.uint64(0x165667919E3779F9)
    return out ^ out >> _HALF


def uniforms(head: str, seqs: list[int], tails: list[str]) -> list[np.ndarray]:
    """For each tail the draws of the keys head + seq + tail, as ``Anonymizer._uniform`` makes them of one key."""
    lead, ends, at = np.frombuffer(head.encode(), np.uint8), [np.frombuffer(t.encode(), np.uint8) for t in tails], np.array(seqs, np.int64)
    found = [np.empty(len(at), np.uint64) for _ in tails]
    digits = np.where(at < 0, 0, np.searchsorted(_TENS, at, side="right") + 1)
    for width in np.unique(digits).tolist():
        some = np.flatnonzero(digits == width)
        start, rest = np.empty((len(some), len(lead) + width), np.uint8), at[some]
        start[:, : len(lead)] = lead
        for j in range(width):
            less = rest // 10
            start[:, len(lead) + width - 1 - j] = rest - 10 * less + 48
            rest = less
        for out, tail, end in zip(found, tails, ends):
            size = start.shape[1] + len(end)
            if not width or not SHORTEST <= size <= LONGEST:
                out[some] = [digest(f"{head}{seqs[i]}{tail}") for i in some.tolist()]
                continue
            keys = np.empty((len(some), size), np.uint8)
            keys[:, : start.shape[1]] = start
            keys[:, start.shape[1] :] = end
            out[some] = hashes(keys)
    return [((x >> np.uint64(12)).astype(float) + 0.5) / 2**52 for x in found]
