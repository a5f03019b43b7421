"""Which 200-byte strings of a block of text occur twice: a suffix array by difference cover, in numpy.

The array is built bucket by bucket. First the suffixes at cover positions (those whose place mod V lies in COVER) are ranked:
by 32 bytes, then by doubling, since V places after a cover position lies another. Then each bucket's suffixes are sorted
by their first 32 bytes; a longer tie between two suffixes is decided by the ranks of the cover positions that lie the
same distance behind both, which exist for any two places by the choice of the cover. Ranks take part in three-way
partitions around a middle suffix, all open ties of a block at a time. Memory is a constant times the block.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference set: every distance mod V lies between exactly one ordered pair of it.
V, COVER = 31, (0, 1, 3, 8, 12, 18)
_in_cover = np.isin(np.arange(V), COVER)
#: The shortest way from two residues to cover positions of both.
SHIFT = np.array([[next(d for d in range(V) if _in_cover[(a + d) % V] and _in_cover[(b + d) % V]) for b in range(V)] for a in range(V)], dtype=np.int64)
HEAD = 32


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian number; text ends with 8 spare bytes."""
    n = len(text) - 8
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out <<= np.uint64(8)
        out |= text[i : n + i]
    return out


def _dense(order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Ranks of the sorted elements; same[k]: element k + 1 of the order equals element k."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(~same)])
    return rank


def cover_ranks(words: np.ndarray, n: int, depth: int) -> np.ndarray:
    """For each place of a text of n bytes that is a cover position its rank by ``depth`` bytes or more, else -1.
    Places from n on rank as 0, below all others."""
    at = np.flatnonzero(_in_cover[np.arange(n) % V])
    keys = [words[at + i] for i in range(24, -1, -8)]
    order = np.lexsort(keys)
    same = np.ones(max(len(at) - 1, 0), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    rank, known = _dense(order, same), V
    full = np.full(n + depth + 2 * V, -1, np.int64)
    while True:
        full[at] = rank + 1
        full[n:] = 0
        if known >= depth:
            return full
        key = (rank + 1) * (len(at) + 2) + full[np.minimum(at + known, n)]
        order = np.argsort(key, kind="stable")
        rank, known = _dense(order, key[order[1:]] == key[order[:-1]]), 2 * known


def repeated(text: np.ndarray, starts: np.ndarray, classes: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at each start also stand at another start of the same class."""
    n = len(text)
    if len(starts) < 2:
        return np.zeros(len(starts), bool)
    words = _words(np.concatenate([text, np.zeros(length + HEAD + 8, np.uint8)]))
    heads = [words[starts + i] for i in range(24, -1, -8)]
    order = np.lexsort([*heads, classes])
    tied = classes[order[1:]] == classes[order[:-1]]
    for k in heads:
        tied &= k[order[1:]] == k[order[:-1]]
    # proven[k]: elements k and k + 1 of the order are equal over ``length`` bytes
    proven = np.zeros(len(starts) - 1, bool)
    if tied.any():
        ranks = cover_ranks(words, n, length)
        group = np.concatenate([[0], np.cumsum(~tied)])
        sizes = np.bincount(group)
        place = np.flatnonzero(sizes[group] > 1)  # places of the order that lie in open ties
        group = group[place]
        while len(place):
            first = np.concatenate([[True], group[1:] != group[:-1]])
            head = np.flatnonzero(first)
            count = np.diff(np.append(head, len(group)))
            pivot = np.repeat(order[place[head + count // 2]], count)
            own = order[place]
            shift = SHIFT[starts[own] % V, starts[pivot] % V]
            side = np.sign(ranks[starts[own] + shift] - ranks[starts[pivot] + shift])
            key = np.repeat(np.arange(len(head)), count) * 3 + side + 1
            turn = np.argsort(key, kind="stable")
            order[place], key = own[turn], key[turn]
            equal = (key[1:] == key[:-1]) & (key[1:] % 3 == 1)
            proven[place[:-1][equal]] = True
            sizes = np.bincount(key)
            go = (key % 3 != 1) & (sizes[key] > 1)
            place, group = place[go], key[go]
    # neighbours in a tie that ranks told apart may still agree over ``length`` bytes
    check = np.flatnonzero(tied & ~proven)
    proven[check[_agree(words, starts[order[check]], starts[order[check + 1]], length)]] = True
    return _marked(order, proven)


def repeated_pairs(text: np.ndarray, starts: np.ndarray, classes: np.ndarray, length: int) -> np.ndarray:
    """The same for classes of at most two starts, whose order is one comparison."""
    words = _words(np.concatenate([text, np.zeros(8, np.uint8)]))
    order = np.argsort(classes, kind="stable")
    proven = classes[order[1:]] == classes[order[:-1]]
    check = np.flatnonzero(proven)
    proven[:] = False
    proven[check[_agree(words, starts[order[check]], starts[order[check + 1]], length)]] = True
    return _marked(order, proven)


def _agree(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Which pairs of places agree over ``length`` bytes, eight at a time."""
    left = np.arange(len(a))
    for i in [*range(0, length - 8, 8), length - 8]:
        keep = words[a + i] == words[b + i]
        left, a, b = left[keep], a[keep], b[keep]
    return left


def _marked(order: np.ndarray, proven: np.ndarray) -> np.ndarray:
    found = np.zeros(len(order), bool)
    found[order[1:][proven]] = True
    found[order[:-1][proven]] = True
    return found
