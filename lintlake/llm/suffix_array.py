"""Suffix arrays of byte blocks in numpy: Larsson-Sadakane refinement, Kasai prefixes, binary search between arrays."""

from __future__ import annotations

import numpy as np

_PAD = 16


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as a number in their order (zeros past the end)."""
    padded = np.concatenate([text, np.zeros(_PAD, np.uint8)])
    view = np.lib.stride_tricks.as_strided(padded, (len(text), 8), (1, 1))
    return np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; a suffix that ends comes before its continuations."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = _words(text)
    order = np.argsort(words, kind="stable")
    ordered = words[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    # Within eight bytes of the end padding looks like zero bytes: there a shorter suffix is set apart by its length.
    starts = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)  # the suffix past the end has rank 0, the others their group's first place + 1
    rank[order] = starts + 1
    open_places = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))
    h = 8
    tail = np.arange(max(0, n - 8), n)
    if len(tail):  # groups that hold suffixes shorter than eight bytes are split by length first
        short = np.isin(rank[order[open_places]], rank[tail])
        open_places = _refined(order, rank, open_places, np.where(short, np.minimum(n - order[open_places], 8), 0))
    while len(open_places):
        later = np.minimum(order[open_places] + h, n)
        open_places = _refined(order, rank, open_places, rank[later])
        h *= 2
    return order


def _refined(order: np.ndarray, rank: np.ndarray, places: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Sorts the members of every open group by ``key``, renames the parts, and returns the places still open."""
    if not len(places):
        return places
    members = order[places]
    group = rank[members]
    by = np.lexsort((key, group))
    members, group, key = members[by], group[by], key[by]
    order[places] = members
    head = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
    rank[members] = np.maximum.accumulate(np.where(head, places, 0)) + 1
    return places[~(head & np.concatenate([head[1:], [True]]))]


def common_prefixes(text: np.ndarray, order: np.ndarray, lanes: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix in the array with the one before it, up to ``most`` (0 for the first).

    Kasai's rule - the prefix shrinks by one at most from a position to the next - walked from the start of every lane
    at once: ``lanes`` are ascending start positions that cut the text into stretches.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words = _words(text)
    found = np.zeros(n, np.int32)
    ends = np.append(lanes[1:], n)
    at, held = lanes.copy(), np.zeros(len(lanes), np.int64)
    alive = np.flatnonzero(at < ends)
    while len(alive):
        p = at[alive]
        q = before[p]
        h = np.maximum(held[alive] - 1, 0)
        h[q < 0] = 0
        grow = np.flatnonzero((q >= 0) & (h < most))
        while len(grow):
            a, b = p[grow] + h[grow], q[grow] + h[grow]
            inside = np.maximum(a, b) < n
            grow, a, b = grow[inside], a[inside], b[inside]
            differ = words[a] ^ words[b]
            equal = _leading_equal(differ)
            equal = np.minimum(equal, n - np.maximum(a, b))
            h[grow] += equal
            grow = grow[(equal == 8) & (h[grow] < most)]
        h = np.minimum(h, most)
        found[p] = h
        held[alive] = h
        at[alive] += 1
        alive = alive[at[alive] < ends[alive]]
    return found[order]


def _leading_equal(differ: np.ndarray) -> np.ndarray:
    """How many leading bytes of eight are equal, from the exclusive or of two words."""
    out = np.zeros(len(differ), np.int64)
    for k in range(1, 9):
        out += (differ >> np.uint64(64 - 8 * k)) == 0
    return out


def places_in(text: np.ndarray, order: np.ndarray, other: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each string of ``length`` bytes at ``starts`` of ``other``, whether a suffix in ``order`` of ``text`` begins with it.

    A binary search of all strings at once; strings are compared word by word. Every start and every suffix in ``order`` must
    have ``length`` bytes.
    """
    if not len(order) or not len(starts):
        return np.zeros(len(starts), bool)
    mine, theirs = _words(text), _words(other)
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)

    def compare(places: np.ndarray, which: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the suffix against the string."""
        sign, left = np.zeros(len(which), np.int8), np.arange(len(which))
        for step in steps:
            a, b = mine[places[left] + step], theirs[starts[which[left]] + step]
            sign[left] = (a > b).astype(np.int8) - (a < b).astype(np.int8)
            left = left[a == b]
            if not len(left):
                break
        return sign

    todo = np.arange(len(starts))
    while len(todo):
        middle = (low[todo] + high[todo]) // 2
        less = compare(order[middle], todo) < 0
        low[todo[less]] = middle[less] + 1
        high[todo[~less]] = middle[~less]
        todo = todo[low[todo] < high[todo]]
    hit = low < len(order)
    out = np.zeros(len(starts), bool)
    which = np.flatnonzero(hit)
    out[which] = compare(order[low[which]], which) == 0
    return out
