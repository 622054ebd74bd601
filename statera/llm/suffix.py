"""Suffix arrays of many strings at once by induced sorting, and their permuted common prefixes, in numpy.

Strings are the rows ("lanes") of a matrix.  Suffix array construction by induced sorting is a scan that cannot be
vectorised along a string, but lanes are independent, so each step of a scan handles one position of every lane.  Rows
are padded in front with a symbol above all others; the suffixes that start there are dropped at the end.  The
leftmost-smaller suffixes, from which all others are induced in one scan each way, need no scan: their substrings are
named by sorting packed words of symbols, in all lanes at once, and their order follows from names by doubling.

Inside, position ``i`` of lane ``k`` is number ``i * lanes + k``, so that a step of a scan reads neighbours in memory.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(text: np.ndarray, n_symbols: int) -> np.ndarray:
    """Suffix arrays of all rows of ``text`` (symbols 1 .. n_symbols - 1, and 0 in the last column only)."""
    return np.ascontiguousarray(_suffix_arrays(np.ascontiguousarray(text.T), n_symbols).T)


def _suffix_arrays(text: np.ndarray, n_symbols: int) -> np.ndarray:
    n, lanes = text.shape
    if n == 1:
        return np.zeros((1, lanes), np.int32)
    # classify: a suffix is small if it is less than the next one; equal symbols take the type of what follows
    small = np.ones((n, lanes), bool)
    for i in range(n - 2, -1, -1):
        np.less(text[i], text[i + 1], out=small[i])
        same = text[i] == text[i + 1]
        small[i] |= same & small[i + 1]
    lms = np.zeros((n, lanes), bool)
    lms[1:] = small[1:] & ~small[:-1]
    slot = (text.astype(np.int64) * lanes + np.arange(lanes)).reshape(-1)  # bucket of each position
    size = np.bincount(slot, minlength=lanes * n_symbols).reshape(n_symbols, lanes)
    end = np.cumsum(size, axis=0)
    lane = np.arange(lanes)
    tail, head = (end * lanes + lane).reshape(-1), ((end - size) * lanes + lane).reshape(-1)
    # the position before each one if it has the type in question, else -1; the last element answers for an empty slot
    before = np.arange(-lanes, (n - 1) * lanes + 1, dtype=np.int64)
    before[-1] = -1
    large_before, small_before = before.copy(), before
    large_before[:lanes] = small_before[:lanes] = -1
    large_before[lanes:-1][small[:-1].reshape(-1)] = -1
    small_before[lanes:-1][~small[:-1].reshape(-1)] = -1

    def induced(at: np.ndarray) -> np.ndarray:
        """Sort all suffixes from the leftmost-smaller ones, given in their order in each lane."""
        sa = np.full(n * lanes, -1, np.int64)
        b, order = _sorted(slot[at], np.arange(len(at)))
        first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        count = np.diff(np.append(first, len(b)))
        rank = np.arange(len(b)) - np.repeat(first, count)
        sa[tail[b] + (rank - np.repeat(count, count)) * lanes] = at[order]
        rows = sa.reshape(n, lanes)
        place = head.copy()
        for row in rows:
            p = large_before[row]
            p = p[p >= 0]
            s = slot[p]
            to = place[s]
            sa[to] = p
            to += lanes
            place[s] = to
        place = tail.copy()
        for row in rows[::-1]:
            p = small_before[row]
            p = p[p >= 0]
            s = slot[p]
            to = place[s]
            to -= lanes
            sa[to] = p
            place[s] = to
        return sa

    # leftmost-smaller positions lane by lane, in text order
    who, where = np.nonzero(lms.T)
    sa = induced((where * lanes + who)[_leftmost_smaller(text, n_symbols, who, where)])
    return (sa.reshape(n, lanes) // lanes).astype(np.int32)


def _sorted(*keys: np.ndarray) -> list[np.ndarray]:
    """Non-negative columns sorted by the first, then the next; packed into words where they fit."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) > 63:
        order = np.lexsort(keys[::-1])
        return [k[order] for k in keys]
    word = keys[0].astype(np.int64)
    for k, width in zip(keys[1:], bits[1:]):
        word = (word << width) | k
    word.sort()
    out = []
    for width in bits[:0:-1]:
        out.append(word & ((1 << width) - 1))
        word = word >> width
    return [word, *out[::-1]]


def _named(name: np.ndarray, key: np.ndarray) -> np.ndarray:
    """New names in the order of (name, key), both sorted: a name is the number of entries before those that have it."""
    place = np.arange(len(name))
    turn = name[1:] != name[:-1]
    of_name = np.maximum.accumulate(np.where(np.append(True, turn), place, 0))
    of_both = np.maximum.accumulate(np.where(np.append(True, turn | (key[1:] != key[:-1])), place, 0))
    return name + (of_both - of_name)


def _leftmost_smaller(text: np.ndarray, n_symbols: int, who: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The order of the suffixes at these positions, given lane by lane, in each lane."""
    n, lanes = text.shape
    total = len(who)
    # words of as many symbols as fit; a substring ends with the first symbol of the next, and then all bits are set:
    # of two that begin alike, the longer one goes on with a larger suffix there, so it comes first
    bits = n_symbols.bit_length()
    per, packed = 1, text.astype(np.uint64)
    while 2 * per * bits <= 64:
        packed <<= np.uint64(per * bits)
        packed[: max(n - per, 0)] |= packed[per:] >> np.uint64(per * bits)
        per *= 2
    packed = packed.reshape(-1)
    rest = np.array([(1 << (bits * (per - k))) - 1 for k in range(per + 1)], np.uint64)  # the places after k symbols
    last = np.append(who[1:] != who[:-1], True)
    size = np.where(last, 1, np.append(where[1:], n) - where + 1)
    at = where * lanes + who

    def words(some: np.ndarray, k: int) -> np.ndarray:
        begin = np.minimum(at[some] + k * per * lanes, n * lanes - 1)
        return packed[begin] | rest[np.clip(size[some] - k * per, 0, per)]

    word = words(np.arange(total), 0)
    order = np.argsort(word)
    name = np.empty(total, np.int64)
    name[order] = _named(np.zeros(total, np.int64), word[order])
    for k in range(1, -(-int(size.max()) // per)):
        goes_on = np.zeros(total, bool)
        goes_on[name[size > k * per]] = True
        some = np.flatnonzero(goes_on[name] & (np.bincount(name, minlength=total)[name] > 1))
        if not len(some):
            break
        word = words(some, k)
        order = np.lexsort((word, name[some]))
        name[some[order]] = _named(name[some[order]], word[order])
    # suffixes are alike in ``step`` substrings where their ranks are; the end of a lane is unlike all else in it
    lane, name, at = _sorted(who, name, np.arange(total))
    rank = np.empty(total, np.int64)
    rank[at] = _named(np.searchsorted(lane, lane), name)
    step = 1
    while True:
        live = np.flatnonzero(np.bincount(rank, minlength=total)[rank] > 1)
        if not len(live):
            break
        own, following, live = _sorted(rank[live], rank[live + step], live)
        rank[live] = _named(own, following)
        step *= 2
    order = np.empty(total, np.int64)
    order[rank] = np.arange(total)
    return order


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """In text order: how many symbols each suffix shares with the one before it in its suffix array.

    ``text`` are bytes and ``sa`` holds every position of a lane.  Where a suffix and its predecessor follow the same
    symbol, it shares one symbol less than the suffix before it in the text (the linear recurrence), so only the others
    are compared, word by word.
    """
    lanes, n = text.shape
    base = (np.arange(lanes, dtype=np.int64) * n)[:, None]
    flat_sa = sa.astype(np.int64) + base
    before = np.full(lanes * n, -1, np.int64)  # the predecessor of each position, none for the least suffix
    before[flat_sa[:, 1:].reshape(-1)] = flat_sa[:, :-1].reshape(-1)
    flat = text.reshape(-1)
    here = np.arange(lanes * n, dtype=np.int64)
    starts = here % n == 0
    free = (before < 0) | starts | (before % n == 0) | (flat[here - 1] != flat[np.maximum(before - 1, 0)])
    out = np.zeros(lanes * n, np.int64)
    at = np.flatnonzero(free & (before >= 0))
    data = np.concatenate([flat, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    a, b = at, before[at]
    room = n - np.maximum(a % n, b % n)
    live = np.arange(len(at))
    shared = np.zeros(len(at), np.int64)
    while len(live):
        x, y = words[a[live] + shared[live]].view("<u8")[:, 0], words[b[live] + shared[live]].view("<u8")[:, 0]
        x ^= y
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
        shared[live] += same
        live = live[(same == 8) & (shared[live] < room[live])]
    out[at] = np.minimum(shared, room)
    # the others: one less for each step from the last compared position
    last = np.maximum.accumulate(np.where(free, here, 0))
    return np.maximum(out[last] - (here - last), 0).reshape(lanes, n)
