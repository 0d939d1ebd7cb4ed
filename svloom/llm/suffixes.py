"""Suffix arrays by induced sorting, and permuted common prefixes, in array operations."""

from __future__ import annotations

import numpy as np

#: Alphabets up to SMALL symbols are induced bucket by bucket. Larger ones are written in two or more digits; strings of up to SHORT symbols, and what is left after DEEP times (digits make strings longer), are induced suffix by suffix.
SMALL, SHORT, DEEP = 1024, 40_000, 4


def smaller_types(s: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one (S); the last symbol of ``s`` is its least, once."""
    n = len(s)
    place = np.where(s[:-1] != s[1:], np.arange(n - 1), n)
    nxt = np.minimum.accumulate(place[::-1])[::-1]
    return np.concatenate((s[nxt] < s[nxt + 1], [True]))


def leftmost(is_s: np.ndarray) -> np.ndarray:
    """Leftmost places of each run of S suffixes."""
    return np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1


def induced(s: np.ndarray, is_s: np.ndarray, size: int, first: np.ndarray) -> np.ndarray:
    """All suffixes in the order that leftmost S suffixes in the order ``first`` induce."""
    if size <= SMALL:
        s = s.astype(np.uint16)  # stable sorts of these are radix sorts
    counts = np.bincount(s, minlength=size)
    larger = np.bincount(s[~is_s], minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(len(s), -1, np.int32 if len(s) < 1 << 31 else np.int64)
    head = s[first]
    order = np.argsort(head, kind="stable")
    head, own = head[order], np.bincount(head, minlength=size)
    sa[ends[head] - own[head] + np.arange(len(head)) - (np.cumsum(own) - own)[head]] = first[order]
    if size > SMALL:
        return _one_by_one(s, is_s, sa, starts, ends)
    at = starts.copy()
    seen = np.flatnonzero(counts)

    def put(part: np.ndarray, kind: bool, step: int) -> None:
        """The suffixes before those of ``part``, as far as they are of this kind, to the next free places of their buckets."""
        j = part[part > 0] - 1
        j = j[is_s[j]] if kind else j[~is_s[j]]
        if len(j):
            t = s[j]
            order = np.argsort(t, kind="stable")
            t, n = t[order], np.bincount(t, minlength=size)
            rank = np.arange(len(t)) - (np.cumsum(n) - n)[t]
            sa[at[t] + rank if step > 0 else at[t] - 1 - rank] = j[order]
            at[:] += step * n

    for c in seen:
        done = starts[c]
        while done < at[c]:  # what a round adds to this bucket is the next one's part
            done, part = at[c], sa[done : at[c]]
            put(part, False, 1)
        put(sa[ends[c] - own[c] : ends[c]], False, 1)
    at = ends.copy()
    sa[0] = len(s) - 1
    at[s[-1]] -= 1
    for c in seen[::-1]:
        done = ends[c]
        while at[c] < done:
            done, part = at[c], sa[at[c] : done][::-1]
            put(part, True, -1)
        put(sa[starts[c] : starts[c] + larger[c]][::-1], True, -1)
    return sa


def _one_by_one(s: np.ndarray, is_s: np.ndarray, sa: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    text, kind, out = s.tolist(), is_s.tolist(), sa.tolist()
    at = starts.tolist()
    for i in range(len(out)):
        j = out[i] - 1
        if j >= 0 and not kind[j]:
            c = text[j]
            out[at[c]] = j
            at[c] += 1
    at = ends.tolist()
    for i in range(len(out) - 1, 0, -1):
        j = out[i] - 1
        if j >= 0 and kind[j]:
            c = text[j]
            at[c] -= 1
            out[at[c]] = j
    out[0] = len(text) - 1
    return np.array(out, np.int64)


def by_digits(s: np.ndarray, size: int, deep: int) -> np.ndarray:
    """``suffix_array`` of a large alphabet: digits of one number of places keep the order."""
    places = 2
    while (SMALL - 2) ** places < size:
        places += 1
    base = int(np.ceil(size ** (1 / places))) + 1
    out = np.zeros(len(s) * places + 1, np.int64)
    for k in range(places):
        out[k:-1:places] = s // base ** (places - 1 - k) % base + 1
    sa = suffix_array(out, base + 1, deep - 1)[1:]
    return sa[sa % places == 0] // places


def suffix_array(s: np.ndarray, size: int, deep: int = DEEP) -> np.ndarray:
    """Order of the suffixes of ``s``, whose symbols are below ``size`` and whose last one is 0 and occurs once.

    Leftmost S substrings are sorted by inducing from their first symbols and
    named; unless names differ, the string of names is sorted in the same way.
    Their order then induces that of all suffixes.
    """
    if len(s) < 2:
        return np.arange(len(s))
    if size > SMALL and len(s) > SHORT and deep:
        return by_digits(s, size, deep)
    s = s.astype(np.uint16 if size <= SMALL else np.int64)
    is_s = smaller_types(s)
    lms = leftmost(is_s)
    sa = induced(s, is_s, size, lms).astype(np.int64)
    marked = np.zeros(len(s), bool)
    marked[lms] = True
    order = sa[marked[sa]]
    length = np.zeros(len(s), np.int64)
    length[lms] = np.diff(np.append(lms, len(s) - 1)) + 1
    p, q = order[:-1], order[1:]
    same = length[p] == length[q]
    todo, k = np.flatnonzero(same), 0
    while len(todo):
        fits = s[p[todo] + k] == s[q[todo] + k]
        same[todo[~fits]] = False
        k += 1
        todo = todo[fits]
        todo = todo[length[p[todo]] > k]
    name = np.zeros(len(s), np.int64)
    name[order] = np.concatenate(([0], np.cumsum(~same)))
    names = int(name[order[-1]]) + 1
    if names < len(lms):
        order = lms[suffix_array(name[lms], names, deep)]
    return induced(s, is_s, size, order).astype(np.int64)


def words_at(b: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a number, the first one lowest; zeros behind the end."""
    b = np.concatenate((b, np.zeros(8, np.uint8)))
    return np.lib.stride_tricks.sliding_window_view(b, 8).copy().view("<u8").ravel()


def permuted_prefixes(b: np.ndarray, sa: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place of the bytes ``b``: bytes its suffix shares with the one before it in order, at most ``room``; and that one's place (-1: none).

    A suffix whose preceding byte equals its neighbour's shares one byte less
    than the suffix before it; only the others are compared.
    """
    n = len(b)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    shared = np.zeros(n, np.int64)
    prior = np.arange(n) - 1
    follows = (before > 0) & (prior >= 0)
    follows[follows] = b[prior[follows]] == b[before[follows] - 1]
    # the neighbours of a suffix and the next one may be others, where a room ends
    follows[1:] &= room[1:] == room[:-1] - 1
    own = np.flatnonzero(~follows & (before >= 0))
    w, todo, k = words_at(b), own, 0
    while len(todo):
        d = w[todo + k] ^ w[np.minimum(before[todo] + k, n)]
        whole = d == 0
        ends = todo[~whole]
        low = d[~whole]
        low = low & (~low + np.uint64(1))
        shared[ends] = k + np.log2(low.astype(float)).astype(np.int64) // 8
        k += 8
        shared[todo[whole]] = k
        todo = todo[whole]
        todo = todo[room[todo] > k]
    shared = np.minimum(shared, room)
    # forward: shared + place is the same as at the last compared place
    last = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return np.maximum(0, shared[last] + last - np.arange(n)), before
