"""Suffix arrays by induced sorting, a bucket of suffixes at a time.

Suffixes are classified as S (smaller than the next one) or L; an LMS position is an S after an L.
The leftmost-smaller substrings are sorted by inducing, and named; repeated names are told apart
recursively, each level naming pairs of names of the level below; from the sorted LMS suffixes one
pass over the buckets upwards induces the L suffixes and one downwards the S suffixes. Each pass
handles the suffixes of a bucket together: one of numpy's steps for each round of a repeated
character, instead of one of Python's for each suffix.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S; the last one, the sentinel, is."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])  # a run's type is that of its last character
    rises = text[change + 1] > text[change]
    out = np.ones(n, bool)
    if len(change):
        runs = np.diff(np.concatenate(([-1], change)))
        out[: change[-1] + 1] = np.repeat(rises, runs)
    return out


def _induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes, induced from ``lms`` in the order given. ``text`` ends with a unique least character."""
    n = len(text)
    parts_l: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    parts_s: list[list[np.ndarray]] = [[] for _ in range(sigma)]

    def deal(to: list[list[np.ndarray]], found: np.ndarray) -> None:
        chars = text[found]
        order = np.argsort(chars, kind="stable")
        found, chars = found[order], chars[order]
        cut = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1])))
        for c, part in zip(chars[cut].tolist(), np.split(found, cut[1:])):
            to[c].append(part)

    seeds: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    deal(seeds, lms)
    none = np.zeros(0, np.int64)
    larger: list[np.ndarray] = []
    for c in range(sigma):
        k = 0
        while k < len(parts_l[c]):  # grows while characters repeat
            before = parts_l[c][k] - 1
            before = before[before >= 0]
            before = before[~is_s[before]]
            if len(before):
                deal(parts_l, before)
            k += 1
        larger.append(np.concatenate(parts_l[c]) if parts_l[c] else none)
        if seeds[c]:
            before = np.concatenate(seeds[c]) - 1
            before = before[before >= 0]
            before = before[~is_s[before]]
            if len(before):
                deal(parts_l, before)
    smaller: list[np.ndarray] = [none] * sigma
    for c in range(sigma - 1, -1, -1):  # everything in descending order
        k = 0
        while k < len(parts_s[c]):
            before = parts_s[c][k] - 1
            before = before[before >= 0]
            before = before[is_s[before]]
            if len(before):
                deal(parts_s, before)
            k += 1
        smaller[c] = np.concatenate(parts_s[c])[::-1] if parts_s[c] else none
        before = larger[c][::-1] - 1
        before = before[before >= 0]
        before = before[is_s[before]]
        if len(before):
            deal(parts_s, before)
    smaller[text[n - 1]] = np.concatenate(([n - 1], smaller[text[n - 1]]))
    return np.concatenate([x for c in range(sigma) for x in (larger[c], smaller[c])])


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``names``: pairs are named, then pairs of pairs, until all differ."""
    n, step = len(names), 1
    rank = names.astype(np.int64)
    while True:
        second = np.zeros(n, np.int64)
        if step < n:
            second[:-step] = rank[step:] + 1
        pair = rank * (n + 2) + second
        order = np.argsort(pair, kind="stable")
        value = pair[order]
        new = np.concatenate(([0], np.cumsum(value[1:] != value[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The suffix array of an array of bytes; a suffix is smaller than those that it begins."""
    text = np.concatenate((data.astype(np.int64) + 1, [0]))
    if len(text) == 1:
        return np.zeros(0, np.int64)
    sigma = int(text.max()) + 1
    is_s = classify(text)
    is_lms = np.concatenate(([False], is_s[1:] & ~is_s[:-1]))
    lms = np.flatnonzero(is_lms)
    by_substring = _induce(text, is_s, lms, sigma)
    by_substring = by_substring[is_lms[by_substring]]
    # name the LMS substrings: equal if they have the same characters up to the next LMS, inclusive
    after = np.full(len(text), len(text) - 1)
    after[lms[:-1]] = lms[1:]
    length = after[by_substring] - by_substring + 1
    a, b = by_substring[:-1], by_substring[1:]
    same = length[:-1] == length[1:]
    todo, k = np.flatnonzero(same), 0
    while len(todo):
        equal = text[a[todo] + k] == text[b[todo] + k]
        same[todo[~equal]] = False
        todo = todo[equal]
        k += 1
        todo = todo[length[todo] > k]
    names = np.concatenate(([0], np.cumsum(~same)))
    if names[-1] < len(lms) - 1:
        name_of = np.empty(len(text), np.int64)
        name_of[by_substring] = names
        by_substring = lms[_sort_names(name_of[lms])]
    return _induce(text, is_s, by_substring, sigma)[1:]  # without the sentinel


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as one number; shorter by seven than ``data``."""
    b = data.astype(np.uint16)
    b = b[:-1] | (b[1:] << np.uint16(8))
    c = b.astype(np.uint32)
    c = c[:-2] | (c[2:] << np.uint32(16))
    d = c.astype(np.uint64)
    return d[:-4] | (d[4:] << np.uint64(32))


def permuted_lcp(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, ``most`` at most, of each suffix with its predecessor in ``order``; by text position.

    ``order`` may list some of the suffixes only; the others, and the first, have 0.
    """
    words = words8(np.concatenate((data, np.zeros(most + 16, np.uint8))))
    room = len(data) - order
    here, there = order[1:], order[:-1]
    limit = np.minimum(np.minimum(room[1:], room[:-1]), most)
    got = np.zeros(len(here), np.int64)
    todo = np.arange(len(here))
    for k in range(0, most, 8):
        differ = words[here[todo] + k] ^ words[there[todo] + k]
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        got[todo] += equal
        todo = todo[(equal == 8) & (limit[todo] > k + 8)]
        if not len(todo):
            break
    out = np.zeros(len(data), np.int64)
    out[here] = np.minimum(got, limit)
    return out
