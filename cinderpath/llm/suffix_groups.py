"""Suffix arrays by linear grouping: suffixes are grouped by their Lyndon prefixes, then each group is ordered.

After Baier, "Linear-time suffix sorting - a new approach for suffix array construction" (CPM 2016).
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in ascending order; a sentinel below all symbols is understood at the end.

    Groups are numbered by where they begin in the final order. First phase, from the highest group down: the
    previous-smaller pointer of each member leads to the last position before it in a lower group; the Lyndon
    prefix there grows by this group's, once for each member that points to it, so those positions leave their
    group for new ones just above it, more repeats higher. Second phase, in ascending order: of each suffix that
    has its place, the suffixes whose Lyndon prefix ends there, by the same pointers, take the next place of
    their group. Neither phase renames or recurses.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    _, letter, count = np.unique(text, return_inverse=True, return_counts=True)
    begin = np.cumsum(count) - count
    group: list[int] = begin[letter.ravel()].tolist()
    order = np.argsort(letter.ravel(), kind="stable")
    members: dict[int, list[int]] = {int(b): order[b : b + c].tolist() for b, c in zip(begin, count, strict=True)}
    size: dict[int, int] = {int(b): int(c) for b, c in zip(begin, count, strict=True)}
    begins = [0] * n  # of the group that ends at a position
    for b, c in size.items():
        begins[b + c - 1] = b
    previous = [-1] * n
    shift = n.bit_length()
    low = (1 << shift) - 1

    end = n - 1
    while end >= 0:
        here = begins[end]
        end = here - 1
        # Members that have left for a higher group are still listed here.
        last, moved, times = -1, [], 0
        for s in members.pop(here):
            if group[s] != here:
                continue
            p = s - 1
            while p >= 0 and group[p] >= here:
                p = previous[p]
            previous[s] = p
            if p < 0:
                continue
            if p == last:
                times += 1
            else:
                if times:
                    moved.append(((group[last] << shift | times) << shift) | last)
                last, times = p, 1
        if times:
            moved.append(((group[last] << shift | times) << shift) | last)
        if not moved:
            continue
        moved.sort()
        i, m = 0, len(moved)
        while i < m:
            old = moved[i] >> 2 * shift
            j = i + 1
            while j < m and moved[j] >> 2 * shift == old:
                j += 1
            left = size[old] - (j - i)
            at = old + left
            if left:
                size[old] = left
                begins[at - 1] = old
            while i < j:
                word = moved[i] >> shift
                k = i + 1
                while k < j and moved[k] >> shift == word:
                    k += 1
                these = [x & low for x in moved[i:k]]
                if at != old:
                    for s in these:
                        group[s] = at
                    members[at] = these
                elif k - i != size[old]:
                    members[at] = these
                size[at] = k - i
                begins[at + k - i - 1] = at
                at += k - i
                i = k
    free = list(range(n))  # at each group's beginning: its next free place
    out = [-1] * n
    open_ = bytearray(b"\1") * n
    for i in range(-1, n):
        s = (out[i] if i >= 0 else n) - 1
        while s >= 0 and open_[s]:
            open_[s] = 0
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            s = previous[s]
    return np.array(out, np.int64)
