"""Suffix order by linear grouping.

Suffixes are first grouped by their Lyndon prefixes.  Groups are taken in descending order:
each suffix of the group points at the nearest suffix before it that lies in a lower group
(its previous smaller one), and the suffixes pointed at are split off their own groups, by
how many point at them, into new groups just above what is left.  When every group has been
taken, one ascending pass writes each suffix into the next free place of its group.  Ranks
are never renamed and the text is never sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of non-negative integers ``symbols``, in ascending order.

    A suffix that is a prefix of another comes first.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    _, first = np.unique(symbols, return_inverse=True)
    sizes = np.bincount(first)
    by_symbol = np.argsort(first, kind="stable")
    members: list[list[int]] = [m.tolist() for m in np.split(by_symbol, np.cumsum(sizes)[:-1])]
    group: list[int] = first.tolist()
    place = np.empty(n, np.int64)  # of a suffix among the members of its group
    place[by_symbol] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    slot: list[int] = place.tolist()
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    previous = [-1] * n
    jump = list(range(-1, n - 1))  # leads over suffixes of groups taken, shortened on the way
    taken = bytearray(n)
    order: list[int] = []
    at = len(members) - 1
    while at >= 0:
        own = members[at]
        order.append(at)
        if len(own) == 1:
            i = own[0]
            taken[i] = 1
            j = jump[i]
            if j >= 0 and taken[j]:
                while j >= 0 and taken[j]:
                    j = jump[j]
                while jump[i] != j:
                    k = jump[i]
                    jump[i] = j
                    i = k
            previous[own[0]] = j
            if j >= 0 and len(members[group[j]]) > 1:
                g = group[j]
                left, new = members[g], len(members)
                last = left.pop()
                if last != j:
                    left[slot[j]] = last
                    slot[last] = slot[j]
                slot[j] = 0
                group[j] = new
                members.append([j])
                up = above[g]
                below.append(g)
                above.append(up)
                above[g] = below[up] = new
            at = below[at]
            continue
        for i in own:
            taken[i] = 1
        pointed: dict[int, int] = {}
        for i in own:
            j = jump[i]
            if j >= 0 and taken[j]:
                while j >= 0 and taken[j]:
                    j = jump[j]
                k = i
                while jump[k] != j:
                    after = jump[k]
                    jump[k] = j
                    k = after
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        split: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            split.setdefault((times, group[j]), []).append(j)
        # greater counts first: each split goes directly above what is left of its group
        for times, g in sorted(split, reverse=True) if len(split) > 1 else split:
            moved, left = split[times, g], members[g]
            if len(moved) == len(left):
                continue
            new = len(members)
            for k, j in enumerate(moved):
                last = left.pop()
                if last != j:
                    left[slot[j]] = last
                    slot[last] = slot[j]
                slot[j] = k
                group[j] = new
            members.append(moved)
            up = above[g]
            below.append(g)
            above.append(up)
            above[g] = new
            below[up] = new  # a group that is pointed at is never the topmost
        at = below[at]
    # ascending pass
    start, free = [0] * len(members), 0
    for g in reversed(order):
        start[g] = free
        free += len(members[g])
    out = [0] * n
    done = bytearray(n)
    s = n - 1
    for k in range(n + 1):
        while s >= 0 and not done[s]:
            done[s] = 1
            g = group[s]
            out[start[g]] = s
            start[g] += 1
            s = previous[s]
        if k < n:
            s = out[k] - 1
    return np.array(out, np.int64)
