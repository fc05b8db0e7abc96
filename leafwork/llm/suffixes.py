"""Suffix arrays by linear grouping.

Phase 1 sorts suffixes into groups by their Lyndon prefixes: groups are processed in descending order; each member
points to the nearest earlier suffix of a smaller group (its previous smaller one), and the suffixes pointed at move,
by how many members point at them, into new groups right behind their own. Phase 2 emits every group's order: going up
the array, the suffixes that end where a placed one starts are taken along the pointers. No names are given anew and
nothing is sorted recursively.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of an integer string in ascending order (a prefix comes first)."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    first = np.argsort(symbols, kind="stable")
    ranked = np.asarray(symbols)[first]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    start_of = np.empty(n, np.int64)
    start_of[first] = np.repeat(heads, np.diff(np.append(heads, n)))
    order, group = first.tolist(), start_of.tolist()  # order[group[i] : end[group[i]]] is i's group
    at = np.empty(n, np.int64)
    at[first] = np.arange(n)
    at = at.tolist()
    end = [0] * n
    for h, e in zip(heads.tolist(), np.append(heads, n)[1:].tolist()):
        end[h] = e
    smaller = [-1] * n
    high = n
    while high:
        g = group[order[high - 1]]
        if high - g == 1:
            i = order[g]
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:  # one suffix moves to the end of its group
                h = group[j]
                e = end[h] - 1
                if e > h:
                    k, other = at[j], order[e]
                    order[k], order[e], at[other], at[j] = other, j, k, e
                    end[h], end[e], group[j] = e, e + 1, e
            high = g
            continue
        members = sorted(order[g:high])
        times: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        by_times: dict[int, list[int]] = {}
        for j, t in times.items():
            by_times.setdefault(t, []).append(j)
        for t in sorted(by_times, reverse=True):
            moved: dict[int, int] = {}
            for j in by_times[t]:
                h = group[j]
                e = moved[h] = moved.get(h, end[h]) - 1
                k, other = at[j], order[e]
                order[k], order[e], at[other], at[j] = other, j, k, e
            for h, e in moved.items():
                if e > h:
                    end[e], end[h] = end[h], e
                    for k in range(e, end[e]):
                        group[order[k]] = e
        high = g
    out, free, placed = [0] * n, list(range(n)), bytearray(n)
    j = n - 1
    while j >= 0:  # those that end with the string
        h = group[j]
        out[free[h]] = j
        free[h] += 1
        placed[j] = 1
        j = smaller[j]
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            h = group[j]
            out[free[h]] = j
            free[h] += 1
            placed[j] = 1
            j = smaller[j]
    return np.array(out, np.int64)
