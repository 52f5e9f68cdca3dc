"""Suffix arrays by linear grouping construction, for many strings at once.

Phase 1 sorts the suffixes into groups by their Lyndon prefixes: groups are
processed in descending order; a group's members leave the list of open
suffixes, and each open suffix that stands before a run of them (the previous
smaller one) moves into a new group right above its own, the higher the longer
the run. Phase 2 emits the order: from left to right, the suffix before an
emitted one, and the chain of its previous smaller pointers, take the next free
places of their groups. No names are given anew and nothing recurses.

The strings lie one after the other in one array and advance in lockstep: each
step processes the highest open group of every string, so the work is done by
array operations however short the strings are.
"""

from __future__ import annotations

import numpy as np


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (size[0] of them), start[1], ..."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def group_suffixes(symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: (first place of each suffix's group, previous smaller suffix or -1)."""
    n = len(symbols)
    owner = np.repeat(np.arange(len(low)), high - low)
    order = np.lexsort((symbols, owner))                    # places -> suffixes
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = (symbols[order][1:] != symbols[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    first = np.flatnonzero(new)
    group = np.empty(n, np.int64)                           # of a suffix: its group's first place
    group[order] = first[np.cumsum(new) - 1]
    end = np.zeros(n + 1, np.int64)                         # of a group, by its first place
    end[first] = np.append(first[1:], n)
    left, right = np.arange(-1, n), np.arange(1, n + 2)     # open suffixes; -1 and n: none
    left[low], right[high - 1] = -1, n
    previous = np.full(n, -1, np.int64)
    moved = np.zeros(n, bool)
    top = high.copy()
    open_ = np.flatnonzero(top > low)
    while len(open_):
        stop = top[open_]
        start = group[order[stop - 1]]
        members = np.sort(order[_ragged(start, stop - start)])
        top[open_] = start
        # runs of members that are neighbours among the open suffixes
        before = left[members]
        head = np.ones(len(members), bool)
        head[1:] = before[1:] != members[:-1]
        at = np.flatnonzero(head)
        length = np.diff(np.append(at, len(members)))
        lead, after = before[at], right[members[np.append(at[1:], len(members)) - 1]]
        previous[members] = np.repeat(lead, length)
        some = lead >= 0
        right[lead[some]] = after[some]
        some = after < n
        left[after[some]] = lead[some]
        # the suffixes before the runs rise, by the lengths of the runs
        some = lead >= 0
        if some.any():
            lead, length = lead[some], length[some]
            own = group[lead]
            by = np.lexsort((length, own))
            lead, length, own = lead[by], length[by], own[by]
            new = np.ones(len(own), bool)
            new[1:] = own[1:] != own[:-1]
            starts = np.flatnonzero(new)
            count = np.diff(np.append(starts, len(own)))
            base = end[own[starts]] - count                 # they take the last places of their group
            target = _ragged(base, count)
            moved[lead] = True
            held = order[target]
            held = held[~moved[held]]
            free = place[lead]
            free = free[free < np.repeat(base, count)]
            order[free], place[held] = held, free
            order[target], place[lead] = lead, target
            moved[lead] = False
            end[own[starts]] = base
            new[1:] |= length[1:] != length[:-1]
            starts = np.flatnonzero(new)
            count = np.diff(np.append(starts, len(own)))
            end[target[starts]] = target[starts] + count
            group[lead] = np.repeat(target[starts], count)
        open_ = open_[top[open_] > low[open_]]
    return group, previous


def suffix_arrays(symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Suffix arrays of the strings symbols[low:high], each in its own places, as
    indices into ``symbols``. Each string ends with a symbol below all others."""
    group, previous = group_suffixes(symbols, low, high)
    n = len(symbols)
    out = np.full(n, -1, np.int64)
    free = np.arange(n)                                     # next free place of a group, by its first place
    done = np.zeros(n, bool)
    at, base, stop = low.copy(), low.copy(), high.copy()
    out[at] = stop - 1
    done[stop - 1] = True
    free[low] += 1
    link = stop - 2
    while len(at):
        fresh = link >= base
        fresh[fresh] = ~done[link[fresh]]
        j = link[fresh]
        g = group[j]
        out[free[g]] = j
        free[g] += 1
        done[j] = True
        link[fresh] = previous[j]
        stale = ~fresh
        at[stale] += 1
        go = stale & (at < stop)
        link[go] = out[at[go]] - 1
        alive = at < stop
        if not alive.all():
            at, base, stop, link = at[alive], base[alive], stop[alive], link[alive]
    return out
