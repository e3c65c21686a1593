"""Suffix sorting by linear grouping construction, many independent strings in step.

Each string (lane) is an own suffix array problem; all lanes lie in one flat array and every numpy operation advances
all of them at once. Phase 1 keeps suffixes in groups by Lyndon prefix and takes each lane's groups in descending
order: every member finds its previous smaller suffix by pointers, and the suffixes pointed at leave their group for
new ones right behind it, by how often they were pointed at. Phase 2 walks each lane's order upwards and puts the
suffixes that end where the current one begins at the front of their groups, so groups come out sorted without
renaming or recursion.
"""

from __future__ import annotations

import numpy as np


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges [start, start + size), one after another."""
    ends = np.cumsum(sizes, dtype=starts.dtype)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=starts.dtype)


def suffix_arrays(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sorted suffixes of every lane, as places in the flat array; the end of a lane sorts before every symbol."""
    n, lengths = len(symbols), lengths[lengths > 0].astype(np.int32)
    if not n:
        return np.zeros(0, np.int32)
    ends = np.cumsum(lengths, dtype=np.int32)  # all places are 32-bit: half the memory to walk through
    base = ends - lengths
    lane = np.repeat(np.arange(len(lengths)), lengths)
    # Groups are intervals of sa; a group's number is its first place, end holds where it stops.
    keys = lane * (int(symbols.max()) + 1) + symbols
    sa = np.argsort(keys, kind="stable").astype(np.int32)
    keys = keys[sa]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).astype(np.int32)
    group = np.empty(n, np.int32)
    group[sa] = np.repeat(starts, np.diff(np.append(starts, n)))
    end = np.zeros(n + 1, np.int32)
    end[starts] = np.append(starts[1:], n)
    place = np.empty(n, np.int32)
    place[sa] = np.arange(n, dtype=np.int32)
    prev = np.arange(-1, n - 1, dtype=np.int32)
    pointed = np.zeros(n, bool)

    at, floor = ends.copy(), base
    while len(at):
        now = group[sa[at - 1]]
        sizes = at - now
        members = sa[ragged(now, sizes)]
        level, lowest = np.repeat(now, sizes), np.repeat(floor, sizes)
        j = members - 1
        todo = np.flatnonzero(j >= lowest)
        at_j, level, lowest = j[todo], level[todo], lowest[todo]
        while True:
            on = group[at_j] >= level
            todo, at_j, level, lowest = todo[on], prev[at_j[on]], level[on], lowest[on]
            if not len(todo):
                break
            j[todo] = at_j
            on = at_j >= lowest
            todo, at_j, level, lowest = todo[on], at_j[on], level[on], lowest[on]
        lowest = np.repeat(floor, sizes)
        prev[members] = j
        hit = j[j >= lowest]
        if len(hit):
            u, count = np.unique(hit, return_counts=True)
            g = group[u]
            order = np.lexsort((count, g))
            u, count, g = u[order], count[order], g[order]
            heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            own, moved = g[heads], np.diff(np.r_[heads, len(g)])
            slots = ragged(end[own] - moved, moved)
            pointed[u] = True
            there = sa[slots]
            out = there[~pointed[there]]
            pointed[u] = False
            if len(out):
                held = place[u]
                free = np.sort(held[held < np.repeat(end[own] - moved, moved)])
                sa[free], place[out] = out, free
            sa[slots], place[u] = u, slots
            runs = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (count[1:] != count[:-1])])
            sizes = np.diff(np.r_[runs, len(g)])
            end[own] -= moved
            end[slots[runs]] = slots[runs] + sizes
            group[u] = np.repeat(slots[runs], sizes)
        more = now > floor
        at, floor = now[more], floor[more]

    front = np.arange(n + 1, dtype=np.int32)  # next free place of each group, by its number
    placed = np.zeros(n + 1, bool)
    out = np.empty(n, np.int32)
    s, low, high, rank = ends.copy(), base.copy(), ends.copy(), base.copy()  # each lane starts from its end
    while len(s):
        j = s - 1
        on = (j >= low) & ~placed[j]
        j, least = j[on], low[on]
        while len(j):
            g = group[j]
            to = front[g]
            out[to], placed[j] = j, True
            front[g] = to + 1
            j = prev[j]
            on = (j >= least) & ~placed[j]
            j, least = j[on], least[on]
        more = rank < high
        rank, low, high = rank[more], low[more], high[more]
        s, rank = out[rank], rank + 1
    return out
