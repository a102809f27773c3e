"""Suffix arrays by linear grouping, for many independent texts at a time.

Phase 1 takes the groups of suffixes from the highest to the lowest.  For each suffix i of the group
its previous smaller pointer is the nearest j < i in a lower group; the suffixes pointed at are moved,
by group and by how many members point at them, to a new group right after their own, whose common
prefix is longer by that many times the group's.  In the end a group holds the suffixes that share their
longest Lyndon prefix.  Phase 2 takes the groups upwards and orders each by the place of what follows the
prefix, which is known by then.  Nothing is renamed and nothing recurses.

All texts advance together, one group each, so that a step is a handful of array operations.
"""

from __future__ import annotations

import numpy as np


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], ..., start[0] + size[0] - 1, start[1], ..."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def group_suffixes(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: positions dealt out by group, and for each group start its end and prefix length; groups by position."""
    n = len(text)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    sa = np.argsort(owner * (int(text.max(initial=0)) + 1) + text, kind="stable")
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    edge = np.flatnonzero(np.r_[True, (text[sa][1:] != text[sa][:-1]) | (owner[sa][1:] != owner[sa][:-1])]) if n else np.zeros(0, np.int64)
    group_of = np.empty(n, np.int64)
    group_of[sa] = np.repeat(edge, np.diff(np.r_[edge, n]))
    end, length = np.zeros(n, np.int64), np.ones(n, np.int64)
    end[edge] = np.r_[edge[1:], n] - 1
    prev = np.full(n, -1, np.int64)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    moving = np.zeros(n, bool)
    cur, base = bounds[1:].copy(), bounds[:-1].copy()
    live = cur > base
    cur, base = cur[live], base[live]
    while len(cur):
        start = group_of[sa[cur - 1]]
        size = cur - start
        if len(cur) == size.sum():
            members, of = sa[start], start
        else:
            members, of = sa[_spread(start, size)], np.repeat(start, size)
        j = np.where(first[members], -1, members - 1)
        # over what is higher, then over what is in the same group
        todo = np.flatnonzero((j >= 0) & (group_of[j] > of))
        while len(todo):
            j[todo] = prev[j[todo]]
            todo = todo[(j[todo] >= 0) & (group_of[j[todo]] > of[todo])]
        prev[members] = j
        todo = np.flatnonzero((j >= 0) & (group_of[j] == of))
        while len(todo):
            j[todo] = prev[j[todo]]
            prev[members[todo]] = j[todo]
            todo = todo[(j[todo] >= 0) & (group_of[j[todo]] == of[todo])]
        has = j >= 0
        if has.any():
            at = j[has]
            grown = length[of[has]]
            order = np.argsort(at, kind="stable")
            at, grown = at[order], grown[order]
            new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            times = np.diff(np.r_[new, len(at)])
            at, grown = at[new], grown[new]
            home = group_of[at]
            order = np.lexsort((times, home))
            at, grown, times, home = at[order], grown[order], times[order], home[order]
            block = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
            count = np.diff(np.r_[block, len(at)])
            tail = end[home[block]] - count + 1
            target = _spread(tail, count)
            source = isa[at]
            moving[at] = True
            inside = source >= np.repeat(tail, count)
            held = sa[target]
            out = held[~moving[held]]
            gap = source[~inside]
            sa[gap] = out
            isa[out] = gap
            sa[target] = at
            isa[at] = target
            moving[at] = False
            longer = length[home] + times * grown
            end[home[block]] -= count
            run = np.flatnonzero(np.r_[True, (home[1:] != home[:-1]) | (times[1:] != times[:-1])])
            many = np.diff(np.r_[run, len(at)])
            place = target[run]
            group_of[at] = np.repeat(place, many)
            length[place] = longer[run]
            end[place] = place + many - 1
        live = start > base
        cur, base = start[live], base[live]
    return sa, group_of, end, length


def suffix_arrays(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The positions of text, sorted by suffix within each of the texts text[bounds[k]:bounds[k + 1]].

    Each text must end with a symbol that is smaller than all others in it.
    """
    sa, group_of, end, length = group_suffixes(text, bounds)
    n = len(text)
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    starts = np.unique(group_of)
    starts = starts[end[starts] > starts]  # a group of one has its place
    owner = np.searchsorted(bounds, starts, "right")
    turn = np.arange(len(starts)) - np.searchsorted(owner, owner, "left")
    order = np.argsort(turn, kind="stable")
    edges = np.r_[np.flatnonzero(np.r_[True, np.diff(turn[order]) > 0]), len(order)] if len(order) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        start = starts[order[a:b]]
        size = end[start] - start + 1
        at, of = _spread(start, size), np.repeat(start, size)
        members, step = sa[at], length[of]
        after, repeats = members + step, np.zeros(len(members), np.int64)
        todo = np.flatnonzero(group_of[after] == of)
        while len(todo):
            after[todo] += step[todo]
            repeats[todo] += 1
            todo = todo[group_of[after[todo]] == of[todo]]
        members = members[np.lexsort((rank[after], repeats, of))]
        sa[at] = members
        rank[members] = at
    return sa
