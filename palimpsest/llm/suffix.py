"""Suffix order by grouping: Lyndon-prefix groups in descending order, then each group's order."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_order(symbols: Sequence[int]) -> list[int]:
    """The suffix array of a sequence of integers; a suffix sorts before those that it begins.

    First all suffixes are grouped by their first symbol, and the groups are taken from the largest
    to the smallest. Each suffix of the group at hand points at the nearest position to its left
    whose group is smaller. A position at which l of them point gets the group's word l times more
    in its own, so that it moves to a new group just after its old one; more pointers stand higher.
    Then the groups hold the suffixes by their Lyndon prefixes. Second, from the smallest suffix up,
    each suffix found places the one before it, and those that this one's pointers lead to, at the
    next free place of their groups. No symbol is renamed and nothing recurses.
    """
    n = len(symbols)
    names = sorted(set(symbols))
    rank = {s: k + 1 for k, s in enumerate(names)}
    # Position n is the end, alone in the smallest group.
    group = [rank[s] for s in symbols] + [0]
    members: list[list[int]] = [[n]] + [[] for _ in names]
    for i in range(n):
        members[group[i]].append(i)
    below = list(range(-1, len(names)))
    above = [*range(1, len(names) + 1), -1]
    pointer = [-1] * (n + 1)
    done = bytearray(n + 1)
    g = len(names)
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        own.sort()
        members[g] = own
        for i in own:
            done[i] = 1
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = pointer[j]
            pointer[i] = j
        count: dict[int, int] = {}
        for i in own:
            if (j := pointer[i]) >= 0:
                count[j] = count.get(j, 0) + 1
        moved: dict[tuple[int, int], int] = {}
        for j, times in sorted(count.items(), key=lambda x: -x[1]):
            old = group[j]
            new = moved.get((old, times))
            if new is None:
                new = moved[old, times] = len(members)
                members.append([])
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
            members[new].append(j)
            group[j] = new
        g = below[g]
    order = [-1] * (n + 1)
    free = [0] * len(members)
    at, g = 0, 0
    while g >= 0:
        free[g] = at
        at += len(members[g])
        g = above[g]
    placed = bytearray(n + 1)
    order[0], placed[n] = n, 1
    free[0] += 1
    for i in range(n + 1):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            placed[s] = 1
            order[free[group[s]]] = s
            free[group[s]] += 1
            s = pointer[s]
    return order[1:]


def common_prefixes(symbols: Sequence[int], order: Sequence[int]) -> list[int]:
    """Symbols that each suffix of the order shares with the one before it (0 for the first)."""
    n = len(symbols)
    place = [0] * n
    for k, i in enumerate(order):
        place[i] = k
    out, h = [0] * n, 0
    for i in range(n):
        if place[i]:
            j = order[place[i] - 1]
            while i + h < n and j + h < n and symbols[i + h] == symbols[j + h]:
                h += 1
            out[place[i]] = h
            h -= h > 0
        else:
            h = 0
    return out
