"""Suffix sorting by grouping, in time linear in the text.

Suffixes start in groups by first symbol. Groups are processed from the highest down: each suffix of a group finds
its previous smaller suffix (the nearest one to its left in a lower group; finished suffixes hand on their own
pointers), and the suffixes pointed to move up into new groups right above their old ones, those pointed to more
often higher. At the end the groups hold suffixes with equal longest Lyndon prefixes, in order. A second pass emits
each group's order: from the smallest suffix on, every suffix places the one before it, and that one's previous
smaller suffixes, at the front of their groups. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

from itertools import pairwise


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` (whole numbers from 0), in order."""
    n = len(text) + 2  # place 0 stands left of the text and is never done; the last one is the end, below all symbols
    by_symbol: dict[int, list[int]] = {}
    for i, x in enumerate(text, 1):
        if x in by_symbol:
            by_symbol[x].append(i)
        else:
            by_symbol[x] = [i]
    members = [[n - 1], *(by_symbol[x] for x in sorted(by_symbol))]
    count = len(members)
    lower, upper = list(range(-1, count - 1)), [*range(1, count), -1]
    size = [len(m) for m in members]
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    before, done = [0] * n, [False] * n

    def rise(moved: list[int], g: int) -> None:
        """``moved`` leave g for a new group right above it; there is always one above, the one being processed."""
        size[g] -= len(moved)
        new, above = len(members), upper[g]
        members.append(moved)
        size.append(len(moved))
        lower.append(g)
        upper.append(above)
        upper[g] = lower[above] = new
        for j in moved:
            group[j] = new

    now = count - 1
    while now != -1:
        own = members[now]
        if size[now] != len(own):
            own = [i for i in own if group[i] == now]
        if len(own) == 1:
            i = own[0]
            done[i] = True
            j = i - 1
            while done[j]:
                j = before[j]
            before[i] = j
            if j and size[g := group[j]] > 1:
                rise([j], g)
            now = lower[now]
            continue
        for i in own:
            done[i] = True
        hits: dict[int, int] = {}
        for i in own:
            j = i - 1
            while done[j]:
                j = before[j]
            before[i] = j
            if j:
                hits[j] = hits.get(j, 0) + 1
        # those pointed to more often leave first and stay higher
        sets: dict[tuple[int, int], list[int]] = {}
        for j, k in hits.items():
            if size[g := group[j]] > 1:
                sets.setdefault((-k, g), []).append(j)
        for _, g in sorted(sets) if len(sets) > 1 else sets:
            moved = next(iter(sets.values())) if len(sets) == 1 else sets[_, g]
            if len(moved) < size[g]:
                moved.sort()
                rise(moved, g)
        now = lower[now]

    front, total, g = [0] * len(members), 0, 0
    while g != -1:
        front[g] = total
        total += size[g]
        g = upper[g]
    order, placed = [0] * (n - 1), [False] * n
    order[0] = n - 1
    placed[n - 1] = placed[0] = True
    front[group[n - 1]] = 1
    for i in range(n - 1):
        j = order[i] - 1
        while not placed[j]:
            g = group[j]
            order[front[g]] = j
            front[g] += 1
            placed[j] = True
            j = before[j]
    return [i - 1 for i in order[1:]]


def shared_prefixes(text: list[int], order: list[int]) -> list[int]:
    """Longest common prefix of each suffix with the one before it in order (0 for the first)."""
    rank = [0] * len(text)
    for r, i in enumerate(order):
        rank[i] = r
    previous = {b: a for a, b in pairwise(order)}
    out, h = [0] * len(text), 0
    for i in range(len(text)):
        j = previous.get(i)
        if j is None:
            h = 0
            continue
        while i + h < len(text) and j + h < len(text) and text[i + h] == text[j + h]:
            h += 1
        out[rank[i]] = h
        h = max(0, h - 1)
    return out
