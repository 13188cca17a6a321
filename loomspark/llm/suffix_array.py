"""Suffix arrays by linear grouping.

Suffixes are held in groups of equal Lyndon prefix so far, the groups in lexicographic
order.  The highest group that is left is final: each of its suffixes finds the nearest
suffix to its left that is still in a lower group (its previous-smaller pointer), and
that one's prefix grows by the group's word once for each pointer it gets, so it moves
to a new group right above its own.  When every group is final, one pass over the array
from its least suffix puts each suffix at the next free place of its group.  No string
is renamed and nothing recurses; the work is linear.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in lexicographic order."""
    order, prev = lyndon_groups(text)
    return emit(order, prev, len(text))


def lyndon_groups(text: Sequence[int]) -> tuple[list[list[int]], list[int]]:
    """Groups of suffixes by Lyndon prefix, ascending, and the previous-smaller pointers."""
    n = len(text)
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        first.setdefault(c, []).append(i)
    members = [first[c] for c in sorted(first)]
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    above = list(range(1, len(members))) + [-1] if members else []
    below = list(range(-1, len(members) - 1))
    prev = [-1] * n
    final = bytearray(n)
    done: list[list[int]] = []
    top = len(members) - 1
    while top >= 0:
        here = [i for i in members[top] if group[i] == top]
        here.sort()
        for i in here:
            final[i] = 1
        hits: dict[int, int] = {}
        for i in here:
            j = i - 1
            while j >= 0 and final[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        if here:
            done.append(here)
        if hits:
            moved: dict[tuple[int, int], list[int]] = {}
            for j, times in hits.items():
                moved.setdefault((times, group[j]), []).append(j)
            # The more often the word follows, the greater the prefix; all stay below the old neighbour.
            for times, old in sorted(moved, reverse=True):
                new, up = len(members), above[old]
                members.append(moved[times, old])
                for j in members[new]:
                    group[j] = new
                above.append(up)
                below.append(old)
                above[old] = new
                if up >= 0:
                    below[up] = new
        members[top] = []
        top = below[top]
    done.reverse()
    return done, prev


def emit(groups: list[list[int]], prev: list[int], n: int) -> list[int]:
    """Suffixes in order, from groups in order.

    A suffix's place in its group is decided by the suffix behind its Lyndon prefix, so
    suffixes are placed when that one is reached.
    """
    place = [0] * n
    free = []
    at = 1  # place 0 is the empty suffix
    for g, m in enumerate(groups):
        free.append(at)
        at += len(m)
        for i in m:
            place[i] = g
    out = [-1] * (n + 1)
    out[0] = n
    put = bytearray(n)
    for k in range(n + 1):
        j = out[k] - 1
        while j >= 0 and not put[j]:
            g = place[j]
            out[free[g]] = j
            free[g] += 1
            put[j] = 1
            j = prev[j]
    return out[1:]
