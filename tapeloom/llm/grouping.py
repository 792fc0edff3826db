"""Suffix sorting by Lyndon-prefix groups: linear, without recursion and without renaming.

First phase: suffixes are grouped by their longest Lyndon prefix. Groups are taken in descending order; each member points
to its previous smaller position, the last one before it that has not been taken. A position that several members of one
group point to has that group's word appended as often, so it moves to a group just above what stays of its old one.
Second phase: in ascending order, every placed suffix puts the position before it, and the previous-smaller chain from
there, at the front of what is left of their groups.
"""

from __future__ import annotations


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """(groups in descending order, their sizes, group of each position, previous-smaller pointers)."""
    n = len(text)
    symbols = sorted(set(text))
    number = {c: g for g, c in enumerate(symbols)}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(symbols) - 1))
    above = list(range(1, len(symbols) + 1))
    previous = [-1] * n
    before = list(range(-1, n - 1))  # leads to the last position before that isn't taken; shortened on the way
    taken = bytearray(n + 1)  # the last byte stands for position -1
    order, sizes = [], []
    g = len(symbols) - 1
    while g >= 0:
        these = [i for i in members[g] if group[i] == g]
        if these:
            order.append(g)
            sizes.append(len(these))
            for i in these:
                taken[i] = 1
            times: dict[int, int] = {}
            for i in these:
                p = before[i]
                if taken[p]:
                    while taken[p]:
                        p = before[p]
                    q = i
                    while q != p and before[q] != p:
                        before[q], q = p, before[q]
                previous[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            moved: dict[tuple[int, int], list[int]] = {}
            for p, k in times.items():
                key = (k, group[p])
                if key in moved:
                    moved[key].append(p)
                else:
                    moved[key] = [p]
            tops: dict[int, int] = {}
            for k, h in sorted(moved) if len(moved) > 1 else moved:
                to = moved[k, h]
                new, under = len(members), tops.get(h, h)
                members.append(to)
                for p in to:
                    group[p] = new
                over = above[under]
                below.append(under)
                above.append(over)
                above[under] = new
                if over < new:
                    below[over] = new
                tops[h] = new
        g = below[g]
    return order, sizes, group, previous


def suffix_array(text: list[int]) -> list[int]:
    """Positions of ``text`` (integers of any size) in the order of their suffixes; an empty text gives an empty list."""
    n = len(text)
    if not n:
        return []
    order, sizes, group, previous = lyndon_groups(text)
    front, at = {}, n
    for g, size in zip(order, sizes):
        at -= size
        front[g] = at
    out, placed = [0] * n, bytearray(n)
    j = n - 1
    while j >= 0:
        out[front[group[j]]] = j
        front[group[j]] += 1
        placed[j] = 1
        j = previous[j]
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            f = group[j]
            out[front[f]] = j
            front[f] += 1
            placed[j] = 1
            j = previous[j]
    return out
