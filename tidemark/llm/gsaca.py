"""Suffix arrays by linear grouping.

Phase one sorts the suffixes by their longest Lyndon prefixes. Groups are processed in descending order. A suffix in the group at
hand hangs below its previous smaller suffix: the nearest position to the left that isn't processed yet. Positions with the same
number of such children in this group leave their groups together and form a new group just above, since their common prefix
grew by that many copies of the present group's. Phase two reads the suffix array from left to right and puts the suffixes that
end where the suffix at hand begins into the next free places of their groups, along the previous-smaller pointers.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: bytes) -> list[int]:
    n = len(text)
    if n < 2:
        return list(range(n))
    # groups: members, and the next group above and below
    used = sorted(set(text))
    number = {c: k for k, c in enumerate(used)}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in used]
    for i, g in enumerate(group):
        members[g].append(i)
    below = [k - 1 for k in range(len(used))]
    above = [*range(1, len(used)), -1]
    left = list(range(n))  # left[i] == i: not processed; else a position towards the nearest one that isn't
    prev = [-1] * n
    now = len(used) - 1
    done: list[int] = []
    while now >= 0:
        mine = members[now] = [i for i in members[now] if group[i] == now]
        for i in mine:
            left[i] = i - 1
        count: dict[int, int] = {}
        for i in mine:
            p = i - 1
            while p >= 0 and left[p] != p:
                p = left[p]
            j = i
            while j > p and j >= 0:  # shorten the paths just walked
                left[j], j = p, left[j]
            prev[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if count:
            fresh: dict[tuple[int, int], list[int]] = {}
            for p, k in count.items():
                key = (group[p], k)
                if key in fresh:
                    fresh[key].append(p)
                else:
                    fresh[key] = [p]
            for g, k in sorted(fresh, reverse=True) if len(fresh) > 1 else fresh:
                # straight above g, below the groups of more children made before
                new = len(members)
                members.append(fresh[g, k])
                up = above[g]
                above[g] = new
                below.append(g)
                above.append(up)
                if up >= 0:
                    below[up] = new
                for p in fresh[g, k]:
                    group[p] = new
        done.append(now)
        now = below[now]
    start = [0] * len(members)
    at = 0
    for g in reversed(done):
        start[g] = at
        at += len(members[g])
    sa = [-1] * n
    placed = bytearray(n)

    def induce(i: int) -> None:
        j = i - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            sa[start[g]] = j
            start[g] += 1
            placed[j] = 1
            j = prev[j]

    induce(n)
    for k in range(n):
        induce(sa[k])
    return sa


#: Texts up to this length are sorted side by side, each step being taken for all of them at once.
SHORT = 512


def suffix_arrays(texts: list[bytes]) -> np.ndarray:
    """The suffix arrays of texts one behind the other, as positions in the joined text.

    The same construction; the texts' present groups are processed together, so a step costs little however short the texts are."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.int64)
    short = np.flatnonzero((sizes > 0) & (sizes <= SHORT))
    for k in np.flatnonzero(sizes > SHORT).tolist():
        out[first[k] : first[k] + sizes[k]] = np.array(suffix_array(texts[k]), np.int64) + first[k]
    if len(short):
        sa, begin = _side_by_side([texts[k] for k in short.tolist()])
        at = np.repeat(first[short] - begin, sizes[short])  # from places among the short texts to places among all
        out[np.arange(len(sa)) + at] = sa + at
    return out


def _side_by_side(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(texts), np.uint8)
    step, prev = _groups(text, sizes)
    # places of the groups: by text, then from the group processed last to the one processed first
    of = np.repeat(np.arange(len(sizes)), sizes)
    key = of * (int(step.max()) + 1) + (int(step.max()) - step)
    _, group, members = np.unique(key, return_inverse=True, return_counts=True)
    free = np.cumsum(members) - members
    sa, placed = np.full(len(text) + 1, -1, np.int64), np.zeros(len(text) + 1, bool)
    placed[-1] = True  # the place -1 stands for: no further suffix
    low, read, stop, j = begin, begin.copy(), begin + sizes, begin + sizes - 1
    while len(j):
        walking = np.flatnonzero(~placed[j])
        w = j[walking]
        g = group[w]
        sa[free[g]] = w
        free[g] += 1
        placed[w] = True
        j[walking] = prev[w]
        ended = np.flatnonzero(placed[j])
        more = ended[read[ended] < stop[ended]]
        at = sa[read[more]]
        j[more] = np.where(at > low[more], at - 1, -1)
        read[more] += 1
        if len(more) < len(ended):
            on = np.ones(len(j), bool)
            on[ended] = read[ended] < stop[ended]
            on[more] = True
            low, read, stop, j = low[on], read[on], stop[on], j[on]
    return sa[:-1], begin


def _groups(text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step in which each position's group is processed (the greatest group first), and its previous smaller suffix (or -1).

    Labels order the groups of a text. Positions that gain children are labelled anew, above their group and by their number."""
    open_, label = np.arange(len(text)), text.astype(np.int64)
    step, prev = np.zeros(len(text), np.int64), np.full(len(text), -1, np.int64)
    left, most, k = sizes.copy(), 256, 0
    while len(open_):
        first = np.cumsum(left) - left
        mine = label == np.repeat(np.maximum.reduceat(label, first), left)
        at = np.flatnonzero(mine)
        parent = np.maximum.accumulate(np.where(mine, -1, np.arange(len(open_))))[at]  # the nearest one that isn't processed
        gone = np.add.reduceat(mine, first, dtype=np.int64)
        has = parent >= np.repeat(first, gone)
        step[open_[at]] = k
        prev[open_[at[has]]] = open_[parent[has]]
        children = np.bincount(parent[has], minlength=len(open_))
        keep = ~mine
        open_, label, children = open_[keep], label[keep], children[keep]
        left = left - gone
        left = left[left > 0]
        grow = int(children.max()) + 1 if len(children) else 1
        if grow > 1:
            most *= grow
            if most >= 1 << 62:
                label = np.unique(label, return_inverse=True)[1]
                most = (int(label.max()) + 1) * grow
            label = label * grow + children
        k += 1
    return step, prev


def bucket_classes(buckets: list[list[bytes]], width: int) -> list[np.ndarray]:
    """For each piece of each bucket, in order, the class of each of its windows of ``width`` bytes. Equal windows of a bucket have
    equal classes."""
    texts = [b"\xff".join(pieces) for pieces in buckets]
    sa = suffix_arrays(texts)
    sizes = np.array([len(p) for pieces in buckets for p in pieces], np.int64)
    last = np.cumsum([len(pieces) for pieces in buckets]) - 1
    gap = np.ones(len(sizes), np.int64)
    gap[last] = 0
    starts = np.cumsum(sizes + gap) - sizes - gap
    counts = np.maximum(0, sizes - width + 1)
    edge = np.zeros(len(sa) + 1, np.int64)
    np.add.at(edge, starts, (counts > 0).astype(np.int64))
    np.add.at(edge, starts + counts, -(counts > 0).astype(np.int64))
    order = sa[np.cumsum(edge)[sa] > 0]
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(texts), np.uint8), width)[order]
    of = np.full(len(sa), -1, np.int64)
    of[order] = np.cumsum(np.r_[False, (rows[1:] != rows[:-1]).any(1)][: len(order)])  # neighbours whose common prefix is shorter
    return [of[s : s + n] for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
