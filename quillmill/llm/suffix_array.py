"""Suffix arrays by linear grouping (Lyndon groups).

Phase one sorts suffixes into groups by their longest Lyndon prefixes. They start in
groups of equal first symbols; groups are taken in descending order. The group at hand
holds the suffixes whose Lyndon prefix is a word w. For each of them, the nearest earlier
suffix of a smaller group (a previous-smaller pointer, shortened as it is followed) has
its own word u ended just there; if k copies of w follow, the word becomes u w^k, and the
suffix moves to a new group right after what stays in the group of u, the larger k the
higher. Phase two emits the order: the suffixes whose Lyndon prefix ends where the
suffix just emitted starts take the next places of their groups. Nothing is renamed or
sorted again.

The empty sequence has an empty array; runs, ties and repeats need no special case."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of `text` (any integers) in lexicographic order."""
    n = len(text)
    if not n:
        return []
    # groups, as a linked list in ascending order; group 0 holds the end, a suffix of its own
    symbols = sorted(set(text))
    number = {s: k + 1 for k, s in enumerate(symbols)}
    group = [number[s] for s in text]
    members: list[list[int]] = [[] for _ in range(len(symbols) + 1)]
    for i, g in enumerate(group):
        members[g].append(i)
    gone = [0] * len(members)
    word = [1] * len(members)
    lower = [k - 1 for k in range(len(members))]
    upper = [k + 1 for k in range(len(members))]
    done = [False] * n  # in a group that was taken
    before = list(range(-1, n - 1))
    g = len(members) - 1
    upper[g] = -1
    while g > 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        length = word[g]
        for i in own:
            done[i] = True
        times: dict[int, int] = {}
        for i in own:  # ascending places, as groups keep them
            p = before[i]
            if p >= 0 and done[p]:
                trail = [i]
                while p >= 0 and done[p]:
                    trail.append(p)
                    p = before[p]
                for x in trail:
                    before[x] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            moved.setdefault((group[p], k), []).append(p)
        for (u, k), who in sorted(moved.items(), key=lambda x: -x[0][1]):
            if len(who) + gone[u] == len(members[u]):
                word[u] += k * length  # all that is left of the group moves: it stays in place
                continue
            new = len(members)
            who.sort()
            members.append(who)
            gone.append(0)
            word.append(word[u] + k * length)
            up = upper[u]
            lower.append(u)
            upper.append(up)
            upper[u] = new
            if up >= 0:
                lower[up] = new
            gone[u] += len(who)
            for p in who:
                group[p] = new
        g = lower[g]
    # places: the groups in ascending order, the end first
    start, place, g = [0] * len(members), 0, upper[0]
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    while g > 0:
        start[g] = place
        place += len(members[g])
        for i in members[g]:
            ends[i + word[g]].append(i)
        g = upper[g]
    out = [0] * n
    for i in ends[n]:
        out[start[group[i]]] = i
        start[group[i]] += 1
    for at in range(n):
        for i in ends[out[at]]:
            h = group[i]
            out[start[h]] = i
            start[h] += 1
    return out


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """For each place in `order` but the first, the length of what its suffix shares with
    the one before; 0 for the first."""
    n = len(text)
    rank, out, h = [0] * n, [0] * n, 0
    for k, i in enumerate(order):
        rank[i] = k
    for i in range(n):
        if k := rank[i]:
            j = order[k - 1]
            most = n - max(i, j)
            while h < most and text[i + h] == text[j + h]:
                h += 1
            out[k] = h
            h = h - 1 if h else 0
        else:
            h = 0
    return out
