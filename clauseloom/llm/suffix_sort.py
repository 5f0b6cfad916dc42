"""Suffix sorting by grouping on Lyndon prefixes, in linear time and without recursion.

Phase one groups the suffixes by their Lyndon prefix.  It starts with groups by first
symbol and takes the groups in descending order; each suffix of a group points to the
previous suffix of a smaller group, whose Lyndon prefix the group's own extends, so the
suffixes pointed at are split off by how often they are.  Phase two runs through the
suffixes in ascending order and emits, along the same pointers, the next suffix of each
group.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` in lexicographic order; a shorter prefix comes first."""
    n = len(symbols) + 1
    if n == 1:
        return []
    text = [*(s + 1 for s in symbols), 0]  # a last symbol below all others
    order, group, size = _by_symbol(text)
    place = [0] * n
    for at, suffix in enumerate(order):
        place[suffix] = at
    previous = [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        if end - start > 1:
            _process_many(sorted(order[start:end]), start, order, place, group, size, previous)
        else:
            suffix = order[start]
            at = suffix - 1
            while at >= 0 and group[at] >= start:
                at = previous[at]
            previous[suffix] = at
            if at >= 0:
                old = group[at]
                last = size[old] - 1
                if last:  # the pointed suffix moves to the end of its group and leaves it
                    size[old] = last
                    last += old
                    size[last] = 1
                    group[at] = last
                    here, other = place[at], order[last]
                    order[here], place[other] = other, here
                    order[last], place[at] = at, last
        end = start
    return _emit(n, group, previous)[1:]


def _by_symbol(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffixes ordered by first symbol; for each, where its group starts; sizes by start."""
    members: dict[int, list[int]] = {}
    for at, symbol in enumerate(text):
        members.setdefault(symbol, []).append(at)
    order: list[int] = []
    group, size = [0] * len(text), [0] * len(text)
    for symbol in sorted(members):
        own, start = members[symbol], len(order)
        for suffix in own:
            group[suffix] = start
        size[start] = len(own)
        order += own
    return order, group, size


def _process_many(suffixes, start, order, place, group, size, previous) -> None:
    """Set the pointers of one group and split off the suffixes they point at, the most pointed at first."""
    pointed: list[int] = []
    for suffix in suffixes:
        at = suffix - 1
        while at >= 0 and group[at] >= start:
            at = previous[at]
        previous[suffix] = at
        if at >= 0:
            pointed.append(at)
    if len(set(pointed)) == len(pointed):
        _split_all(pointed, order, place, group, size)
        return
    count: dict[int, int] = {}
    for at in pointed:
        count[at] = count.get(at, 0) + 1
    by_count: dict[int, list[int]] = {}
    for at, times in count.items():
        by_count.setdefault(times, []).append(at)
    for times in sorted(by_count, reverse=True):
        _split_all(by_count[times], order, place, group, size)


def _split_all(pointed, order, place, group, size) -> None:
    """Split equally pointed suffixes off their groups; a group that is pointed at as a whole stays."""
    members: dict[int, list[int]] = {}
    for at in pointed:
        old = group[at]
        if size[old] > 1:
            if old in members:
                members[old].append(at)
            else:
                members[old] = [at]
    for old, own in members.items():
        if size[old] > len(own):
            _split(own, order, place, group, size)


def _split(members, order, place, group, size) -> None:
    """Move ``members`` to the end of their group and make them a group of their own."""
    old = group[members[0]]
    size[old] -= len(members)
    new = old + size[old]
    size[new] = len(members)
    to = new + len(members) - 1
    for suffix in members:
        at, other = place[suffix], order[to]
        order[at], place[other] = other, at
        order[to], place[suffix] = suffix, to
        group[suffix] = new
        to -= 1


def _emit(n: int, group: list[int], previous: list[int]) -> list[int]:
    out = [-1] * n
    out[0] = n - 1
    free = group  # next free place by group start; a group's start itself is never read again
    following = list(range(n))
    done = bytearray(n)
    done[n - 1] = 1
    for i in range(n):
        at = out[i] - 1
        while at >= 0 and not done[at]:
            start = free[at]
            out[following[start]] = at
            following[start] += 1
            done[at] = 1
            at = previous[at]
    return out
