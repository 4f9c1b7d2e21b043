"""Deep-shallow sorting of suffixes, vectorised over all groups at once.

The shallow part is a multikey quicksort whose characters are eight-byte words:
every round splits each group of suffixes by its next word. Groups that still
hold together after SHALLOW bytes have a long common prefix; they go to blind
tries. A trie keeps, for each suffix, only where it leaves the path of the
group's pivot and with which byte; the suffixes that leave at one place with
one byte form a child, which gets a pivot of its own in the next round. What
never leaves the path is equal to the pivot and is a leaf.
"""

from __future__ import annotations

import numpy as np

#: Bytes that the multikey quicksort looks at.
SHALLOW = 32


def big_endian(data: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each position as a number that sorts like them; zeros follow the end."""
    padded = np.zeros(len(data) + depth + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + depth + 8,), ">u8", padded.data, 0, (1,))


def _masked(eight: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Words whose bytes past the depth are zero."""
    word = eight[at].astype(np.uint64)
    short = left < 8
    if short.any():
        drop = (np.uint64(8) - np.clip(left[short], 0, 8).astype(np.uint64)) * np.uint64(8)
        gone = drop == 64
        kept = np.where(gone, np.uint64(0), (word[short] >> np.where(gone, np.uint64(0), drop)) << np.where(gone, np.uint64(0), drop))
        word[short] = kept
    return word


def _starts(change: np.ndarray) -> np.ndarray:
    """The first slot of each slot's group, from flags at the groups' first slots."""
    return np.maximum.accumulate(np.where(change, np.arange(len(change)), 0))


def sort(data: np.ndarray, suffixes: np.ndarray, depth: np.ndarray | int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first depth bytes, within groups if given (one depth a group), and for each slot of that order the first slot that holds an equal suffix."""
    count = len(suffixes)
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    depths = np.broadcast_to(np.asarray(depth, np.int64), (count,))
    most = int(depths.max())
    eight = big_endian(data, most)
    if group is None:
        order, head = np.arange(count), np.zeros(count, np.int64)
    else:
        order = np.argsort(group, kind="stable")
        own = group[order]
        change = np.ones(count, bool)
        change[1:] = own[1:] != own[:-1]
        head = _starts(change)
    size = np.bincount(head, minlength=count)
    # shallow: multikey quicksort by words
    for at in range(0, min(SHALLOW, most), 8):
        slots = np.flatnonzero((size[head] > 1) & (depths[order] > at))
        if not len(slots):
            break
        who = order[slots]
        word = _masked(eight, suffixes[who] + at, depths[who] - at)
        own = head[slots]
        inner = np.lexsort((word, own))
        order[slots] = who[inner]
        word = word[inner]
        change = np.ones(len(slots), bool)
        change[1:] = (own[1:] != own[:-1]) | (word[1:] != word[:-1])
        head[slots] = slots[_starts(change)]
        size = np.bincount(head, minlength=count)
    # deep: blind tries, a round for each level of pivots
    open_ = (size[head] > 1) & (depths[order] > SHALLOW)
    while True:
        slots = np.flatnonzero(open_)
        if not len(slots):
            return order, head
        own, who = head[slots], order[slots]
        pivot = order[own]
        leaves_at, byte, above = _leave(eight, suffixes, depths, who, pivot)
        equal = leaves_at < 0
        side = np.where(equal, 1, np.where(above, 2, 0))
        rank = np.where(equal, 0, np.where(above, most - leaves_at, leaves_at))
        inner = np.lexsort((byte, rank, side, own))
        order[slots] = who[inner]
        change = np.arange(len(slots)) == 0
        for part in (own, side[inner], rank[inner], byte[inner]):
            change[1:] |= part[1:] != part[:-1]
        head[slots] = slots[_starts(change)]
        size = np.bincount(head, minlength=count)
        open_[slots] = ~equal[inner] & (size[head[slots]] > 1)


def _leave(eight, suffixes, depths, who, pivot):
    """Where each suffix leaves its pivot's path (-1: nowhere), with which byte, and whether above it."""
    leaves_at = np.full(len(who), -1, np.int64)
    byte = np.zeros(len(who), np.int64)
    above = np.zeros(len(who), bool)
    left = np.flatnonzero(who != pivot)
    at = SHALLOW
    while len(left):
        left = left[depths[who[left]] > at]
        if not len(left):
            break
        rest = depths[who[left]] - at
        mine, path = _masked(eight, suffixes[who[left]] + at, rest), _masked(eight, suffixes[pivot[left]] + at, rest)
        off = mine != path
        if off.any():
            gone, a, b = left[off], mine[off], path[off]
            both = a ^ b
            shared = np.zeros(len(gone), np.int64)
            for n in (4, 2, 1):  # leading zero bytes by halving
                clear = (both >> np.uint64(64 - 8 * n)) == 0
                shared += np.where(clear, n, 0)
                both = np.where(clear, both << np.uint64(8 * n), both)
            leaves_at[gone] = at + shared
            byte[gone] = ((a >> ((7 - shared) * 8).astype(np.uint64)) & np.uint64(255)).astype(np.int64)
            above[gone] = a > b
            left = left[~off]
        at += 8
    return leaves_at, byte, above
