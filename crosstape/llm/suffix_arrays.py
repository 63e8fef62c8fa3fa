"""Suffix order, common prefixes and merging of sorted runs, in numpy, for one shard."""

from __future__ import annotations

import numpy as np

from .columns import U64, mix


def words_at(data: np.ndarray, pad: int = 0) -> np.ndarray:
    """The 8 bytes from every position as one little-endian word; pad zero bytes follow the data."""
    whole = np.concatenate((data, np.zeros(pad + 7, np.uint8)))
    return np.ndarray((len(whole) - 7,), "<u8", whole, strides=(1,))


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions by their suffixes' first depth bytes (or more), by Larsson and Sadakane's
    refinement: suffixes of one group are sorted by the group of the suffix h further on, h
    doubles, and groups of one suffix are left alone. Bytes after the end count as zero; ties stay
    in text order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    first = words_at(data)[:n].byteswap()
    order = np.argsort(first, kind="stable").astype(np.int32)  # a shard holds under 2**31 bytes
    first = first[order]
    new = np.concatenate(([True], first[1:] != first[:-1]))
    del first
    # A group's number is the place of its first suffix in the order.
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    h = 8
    while h < depth:
        alone = new & np.concatenate((new[1:], [True]))
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        own = order[at]
        ahead = np.full(len(own), -1, np.int32)
        inside = own + h < n
        ahead[inside] = rank[own[inside] + h]
        by = np.argsort(rank[own].astype(np.int64) << 32 | (ahead + 1), kind="stable")
        order[at] = own = own[by]
        ahead = ahead[by]
        group = rank[own]
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])))
        new[at] |= fresh
        rank[own] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, lanes: int = 64) -> np.ndarray:
    """Length of the prefix that each suffix shares with the one before it in the order, or most
    if it is longer. Kasai's rule (one less than that of the suffix one place earlier in the text,
    then extended), with the text cut into stretches of so many positions that run side by side.
    The order may be one by finite depth over most: the rule holds where the earlier prefix is
    shorter than most, and the count starts anew where it is not."""
    n = len(data)
    if n < 2:
        return np.zeros(n, np.int32)
    word = words_at(data, most + 8)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    stretch = np.arange(0, n, lanes)
    held = np.zeros(len(stretch), np.int64)
    plcp = np.zeros(n, np.int32)
    for step in range(min(lanes, n)):
        i = stretch + step
        if i[-1] >= n:
            i, held = i[:-1], held[:-1]
            stretch = stretch[:-1]
        j = before[i]
        h = np.where((j >= 0) & (held < most), np.maximum(held - 1, 0), 0)
        going = np.flatnonzero(j >= 0)
        while len(going):
            at = h[going]
            x = word[i[going] + at] ^ word[j[going] + at]
            same = np.bitwise_count((x & (U64(0) - x)) - U64(1)) >> 3  # 8 if x is zero
            h[going] = np.minimum(at + same, most)
            going = going[(same == 8) & (at + 8 < most)]
        # A suffix that ends first shares no more than its length.
        h = np.minimum(h, n - np.maximum(i, j))
        plcp[i] = h
        held = h
    return plcp[order]


def window_digests(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of the length (8 at least) bytes from each position."""
    word = words_at(data)
    one = np.full(len(at), 0x243F6A8885A308D3, U64)
    two = np.full(len(at), 0x13198A2E03707344, U64)
    for k in [*range(0, length - 8, 8), length - 8]:
        w = word[at + k]
        one = mix(one ^ w) + U64(0xA4093822299F31D1)
        two = (two ^ w) * U64(0x9FB21C651E98DF25)
        two ^= two >> U64(29)
    return mix(one), mix(two)


def merge_runs(a: tuple, b: tuple) -> tuple[tuple, np.ndarray]:
    """Two runs (digest, check, place), each sorted by digest: the merged run with the least place of each
    key, and the places that lost. Each key of b is found in a by binary search."""
    if not len(a[0]) or not len(b[0]):
        return (a if len(a[0]) else b), np.zeros(0, np.int64)
    at = np.searchsorted(a[0], b[0])
    near = np.minimum(at, len(a[0]) - 1)
    same = (a[0][near] == b[0]) & (a[1][near] == b[1])
    hit = near[same]
    mine, theirs = a[2][hit], b[2][same]
    place = a[2].copy()
    place[hit] = np.minimum(mine, theirs)
    rest = ~same
    # Both runs are sorted, so a key's place in the merged run is its own plus those before it.
    to_b = at[rest] + np.arange(int(rest.sum()))
    whole = len(a[0]) + len(to_b)
    from_a = np.ones(whole, bool)
    from_a[to_b] = False
    merged = []
    for x, y in zip((a[0], a[1], place), b, strict=True):
        z = np.empty(whole, x.dtype)
        z[from_a], z[to_b] = x, y[rest]
        merged.append(z)
    return tuple(merged), np.maximum(mine, theirs)
