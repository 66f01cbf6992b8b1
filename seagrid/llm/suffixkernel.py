"""Array kernels of the suffix-array dedup: anchors of windows, and suffix arrays."""

from __future__ import annotations

import numpy as np

_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
GRAM = 32
#: Low bits of a packed hash that hold its place; a buffer must be shorter.
PLACE_BITS = 24


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from every place of ``data``."""
    h = data.astype(np.uint64) + np.uint64(1)
    span = 1
    with np.errstate(over="ignore"):
        for odd in _ODD:  # from span to 2 * span bytes
            h = h[:-span] * odd + (h[span:] ^ (h[span:] >> np.uint64(29)))
            h ^= h >> np.uint64(32)
            span *= 2
        h *= _ODD[0]
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return out if span == width else np.minimum(out[: len(out) - (width - span)], out[width - span :])


def anchors(data: np.ndarray, begin: np.ndarray, length: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of the texts in ``data`` by the anchor that each one picks.

    A window of ``window`` bytes picks the place of its smallest gram hash, the
    leftmost of equal ones, so equal windows pick alike. Returns, for each run of
    windows with one anchor, its hash, its first and its last window.
    """
    if len(data) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(data)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    packed = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    place = (sliding_min(packed, window - GRAM + 1) & mask).astype(np.int32)
    keep = np.zeros(len(place), bool)
    for b, n in zip(begin[length >= window].tolist(), length[length >= window].tolist()):
        keep[b : b + n - window + 1] = True
    start = np.flatnonzero(keep)
    chosen = place[start]
    if not len(start):
        return np.zeros(0, np.uint64), start, start
    cut = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
    first = start[np.concatenate([[0], cut])]
    last = start[np.concatenate([cut - 1, [len(start) - 1]])]
    return h[place[first]], first, last


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its follower; the end mark counts as such."""
    n = len(t)
    smaller = np.empty(n, bool)
    smaller[-1] = True
    known = np.append(t[:-1] != t[1:], True)
    smaller[:-1] = t[:-1] < t[1:]
    # A place equal to its follower takes the type of the next known place.
    nearest = np.minimum.accumulate(np.where(known, np.arange(n), n)[::-1])[::-1]
    return smaller[nearest]


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in (any consistent) order.

    A bucket holds the suffixes of one first symbol. Buckets are visited upwards for
    the larger-type suffixes and downwards for the smaller-type ones; what a stretch
    of a bucket induces is placed at once, in its order.
    """
    n, symbols = len(t), len(first) - 1
    sa = np.zeros(n, np.int32)
    heads = t[lms]
    order = np.argsort(heads, kind="stable")
    counts = np.bincount(heads, minlength=symbols)
    inside = np.arange(len(lms)) - (np.cumsum(counts) - counts)[heads[order]]
    marks = first[1:] - counts
    sa[marks[heads[order]] + inside] = lms[order]

    def place(batch: np.ndarray, want_smaller: bool, edge: np.ndarray) -> None:
        before = batch[batch > 0] - 1
        before = before[smaller[before] == want_smaller]
        if not len(before):
            return
        symbol = t[before]
        order = np.argsort(symbol, kind="stable")
        got = np.bincount(symbol, minlength=symbols)
        symbol = symbol[order]
        rank = np.arange(len(symbol)) - (np.cumsum(got) - got)[symbol]
        if want_smaller:
            sa[edge[symbol] - 1 - rank] = before[order]
            edge -= got
        else:
            sa[edge[symbol] + rank] = before[order]
            edge += got

    head = first[:-1].copy()
    for c in range(symbols):
        at = first[c]
        while at < head[c]:
            batch, at = sa[at : head[c]], head[c]
            place(batch, False, head)
        if counts[c]:
            place(sa[marks[c] : first[c + 1]], False, head)
    tail = first[1:].copy()
    for c in range(symbols - 1, -1, -1):
        at = first[c + 1]
        while tail[c] < at:
            batch, at = sa[tail[c] : at][::-1], tail[c]
            place(batch, True, tail)
        if head[c] > first[c]:
            place(sa[first[c] : head[c]][::-1], True, tail)
    sa[0] = n - 1
    return sa


def _doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of ``names``, as far as their first ``depth`` symbols tell."""
    rank = names.astype(np.int64) + 1
    span = 1
    while True:
        follow = np.zeros(len(rank), np.int64)
        follow[:-span] = rank[span:]
        key = rank * (rank.max() + 1) + follow
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.append(True, sorted_key[1:] != sorted_key[:-1])
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(fresh)
        span *= 2
        if span >= min(depth, len(rank)) or fresh.all():
            return order


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``t`` in order by induced sorting.

    ``t`` holds small dense symbols and ends with its only 0. Suffixes that agree in
    ``depth`` symbols may stand in either order. The reduced string of names has no
    small alphabet, so that it is finished by doubling instead of buckets.
    """
    smaller = _types(t)
    lms = np.flatnonzero(smaller & np.append(False, ~smaller[:-1])).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(np.bincount(t))])
    if len(lms) > 1:
        is_lms = np.zeros(len(t), bool)
        is_lms[lms] = True
        sa = _induce(t, smaller, lms, first)
        ordered = sa[is_lms[sa]]
        size = np.zeros(len(t), np.int32)
        size[lms[:-1]] = np.diff(lms) + 1
        size[lms[-1]] = 1
        a, b = ordered[:-1], ordered[1:]
        same = size[a] == size[b]
        live = np.flatnonzero(same)
        step = 0
        while len(live):
            equal = t[a[live] + step] == t[b[live] + step]
            same[live[~equal]] = False
            step += 1
            live = live[equal]
            live = live[size[a[live]] > step]
        name = np.zeros(len(t), np.int32)
        name[ordered] = np.concatenate([[0], np.cumsum(~same)])
        if not same.any():
            lms = ordered
        else:  # a symbol of the reduced string stands for at least one of t
            lms = lms[_doubling(name[lms], depth)]
    return _induce(t, smaller, lms, first)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For every place, the common prefix with its predecessor in ``sa``, up to ``most`` symbols.

    Prefixes are compared eight symbols at once; what stays short of ``most`` by
    eight or more is only known to within these eight.
    """
    n = len(t)
    phi = np.empty(n, np.int32)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = n - 1
    plcp = np.zeros(n, np.int32)
    live = np.flatnonzero(np.arange(n) != sa[0])
    for step in (8, 1):
        wide = t
        if step == 8:
            if t.max() > 255:
                continue
            padded = np.concatenate([t.astype(np.uint64), np.zeros(8, np.uint64)])
            wide = padded[:n]
            for i in range(1, 8):
                wide = wide | (padded[i : n + i] << np.uint64(8 * i))
        while len(live):
            at = plcp[live]
            equal = wide[live + at] == wide[phi[live] + at]
            live = live[equal]
            plcp[live] += step
            live = live[(plcp[live] <= most - step) & (np.maximum(live, phi[live]) + plcp[live] + step < n)]
        live = np.flatnonzero((plcp > most - 8) & (plcp < most)) if step == 8 else live
    return plcp
