"""Two-stage suffix sorting over bytes, for use inside tasks: only suffixes smaller than their successors are sorted directly.

Suffixes that are larger than their successors follow by scanning the buckets of first bytes from left to right: the predecessors
of what a bucket holds, in its order, are appended to the buckets of their own first bytes.  All steps are numpy operations on
whole buckets.  Order is kept up to a stated depth in bytes, ties beyond it are left in any order.
"""

from __future__ import annotations

import numpy as np

from .arrays import M64, mix

#: Separates texts; it does not occur in UTF-8.
BORDER = 0xFF
_POWER = 0x9E3779B97F4A7C15


def loads(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from every position as one number (zeros past the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), f"{order}u8", padded.data, strides=(1,))[:-1]


def span_hashes(data: np.ndarray, span: int) -> np.ndarray:
    """64-bit hashes of the `span` (a multiple of 8) bytes from every position where they fit."""
    if len(data) < span:
        return np.zeros(0, np.uint64)
    step, size, out, have = mix(loads(data).astype(np.uint64)), 8, None, 0
    n, power = len(data) - span + 1, _POWER
    while True:
        if span & size:
            # what is taken so far stands at the left; the next block starts behind it
            if out is None:
                out, have = step, size
            else:
                m = min(len(out), len(step) - have)
                out = out[:m] * np.uint64(power) + step[have : have + m]
                have += size
        if have == span:
            return out[:n]
        step = step[: len(step) - size] * np.uint64(power) + step[size:]
        power, size = power * power & M64, 2 * size


def smaller_than_next(s: np.ndarray) -> np.ndarray:
    """Flags of suffixes smaller than their successors; the last suffix is larger than the empty one behind it."""
    n = len(s)
    step = np.flatnonzero(s[1:] != s[:-1])
    out = np.zeros(n, bool)
    if len(step):
        rises = s[step] < s[step + 1]
        out[: step[-1] + 1] = np.repeat(rises, np.diff(np.append(-1, step)))
    return out


def sort_directly(s: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """`at` in order of the `depth` bytes that start there; one bucket of first bytes is held as fixed-length strings at a time."""
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([s, np.zeros(depth, np.uint8)]), depth)
    at = at[np.argsort(s[at], kind="stable")]
    edges, out = np.searchsorted(s[at], np.arange(257)), []
    for c in np.flatnonzero(np.diff(edges)):
        bucket = at[edges[c] : edges[c + 1]]
        out.append(bucket[np.argsort(np.ascontiguousarray(rows[bucket]).view(f"S{depth}").ravel(), kind="stable")])
    return np.concatenate(out) if out else at


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of `s` in order of their first `depth` bytes."""
    if not len(s):
        return np.zeros(0, np.int64)
    small = smaller_than_next(s)
    direct = sort_directly(s, np.flatnonzero(small), depth)
    edges = np.searchsorted(s[direct], np.arange(257))
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger[s[-1]].append(np.array([len(s) - 1]))  # follows from the empty suffix

    def before(at: np.ndarray) -> np.ndarray:
        back = at[at > 0] - 1
        return back[~small[back]]

    out = []
    for c in range(256):
        held = larger[c]
        new = np.concatenate(held) if held else np.zeros(0, np.int64)
        while len(new):  # runs of one byte
            back = before(new)
            new = back[s[back] == c]
            held.append(new)
        bucket = np.concatenate([*held, direct[edges[c] : edges[c + 1]]])
        larger[c] = []
        if not len(bucket):
            continue
        out.append(bucket)
        back = before(bucket)
        byte = s[back]
        back, byte = back[byte > c], byte[byte > c]
        if len(back):
            order = np.argsort(byte, kind="stable")
            back, byte = back[order], byte[order]
            cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
            for piece, b in zip(np.split(back, cuts), byte[np.append(0, cuts)].tolist(), strict=True):
                larger[b].append(piece)
    return np.concatenate(out)


def common_with_neighbour(s: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Flags, by entry of `order`, of suffixes that share at least `depth` bytes with the one before or behind."""
    flags = np.zeros(len(order), bool)
    if len(order) < 2:
        return flags
    words, rows = loads(s), np.arange(len(order) - 1)
    left, right = order[:-1], order[1:]
    fit = np.maximum(left, right) + depth <= len(s)
    rows, left, right = rows[fit], left[fit], right[fit]
    for d in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        same = words[left + d] == words[right + d]
        rows, left, right = rows[same], left[same], right[same]
    flags[rows] = True
    flags[rows + 1] = True
    return flags


def repeated_starts(parts: list[bytes], depth: int) -> list[np.ndarray]:
    """For every part the flags of its starts (with `depth` bytes in the part) whose `depth` bytes also start elsewhere in the parts."""
    sizes = np.array([len(p) for p in parts], np.int64)
    s = np.frombuffer(bytes([BORDER]).join(parts) + bytes([BORDER]), np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    valid = np.zeros(len(s) + 1, np.int64)
    many = sizes >= depth
    np.add.at(valid, begin[many], 1)
    np.add.at(valid, begin[many] + sizes[many] - depth + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    order = suffix_order(s, depth)
    order = order[valid[order]]
    found = np.zeros(len(s), bool)
    found[order[common_with_neighbour(s, order, depth)]] = True
    return [found[b : b + max(0, n - depth + 1)] for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
