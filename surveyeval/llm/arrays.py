"""Vectorised word, line and n-gram helpers over Arrow string columns, for use inside mapInArrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; bounds the size of all temporary arrays (one text is never split).
SLICE_BYTES = 3 << 20
M64 = (1 << 64) - 1
ODD = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [M64], dtype=np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that `column` holds about `size` bytes in each piece."""
    for batch in batches:
        _, off = utf8(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of maximal runs of non-space bytes in each text, and each text's first word (n + 1 long)."""
    inside = WORD[data]
    before = np.empty_like(inside)
    before[1:], before[:1] = inside[:-1], False
    after = np.empty_like(inside)
    after[:-1], after[-1:] = inside[1:], False
    before[off[:-1][off[:-1] < len(data)]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    load = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    left = ends - starts
    h = left.astype(np.uint64) * ODD
    at, rows = starts, None
    while True:
        block = load[at] & _LOW_BYTES[np.minimum(left, 8)]
        if rows is None:
            h = mix(h ^ block)
        else:
            h[rows] = mix((h[rows] ^ block) * ODD)
        more = left > 8
        if not more.any():
            return h
        rows = np.flatnonzero(more) if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Mixed hashes of every n consecutive entries (len(h) - n + 1 of them, across text borders too), by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have, power, size = None, 0, int(ODD), 1
    step = h
    while True:
        if n & size:
            if out is None:
                out, have = step, size
            else:
                count = len(h) - have - size + 1
                out = out[:count] * np.uint64(power) + step[have : have + count]
                have += size
        if have == n:
            return mix(out ^ np.uint64(n))
        step = step[: len(step) - size] * np.uint64(power) + step[size:]
        power, size = power * power & M64, size * 2


def runs(mask_start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs, given the flags of the entries that begin one."""
    at = np.flatnonzero(mask_start)
    return at, np.diff(np.append(at, n))


def later_copies(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Flags of entries with the same key as an entry of smaller (doc, at). Entries must come in that order."""
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    out = np.zeros(len(key), bool)
    out[order] = (doc[order] != doc[first]) | (at[order] != at[first])
    return out


def sorted_chunks(batches: Iterator[pa.RecordBatch], key: str, size: int = 200_000) -> Iterator[pa.Table]:
    """Pieces of a partition sorted by `key`, each with whole key groups; holds `size` rows and one group at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            table = pa.Table.from_batches(held)
            keys = table.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut:
                yield table.slice(0, cut)
                table = table.slice(cut)
            held, rows = table.to_batches(), table.num_rows
    if held:
        yield pa.Table.from_batches(held)


def sorted_pieces(batches: Iterator[pa.RecordBatch], key: str, size: int = 200_000) -> Iterator[tuple[pa.Table, bool]]:
    """Like `sorted_chunks`, but a group of more than about `size` rows comes in several pieces; the flag tells whether a piece holds whole groups."""
    held: list[pa.RecordBatch] = []
    rows, open_key = 0, None

    def ready(table: pa.Table, last: bool):
        nonlocal held, rows, open_key
        keys = table.column(key).to_numpy()
        if open_key is not None:
            cut = int(np.searchsorted(keys, open_key, side="right"))
            if cut:
                yield table.slice(0, cut), False
                table, keys = table.slice(cut), keys[cut:]
            if len(keys) or last:
                open_key = None
        cut = len(keys) if last or not len(keys) else int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield table.slice(0, cut), True
            table, keys = table.slice(cut), keys[cut:]
        if len(keys) >= size:
            open_key = keys[-1]
            yield table, False
            table = table.slice(len(keys))
        held, rows = table.to_batches(), table.num_rows

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows >= size:
                yield from ready(pa.Table.from_batches(held), False)
    if held:
        yield from ready(pa.Table.from_batches(held), True)
