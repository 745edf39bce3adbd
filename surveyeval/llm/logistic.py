"""Ridge logistic regression on a bounded sample of sparse rows, fitted inside a Spark task: steps cost neither jobs nor vectors in the driver."""

from __future__ import annotations

import os
import tempfile
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Numbers read at a time; a row is never split.
CHUNK = 1 << 18
#: Bytes of rows that stay in memory.
HELD = 64 << 20


class SparseRows:
    """Sparse rows, read in chunks: up to HELD bytes stay in memory, the rest stands in one temporary file without a name, so that memory is bounded whatever the rows' lengths.

    A chunk of few different values holds each of them once, as it is, and two bytes a number that say which it is.
    """

    def __init__(self, size: int) -> None:
        self.size, self.bytes, self.blocks, self.file = size, 0, [], None

    def add(self, indices: pa.ListArray, values: pa.ListArray) -> None:
        lengths = pc.list_value_length(indices).to_numpy(zero_copy_only=False).astype(np.int64)
        places, numbers, ends, first = indices.flatten().to_numpy(), values.flatten().to_numpy(), np.cumsum(lengths), 0
        while first < len(ends):
            start = ends[first] - lengths[first]
            last = max(first + 1, int(np.searchsorted(ends, start + CHUNK, "right")))
            part = numbers[start : ends[last - 1]].astype(np.float64)
            different, which = np.unique(part, return_inverse=True)
            parts = [places[start : ends[last - 1]].astype(np.int32), *([which.astype(np.uint16), different] if len(different) <= 1 << 16 else [part])]
            need = sum(x.nbytes for x in parts)
            if self.bytes + need <= HELD:
                self.bytes += need
            elif need:
                parts = [self._spooled(x) for x in parts]
            self.blocks.append((parts, lengths[first:last]))
            first = last

    def _spooled(self, x: np.ndarray) -> tuple[int, int, np.dtype]:
        self.file = self.file or tempfile.TemporaryFile()
        at = self.file.tell()
        self.file.write(x.tobytes())
        self.file.flush()
        return at, x.nbytes, x.dtype

    def _read(self, x: np.ndarray | tuple[int, int, np.dtype]) -> np.ndarray:
        return x if isinstance(x, np.ndarray) else np.frombuffer(os.pread(self.file.fileno(), x[1], x[0]), x[2])

    def chunks(self):
        """(slice of rows, places, values, numbers of each row)"""
        done = 0
        for parts, lengths in self.blocks:
            places, values, *different = map(self._read, parts)
            yield slice(done, done + len(lengths)), places, different[0][values] if different else values, lengths
            done += len(lengths)

    def margins(self, coefficients: np.ndarray, intercept: float) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[_sums(coefficients[at] * x, n) for _, at, x, n in self.chunks()]]) + intercept


def _sums(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of x."""
    out, some = np.zeros(len(lengths)), lengths > 0
    if len(x):
        out[some] = np.add.reduceat(x, (np.cumsum(lengths) - lengths)[some])
    return out


def minimise(f, u: np.ndarray, steps: int, memory: int = 10, tol: float = 1e-6) -> np.ndarray:
    """L-BFGS on f, which gives value and gradient, with steps that meet the weak Wolfe conditions."""
    value, g = f(u)
    past: deque = deque(maxlen=memory)
    for _ in range(steps):
        if np.abs(g).max() <= tol:
            break
        d, alphas = -g, []
        for s, y in reversed(past):
            alphas.append((s @ d) / (s @ y))
            d = d - alphas[-1] * y
        if past:
            s, y = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope, low, high, t = g @ d, 0.0, np.inf, 1.0
        for _ in range(30):
            new = f(u + t * d)
            if new[0] > value + 1e-4 * t * slope:
                high = t
            elif new[1] @ d < 0.9 * slope:
                low = t
            else:
                break
            t = (low + high) / 2 if np.isfinite(high) else 2 * t
        if not new[0] <= value:
            break
        change, s, y = value - new[0], t * d, new[1] - g
        u, (value, g) = u + s, new
        if s @ y > 0:
            past.append((s, y))
        if change <= tol * 1e-2 * max(1.0, abs(value)):
            break
    return u


def fit_logistic(rows: SparseRows, label: np.ndarray, weight: np.ndarray, ridge: float, steps: int, standardize: bool) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of the least mean weighted log loss plus ridge / 2 times the squared coefficients (those of columns of deviation one,
    with `standardize`); the intercept is free.  Rows of weight 0 do not count.  Columns that do not vary get 0.
    """
    w = weight / weight.sum()
    mean, square = np.zeros(rows.size), np.zeros(rows.size)
    for part, at, x, n in rows.chunks():
        share = x * np.repeat(w[part], n)
        mean += np.bincount(at, share, minlength=rows.size)
        square += np.bincount(at, x * share, minlength=rows.size)
    spread = square - mean * mean
    spread = np.where(spread > 1e-12 * square, spread, 0.0) / max(1e-12, 1 - w @ w)
    penalty = ridge * spread if standardize else np.full(rows.size, ridge)
    scale = np.where(spread > 0, 1 / np.sqrt(np.maximum(spread / 4 + penalty, 1e-300)), 0.0)  # the curvature of a column is then about one

    def loss(u: np.ndarray) -> tuple[float, np.ndarray]:
        c = u[:-1] * scale
        shift, value, g, total = u[-1] - mean @ c, penalty @ (c * c) / 2, np.zeros(rows.size), 0.0
        for part, at, x, n in rows.chunks():
            m = _sums(c[at] * x, n) + shift
            value += w[part] @ (np.logaddexp(0, m) - label[part] * m)
            r = w[part] * (1 / (1 + np.exp(-np.clip(m, -500, 500))) - label[part])
            g += np.bincount(at, x * np.repeat(r, n), minlength=rows.size)
            total += r.sum()
        return value, np.append((g - mean * total + penalty * c) * scale, total)

    share = w @ label
    u = minimise(loss, np.append(np.zeros(rows.size), np.log(share / (1 - share))), steps)
    c = u[:-1] * scale
    return c, float(u[-1] - mean @ c)
