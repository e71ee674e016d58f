"""Windows over the weeks of each symbol, many at once in arrays."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

#: Windows that are laid out at a time.
ROWS = 4096
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # what runs in workers needs no package there


def _held(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values with 0 for nulls, and where there are values."""
    return pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False), pc.is_valid(column).to_numpy(zero_copy_only=False)


def _moments(x: np.ndarray, y: np.ndarray, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Population variance of x, covariance, variance of y in the n values up to each place; exactly 0 of equal values."""
    xs, ys = np.lib.stride_tricks.sliding_window_view(x, n), np.lib.stride_tricks.sliding_window_view(y, n)
    out = np.empty((3, len(at)))
    for k in range(0, len(at), ROWS):
        first = at[k : k + ROWS] - (n - 1)
        a, b = xs[first], ys[first]  # copies
        for v in (a, b):
            v -= v[:, :1].copy()
            v -= v.mean(axis=1, keepdims=True)
        for i, (p, q) in enumerate(((a, a), (a, b), (b, b))):
            out[i, k : k + ROWS] = np.einsum("ij,ij->i", p, q) / n
    return out[0], out[1], out[2]


def _means(x: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Sums of the n values up to each place."""
    xs, out = np.lib.stride_tricks.sliding_window_view(x, n), np.empty(len(at))
    for k in range(0, len(at), ROWS):
        out[k : k + ROWS] = xs[at[k : k + ROWS] - (n - 1)].sum(axis=1)
    return out


def _full(own: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Places whose window lies in the symbol's weeks and has a week before it."""
    return np.flatnonzero((own >= n) & (place > n))


def rolled(batches: Iterator[pa.RecordBatch], long: int, short: int) -> Iterator[pa.RecordBatch]:
    """(symbol, older, w: weeks in order with ret and market) -> (symbol, weeks: with mean, beta and idio)."""
    for batch in batches:
        lists = batch.column("w")
        weeks, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        own = np.arange(len(weeks)) - np.repeat(ends - sizes, sizes) + 1
        place = own + np.repeat(batch.column("older").to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        (r, has), (m, moves) = _held(weeks.field("ret")), _held(weeks.field("market"))
        both, (mean, beta, idio) = (has & moves).astype(np.int64), (np.full(len(weeks), np.nan) for _ in range(3))
        none = np.ones((3, len(weeks)), bool)
        count = lambda known, n, at: (s := np.concatenate([[0], np.cumsum(known)]))[at + 1] - s[at + 1 - n]
        at = _full(own, place, long)
        if len(at):
            n = count(has, long, at)
            at, n = at[n > 0], n[n > 0]
            mean[at], none[0, at] = _means(r, long, at) / n, False
            at = at[count(both, long, at) == long]
            vr, cov, vm = _moments(r, m, long, at)
            at, vr, cov, vm = (v[vm != 0] for v in (at, vr, cov, vm))
            rest = vr - cov * cov / vm
            idio[at], none[2, at] = np.sqrt(np.where(rest < 0, 0.0, rest)), False
        at = _full(own, place, short)
        if len(at):
            at = at[count(both, short, at) == short]
            _, cov, vm = _moments(r, m, short, at)
            at, cov, vm = (v[vm != 0] for v in (at, cov, vm))
            beta[at], none[1, at] = cov * short / (short - 1) / vm, False
        made = [pa.array(v, pa.float64(), mask=none[i]) for i, v in enumerate((mean, beta, idio))]
        rows = pa.StructArray.from_arrays([weeks.field("week"), *made], ["week", "mean", "beta", "idio"])
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("symbol"), pa.ListArray.from_arrays(offsets, rows)], ["symbol", "weeks"])
