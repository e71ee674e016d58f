"""The weighted fill of sorted rows, many keys at once in arrays."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # what runs in workers needs no package there


def kept(gap: np.ndarray, rate: float) -> np.ndarray:
    """The share that a mean keeps when a value comes `gap` rows after the last."""
    left = np.exp(rate * gap)
    return left / (left + 1 - math.exp(rate))


def filled(batches: Iterator[pa.RecordBatch], columns: list[str], rate: float, lead: bool, most: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of key and place, with their place in the key as _p (from 1, to most), without it and with the columns' nulls filled.

    What a key has taken so far goes on into the next batch.
    """
    k, shares = len(columns), kept(np.arange(most + 2), rate)
    last = np.zeros((1, k)), np.zeros((1, k), np.int64), np.zeros((1, k), bool)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        place = batch.column("_p").to_numpy()
        x, has = np.empty((n, k)), np.empty((n, k), bool)
        for i, c in enumerate(columns):
            x[:, i], has[:, i] = pc.fill_null(batch.column(c), 0.0).to_numpy(zero_copy_only=False), pc.is_valid(batch.column(c)).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(place == 1)
        if place[0] != 1:
            start = np.concatenate([[0], start])
        sizes = np.diff(np.append(start, n))
        order = np.argsort(-sizes, kind="stable")
        mean, gap, seen = np.zeros((len(start), k)), np.zeros((len(start), k), np.int64), np.zeros((len(start), k), bool)
        if place[0] != 1:
            for now, before in zip((mean, gap, seen), last, strict=True):
                now[np.flatnonzero(order == 0)[0]] = before
        out, none = np.empty((n, k)), np.zeros((n, k), bool)
        many = np.searchsorted(-sizes[order], -np.arange(sizes.max()), "left")  # keys with more rows than each step has gone through
        for step, a in enumerate(many.tolist()):
            at = start[order[:a]] + step
            v, h, m, g, s = x[at], has[at], mean[:a], gap[:a] + 1, seen[:a]
            first = np.where(place[at] > 1, math.exp(rate), 0.0)[:, None] if lead else 0.0
            keeps = np.where(s, shares[g], first)
            m = np.where(h, keeps * m + (1 - keeps) * v, m)
            mean[:a], gap[:a], seen[:a] = m, np.where(h, 0, g), s | h
            out[at] = np.where(h, v, m)
            if not lead:
                none[at] = ~seen[:a]
        end = np.flatnonzero(order == len(start) - 1)[0]
        last = mean[end : end + 1], gap[end : end + 1], seen[end : end + 1]
        made = {c: pa.array(out[:, i], pa.float64(), mask=none[:, i]) for i, c in enumerate(columns)}
        names = [c for c in batch.schema.names if c != "_p"]
        yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)
