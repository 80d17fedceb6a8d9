"""Signals by batches of one length: power in folded bands, and resampling by a polyphase filter bank."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the bands in Hz: what is below the first is drift and not counted.
FLOOR, WANDER, HIGH = 0.1, 0.7, (20.0, 45.0)
#: Mains frequencies, and how far from them a band reaches.
MAINS, MAINS_HALF = (50.0, 60.0), 0.6
BANDS = ("wander", "mains50", "mains60", "high")
_TINY = np.finfo(float).tiny
#: Values that a kernel multiplies at a time.
_BLOCK = 1 << 22


def signals(arrays: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one length at a time: their places, and their samples as a matrix.

    Null rows, and rows with a null or a number that isn't finite, are in none of them.
    """
    if isinstance(arrays, pa.ChunkedArray):
        arrays = arrays.combine_chunks()
    sizes = arrays.value_lengths().fill_null(-1).to_numpy().astype(np.int64)
    flat = arrays.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(sizes, 0))
    for n in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        for a in range(0, len(rows), max(1, _BLOCK // max(n, 1))):
            some = rows[a : a + max(1, _BLOCK // max(n, 1))]
            values = flat[(ends[some] - n)[:, None] + np.arange(n)]
            whole = np.isfinite(values).all(axis=1)
            yield some[whole], values[whole]


def folded(frequency: float, rate: np.ndarray) -> np.ndarray:
    """Where a frequency appears at a sampling rate: folded at half of it."""
    wrapped = np.mod(frequency, rate)
    return np.minimum(wrapped, rate - wrapped)


def band_shares(values: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Shares of the Hann-windowed power of each row in BANDS; 0 where a row has no power."""
    n = values.shape[1]
    power = np.abs(np.fft.rfft((values - values.mean(axis=1, keepdims=True)) * np.hanning(n), axis=1)) ** 2
    f = np.arange(power.shape[1]) * (rate[:, None] / n)
    near = [np.abs(f - folded(m, rate)[:, None]) <= MAINS_HALF for m in MAINS]
    inside = [(f >= FLOOR) & (f < WANDER), *near, (f >= HIGH[0]) & (f <= HIGH[1]) & ~near[0] & ~near[1]]
    total = np.where(f >= FLOOR, power, 0.0).sum(axis=1)
    sums = np.stack([np.where(m, power, 0.0).sum(axis=1) for m in inside], axis=1)
    return np.where(total[:, None] > _TINY, sums / np.maximum(total, _TINY)[:, None], 0.0)


def spectral_ratios(samples: Column, rate: Column) -> Column:
    """Q3: a struct of each signal's shares of power: slow wander, 50 and 60 Hz mains where they fold to at the row's own
    sampling rate, and high frequencies outside the mains.

    Null for a null signal, one of fewer than two samples, one with a null or not finite sample, and a rate that isn't
    above 0. Rows of one length are transformed together.
    """
    kinds = pa.struct([(b, pa.float64()) for b in BANDS])

    def run(arrays: pa.Array, rates: pa.Array) -> pa.Array:
        fs = rates.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        out, known = np.zeros((len(arrays), len(BANDS))), np.zeros(len(arrays), bool)
        for rows, values in signals(arrays):
            able = np.isfinite(fs[rows]) & (fs[rows] > 0) if values.shape[1] > 1 else np.zeros(len(rows), bool)
            if able.any():
                out[rows[able]], known[rows[able]] = band_shares(values[able], fs[rows[able]]), True
        return pa.StructArray.from_arrays([pa.array(c) for c in out.T], fields=list(kinds), mask=pa.array(~known))

    return F.arrow_udf(run, f"struct<{','.join(f'{b}:double' for b in BANDS)}>")(samples, rate)


#: Taps to each side of the filter for each step of the larger factor, and the shape of its window.
SPAN, BETA = 10, 5.0


def filter_taps(up: int, down: int) -> np.ndarray:
    """A low-pass at the lower of both rates' half: a Kaiser-windowed sinc of unit gain, times ``up``."""
    step = max(up, down)
    at = np.arange(-SPAN * step, SPAN * step + 1)
    taps = np.sinc(at / step) * np.kaiser(len(at), BETA)
    return up * taps / taps.sum()


def filter_bank(up: int, down: int) -> tuple[np.ndarray, int]:
    """One row of taps for each phase, newest sample first, and how many samples after an output's place the row reaches."""
    taps = filter_taps(up, down)
    middle = (len(taps) - 1) // 2
    reach = middle // up + 1
    at = middle + np.arange(up)[:, None] + up * np.arange(-reach, reach + 1)[None, :]
    bank = np.where((at >= 0) & (at < len(taps)), taps[np.clip(at, 0, len(taps) - 1)], 0.0)
    return bank, reach


def resampled(values: np.ndarray, up: int, down: int) -> np.ndarray:
    """Every row at up / down times its rate: ceil(n * up / down) samples, the first at the first; zeros lie outside."""
    n = values.shape[1]
    bank, reach = filter_bank(up, down)
    place = np.arange(-(-n * up // down)) * down
    phase, base = place % up, place // up
    padded = np.pad(values, ((0, 0), (reach, reach)))
    near = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis=1)
    out = np.empty((len(values), len(place)))
    block = max(1, _BLOCK // (len(values) * (2 * reach + 1) or 1))
    for a in range(0, len(place), block):
        own = slice(a, a + block)
        # windows run forward in time, a phase's taps backward
        out[:, own] = np.einsum("rmt,mt->rm", near[:, base[own]], bank[phase[own]][:, ::-1])
    return out


def _resampling(up: int, down: int) -> Callable[[pa.Array], pa.Array]:
    def run(arrays: pa.Array) -> pa.Array:
        out: list[np.ndarray | None] = [None] * len(arrays)
        for rows, values in signals(arrays):
            new = resampled(values, up, down) if values.shape[1] else values
            for row, own in zip(rows.tolist(), new):
                out[row] = own
        return pa.array(out, pa.list_(pa.float64()))

    return run


def resample(samples: Column, up: int, down: int) -> Column:
    """Q8: a signal at up / down times its rate, low-passed below half of the lower rate, as doubles.

    The filter's phases are one matrix and rows of one length are multiplied together. An empty signal stays empty; a
    null one, and one with a null or not finite sample, is null.
    """
    if up < 1 or down < 1:
        raise ValueError("up and down have to be at least 1")
    common = gcd(up, down)
    return F.arrow_udf(_resampling(up // common, down // common), "array<double>")(samples)
