"""Measures of leads and of whole records, by batches of one shape as in ``spectra``; what they mean is told by ``limits``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.operators.spectra import BANDS, band_shares, signals

#: Fixed: steps no larger than this are flat, samples this near to an extreme are clipped.
FLAT_STEP, CLIP_NEAR = 5e-4, 1e-8
METRICS = ("peak_to_peak", "sd", "max_abs", "flat_fraction", "flat_seconds", "clip_fraction", "clip_run", "max_step", *BANDS)
#: Sums and scales no larger than this are those of a flat signal.
FLAT_SUM = 2.0**-52
#: Samples that are measured at a time.
_BLOCK = 1 << 19


def longest_runs(mask: np.ndarray) -> np.ndarray:
    """Length of the longest run of true in each row."""
    run = best = np.zeros(len(mask), np.int64)
    for column in np.ascontiguousarray(mask.T):
        run = (run + 1) * column
        best = np.maximum(best, run)
    return best


def centred(values: np.ndarray) -> np.ndarray:
    """Rows about their means; a flat row is exactly 0."""
    away = values - values[..., :1]
    return away - away.mean(axis=-1, keepdims=True)


def lead_values(values: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """METRICS of each row, but for the longest flat run in steps where they have it in seconds; bands are 0 where the
    rate isn't above 0. Rows are finite and have two samples at least."""
    d = np.abs(np.diff(values, axis=1))
    lo, hi = values.min(axis=1), values.max(axis=1)
    clipped = (values - lo[:, None] <= CLIP_NEAR) | (hi[:, None] - values <= CLIP_NEAR)
    flat = d <= FLAT_STEP
    able = np.isfinite(rate) & (rate > 0)
    bands = np.where(able[:, None], band_shares(values, np.where(able, rate, 1.0)), 0.0)
    own = (hi - lo, np.sqrt((centred(values) ** 2).mean(axis=1)), np.maximum(np.abs(lo), np.abs(hi)), flat.mean(axis=1), longest_runs(flat), clipped.mean(axis=1), longest_runs(clipped), d.max(axis=1))
    return np.column_stack([*own, bands])


def lead_metrics(samples: Column, rate: Column) -> Column:
    """A struct of ``lead_values`` for each signal; null for one of fewer than two samples or with one that isn't finite."""
    kinds = pa.struct([(m, pa.float64()) for m in METRICS])

    def run(arrays: pa.Array, rates: pa.Array) -> pa.Array:
        fs = rates.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        out, known = np.zeros((len(arrays), len(METRICS))), np.zeros(len(arrays), bool)
        for rows, values in signals(arrays):
            for a in range(0, len(rows) if values.shape[1] > 1 else 0, step := max(1, _BLOCK // max(values.shape[1], 1))):
                some = rows[a : a + step]
                out[some], known[some] = lead_values(values[a : a + step], fs[some]), True
        return pa.StructArray.from_arrays([pa.array(c) for c in out.T], fields=list(kinds), mask=pa.array(~known))

    return F.arrow_udf(run, f"struct<{','.join(f'{m}:double' for m in METRICS)}>")(samples, rate)


def _numbers(a: pa.Array) -> np.ndarray:
    return a.fill_null(0 if pa.types.is_integer(a.type) else np.nan).to_numpy(zero_copy_only=False)


def _records(leads: pa.Array) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Which records have only finite samples; and of those whose leads all have one length, one shape at a time: their
    places, the places of their leads among all leads, and their samples by record and lead."""
    counts = leads.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    inner = leads.flatten()
    sizes = inner.value_lengths().fill_null(-1).to_numpy().astype(np.int64)
    flat = _numbers(inner.flatten().cast(pa.float64()))
    ends, last = np.cumsum(np.maximum(sizes, 0)), np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    odd = sizes < 0
    odd[np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))[~np.isfinite(flat)]] = True
    finite = np.bincount(owner[odd], minlength=len(counts)) == 0
    length = np.full(len(counts), -1)
    length[owner] = sizes
    uneven = np.bincount(owner[sizes != length[owner]], minlength=len(counts)) > 0
    whole = finite & ~uneven & (counts > 0) & (length > 0)

    def shapes() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for k, n in sorted(set(zip(counts[whole].tolist(), length[whole].tolist()))):
            rows = np.flatnonzero(whole & (counts == k) & (length == n))
            step = max(1, _BLOCK // (k * n))
            for a in range(0, len(rows), step):
                some = rows[a : a + step]
                at = (last[some] - k)[:, None] + np.arange(k)
                yield some, at, flat[(ends[at] - n)[..., None] + np.arange(n)]

    return finite, shapes()


def _quantile(ordered: np.ndarray, q: float) -> np.ndarray:
    at = (ordered.shape[-1] - 1) * q
    low, high = ordered[..., int(np.floor(at))], ordered[..., int(np.ceil(at))]
    return low + (high - low) * (at - np.floor(at))


def polarities(values: np.ndarray, share: float) -> np.ndarray:
    """``waves.polarity`` of each row."""
    away = values - _quantile(np.sort(values, axis=-1), 0.5)[..., None]
    size = np.abs(away)
    far = size >= _quantile(np.sort(size, axis=-1), share)[..., None]
    total = np.where(far, size, 0.0).sum(axis=-1)
    return np.where(total > FLAT_SUM, np.where(far, away, 0.0).sum(axis=-1) / np.maximum(total, FLAT_SUM), 0.0)


def correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``waves.correlation`` of each row of two matrices."""
    x, y = centred(a), centred(b)
    size = np.sqrt((x * x).sum(axis=-1) * (y * y).sum(axis=-1))
    return np.where(size > FLAT_SUM, (x * y).sum(axis=-1) / np.maximum(size, FLAT_SUM), 0.0)


def limb_residuals(limb: np.ndarray) -> np.ndarray:
    """``waves.limb_consistency`` of each record's leads 0 to 5."""
    a, b, c, r, l, f = np.moveaxis(limb, 1, 0)  # noqa: E741
    left = ((a + c - b) ** 2 + (r + (a + b) / 2) ** 2 + (l - (a - b / 2)) ** 2 + (f - (b - a / 2)) ** 2).sum(axis=-1) / (4 * limb.shape[2])
    return np.sqrt(left) / np.maximum(np.sqrt((limb**2).sum(axis=(1, 2)) / (6 * limb.shape[2])), FLAT_SUM)


def _lists(n: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Rows of matrices as lists, at their places among ``n``; null elsewhere."""
    sizes, known = np.zeros(n, np.int64), np.zeros(n, bool)
    for rows, values in parts:
        sizes[rows], known[rows] = values.shape[1], True
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.empty(starts[-1])
    for rows, values in parts:
        flat[starts[rows][:, None] + np.arange(values.shape[1])] = values
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat), mask=pa.array(~known))


def record_measures(leads: Column, numbers: Column, rates: Column, within: Column, strengths: Sequence[int | tuple[int, int]], share: float) -> Column:
    """A struct of what ``limits`` asks of a record, whose ``leads`` are an array of signals with a number and a rate each.

    ``finite``: no lead is null and no sample null or not finite. The rest is null unless all leads have the same length
    and finite samples. ``values`` are METRICS, each by lead, and ``least`` and ``most`` their extremes over the leads (all
    three are empty for leads of one sample); ``limb`` is the residual of leads 0 to 5; ``strengths`` are the polarities of leads, or the correlations of
    pairs of leads, that are asked for by number (NaN if a lead is missing); ``pairs`` are the places of two leads that
    are at most ``within`` apart in every sample, and how far.
    """
    seconds = METRICS.index("flat_seconds")
    pair = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("apart", pa.float64())])

    def measured(arrays: pa.Array, idx: pa.Array, fs: pa.Array, limit: pa.Array) -> pa.Array:
        n = len(arrays)
        finite, shapes = _records(arrays)
        number, rate, bound = _numbers(idx.flatten()), _numbers(fs.flatten().cast(pa.float64())), _numbers(limit.cast(pa.float64()))
        lists: dict[str, list] = {name: [] for name in ("values", "least", "most", "strengths")}
        limb, found = np.full(n, np.nan), []
        for rows, at, x in shapes:
            k, size = x.shape[1:]
            own = np.zeros((len(rows), 0, k))
            if size > 1:
                each = lead_values(x.reshape(-1, size), rate[at].ravel())
                run = each[:, seconds]
                each[:, seconds] = np.where(run > 0, (run + 1) / rate[at].ravel(), 0.0)
                own = each.reshape(len(rows), k, len(METRICS)).transpose(0, 2, 1)
            of = number[at]

            def lead(i: int) -> tuple[np.ndarray, np.ndarray]:
                return x[np.arange(len(x)), (of == i).argmax(axis=1)], (of == i).any(axis=1)  # noqa: B023

            limbs = [lead(i) for i in range(6)]
            limb[rows] = np.where(np.all([h for _, h in limbs], axis=0), limb_residuals(np.stack([v for v, _ in limbs], axis=1)), np.nan)
            asked = []
            for s in strengths:
                (v, has), *other = [lead(i) for i in (s if isinstance(s, tuple) else (s,))]
                held = has & other[0][1] if other else has
                asked.append(np.where(held, correlations(v, other[0][0]) if other else polarities(v, share), np.nan))
            told = (own.reshape(len(rows), -1), np.fmin.reduce(own, axis=2), own.max(axis=2), np.stack(asked, axis=1) if asked else np.zeros((len(rows), 0)))
            for name, values in zip(lists, told):
                lists[name].append((rows, values))
            for a in range(k):
                apart = np.abs(x[:, a + 1 :] - x[:, a : a + 1]).max(axis=2)
                r, b = np.nonzero(apart <= bound[rows][:, None])
                found.append((rows[r], np.full(len(r), a), a + 1 + b, apart[r, b]))
        row, a, b, apart = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int),) * 4
        order = np.argsort(row, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
        near = pa.StructArray.from_arrays([pa.array(a[order], pa.int32()), pa.array(b[order], pa.int32()), pa.array(apart[order], pa.float64())], fields=list(pair))
        columns = [pa.array(finite), *[_lists(n, parts) for parts in lists.values()], pa.array(limb, from_pandas=True), pa.ListArray.from_arrays(pa.array(starts), near)]
        return pa.StructArray.from_arrays(columns, names=["finite", *lists, "limb", "pairs"])

    kinds = "finite boolean, values array<double>, least array<double>, most array<double>, strengths array<double>, limb double, pairs array<struct<a:int,b:int,apart:double>>"
    return F.arrow_udf(measured, kinds)(leads, numbers, rates, within)
