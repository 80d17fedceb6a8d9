"""Array kernels over the UTF-8 bytes of a whole Arrow batch of texts; they run inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed: the six ASCII bytes that separate words, i.e. the complement of the class [^\x20\x09-\x0D].
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240607).integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = _RANDOM[300]
#: Bytes that are hashed at a time; a worker holds some 50 bytes for each of them.
PIECE = 1 << 17


def _inverse(x: int) -> int:
    return pow(x, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes end to end, and the offsets at which texts begin and end; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, to keep a kernel's arrays small; a longer text is alone in its range."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words that begin before each offset."""
    space = _IS_SPACE[raw]
    word = ~space
    before = np.empty(len(raw), bool)
    if len(raw):
        before[0] = True
        before[1:] = space[:-1]
        before[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(word & before)
    after = np.empty(len(raw), bool)
    if len(raw):
        after[-1] = True
        after[:-1] = space[1:]
        inner = offsets[1:-1]
        after[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_counts(texts: pa.Array) -> np.ndarray:
    counts = [np.diff(word_spans(*flat(texts.slice(a, b - a)))[2]) for a, b in slices(texts)]
    return np.concatenate(counts) if counts else np.zeros(0, np.int64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word: random byte codes weighted by powers of an odd base, by one prefix sum.

    Differences of the prefix sum are divided by the power at the word's start, so equal words hash alike wherever
    they stand.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # in pieces of about PIECE bytes, at word ends
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
        piece = raw[lo : ends[to - 1]]
        codes = _RANDOM[(_LOWER[piece] if lower else piece)]
        powers = _powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(codes * powers[:-1], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (sums[e] - sums[s]) * _powers(len(piece) + 1, inverse=True)[s] + _RANDOM[301] * (e - s).astype(np.uint64)
        at = to
    return mixed(out)


_CACHE: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    have = _CACHE.get(inverse)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        step = np.full(size, np.uint64(_inverse(int(_BASE))) if inverse else _BASE, np.uint64)
        step[0] = 1
        have = _CACHE[inverse] = np.cumprod(step)
    return have[:n]


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles of each text as sorted 64-bit hashes, end to end, with offsets by text.

    ASCII capitals are lowered. A text with fewer words has its whole word sequence as its only shingle; one without
    words has none.
    """
    raw, offsets = flat(texts)
    starts, ends, first = word_spans(raw, offsets)
    hashes = word_hashes(raw, starts, ends)
    n = len(hashes)
    window = np.zeros(n, np.uint64)
    for k in range(width):
        if n > k:
            window[: n - k] += hashes[k:] * _RANDOM[310 + k]
    sets, sizes = [], np.zeros(len(offsets), np.int64)
    for i in range(len(offsets) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            own = np.unique(mixed(window[a : b - width + 1]))
        elif b > a:
            own = _short(hashes[a:b])
        else:
            continue
        sets.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum(sizes)


def _short(hashes: np.ndarray) -> np.ndarray:
    return mixed(np.array([(hashes * _RANDOM[320 : 320 + len(hashes)]).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64))
