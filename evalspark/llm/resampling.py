"""Importance resampling of documents towards a target distribution of hashed word n-grams.

The texts of a batch are joined with separator sentinels and one regular-expression pass finds all words. The places of
the words against the documents' offsets tell which n-grams would cross from one document into the next; those are masked
before the buckets are counted.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.batches import small_batches
from evalspark.llm.bytesets import slices
from evalspark.plans.prims import prefix_scan
from evalspark.plans.scratch import discard, materialise

#: Fixed: what a word is made of, on UTF-8 bytes: ASCII digits, small letters and all bytes of other characters.
WORD = re.compile(rb"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)")
#: Fixed: capitals that are lowered.
CAPITALS = bytes(range(65, 91)), bytes(range(97, 123))
_LOWERED = bytes.maketrans(*CAPITALS)
#: Stands between two texts of a batch; no word holds it.
SENTINEL = b"\x00"
N_BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Of the differences between a text's buckets in order.
STEP = np.dtype("<u2")
#: Fixed: the reflected polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320
_MASK = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """What a zero register becomes after each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), table >> np.uint32(1))
    return table


_TABLE = _byte_table()
#: Sizes of right texts whose tables are kept: most words are shorter.
_KEPT = 64


def _pass(register: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """What registers become, by four tables, one for each of their bytes."""
    out = tables[0][register & 255]
    for k in range(1, 4):
        out ^= tables[k][(register >> np.uint32(8 * k)) & 255]
    return out


def _kept_tables() -> np.ndarray:
    """For each size below _KEPT the four tables of that many zero bytes, end to end."""
    tables = np.empty((_KEPT, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for n in range(1, _KEPT):
        tables[n] = _TABLE[tables[n - 1] & 255] ^ (tables[n - 1] >> np.uint32(8))
    return tables


_OVER_ZEROS = _kept_tables()
_FLAT = _OVER_ZEROS.reshape(-1)


def _over_zeros(n: int) -> np.ndarray:
    return _OVER_ZEROS[n] if n < _KEPT else _pass(_over_zeros(n // 2), _over_zeros(n - n // 2))


def joined_crc(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each left text followed by its right one, from the two sums and the right one's bytes."""
    at = np.where(sizes < _KEPT, sizes, 0) * 1024
    out = _FLAT[at + (left & 255)]
    for k in range(1, 4):
        out ^= _FLAT[at + (256 * k) + ((left >> np.uint32(8 * k)) & 255)]
    for n in np.unique(sizes[sizes >= _KEPT]).tolist():
        long_ = sizes == n
        out[long_] = _pass(left[long_], _over_zeros(n))
    return out ^ right


def batch_features(texts: pa.Array, width: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every n-gram's bucket and text, and each text's number of words; n-grams of 1 to ``width`` words.

    A null text has no words.
    """
    raw = [(t or "").encode() for t in texts.to_pylist()]
    joined = SENTINEL.join(raw).translate(_LOWERED)
    offsets = np.cumsum([0, *(len(t) + 1 for t in raw)])[:-1]
    pieces = WORD.split(joined)  # what lies before, between and after words at even places, words at odd ones
    words = pieces[1::2]
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts, sizes = np.cumsum(lengths)[:-1:2], lengths[1::2]
    doc = np.searchsorted(offsets, starts, "right") - 1
    alone = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    buckets, owners, grams = [alone % np.uint32(n_buckets)], [doc], alone
    for k in range(1, min(width, len(words))):
        register = ~grams[:-1]
        spaced = ~(_TABLE[(register ^ np.uint32(0x20)) & 255] ^ (register >> np.uint32(8)))
        grams = joined_crc(spaced, alone[k:], sizes[k:])
        inside = doc[:-k] == doc[k:]
        buckets.append(grams[inside] % np.uint32(n_buckets))
        owners.append(doc[k:][inside])
    return np.concatenate(buckets), np.concatenate(owners), np.bincount(doc, minlength=len(raw))


def _featuring(width: int, n_buckets: int) -> Callable[[pa.Array], pa.Array]:
    kinds = pa.struct([("n_words", pa.int64()), ("steps", pa.binary())])

    def features(texts: pa.Array) -> pa.Array:
        parts = []
        for a, b in slices(texts):
            buckets, owners, n_words = batch_features(texts.slice(a, b - a), width, n_buckets)
            order = np.lexsort((buckets, owners))
            ends = np.cumsum(np.bincount(owners, minlength=b - a))
            steps = np.diff(buckets[order], prepend=np.uint32(0)).astype(STEP)
            firsts = (ends - np.diff(ends, prepend=0))[np.diff(ends, prepend=0) > 0]
            steps[firsts] = buckets[order][firsts]
            offsets = pa.array(np.concatenate([[0], ends]) * STEP.itemsize, pa.int32())
            rows = pa.Array.from_buffers(pa.binary(), b - a, [None, offsets.buffers()[1], pa.py_buffer(steps.tobytes())])
            parts.append(pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), rows], fields=list(kinds)))
        return pa.concat_arrays(parts) if parts else pa.array([], kinds)

    return features


def text_features(text: Column, width: int = 2, n_buckets: int = N_BUCKETS) -> Column:
    """A struct of a whole text's ``n_words`` and ``steps``: the buckets of its n-grams in rising order, each as the
    difference to the one before it, two bytes each."""
    if not 0 < n_buckets <= 1 << 16:
        raise ValueError("n_buckets has to be 1 to 65,536")
    return F.arrow_udf(_featuring(width, n_buckets), "struct<n_words:bigint,steps:binary>")(text.cast("string"))


def _buckets_of(steps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows' buckets end to end, and the number of them up to each row's end."""
    _, offsets, data = steps.cast(pa.large_binary()).buffers()
    at = np.frombuffer(offsets, np.int64)[steps.offset : steps.offset + len(steps) + 1] // STEP.itemsize
    raw = np.frombuffer(data, STEP)[at[0] : at[-1]].astype(np.int64) if data is not None else np.zeros(0, np.int64)
    ends = at - at[0]
    run = np.concatenate([[0], np.cumsum(raw)])
    return run[1:] - np.repeat(run[ends[:-1]], np.diff(ends)), ends


def _counting(n_buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            total += np.bincount(_buckets_of(batch.column(0))[0], minlength=n_buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    return count


def bucket_counts(featured: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """``bucket``, ``n``: how many n-grams of all rows of ``steps`` fall into each bucket that any falls into.

    A task sends a row for each bucket at most. An empty table counts nothing.
    """
    return featured.select("steps").mapInArrow(_counting(n_buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """``bucket``, ``gain`` for each of ``n_buckets``: thousandths of the log ratio of the target's smoothed share to the
    source's, rounded down; both tables are of ``bucket_counts``."""
    counts = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = counts.unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = source.sparkSession.range(n_buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    by = counts.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    sums = by.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    own = lambda n: F.col(n).cast("double")
    ratio = ((own("t") + 1) * (own("all_s") + n_buckets)) / ((own("s") + 1) * (own("all_t") + n_buckets))
    return by.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _weighing(gains: np.ndarray) -> Callable[[pa.Array], pa.Array]:
    kinds = pa.struct([("n_features", pa.int64()), ("weight", pa.int64())])

    def weigh(steps: pa.Array) -> pa.Array:
        buckets, ends = _buckets_of(steps)
        sums, n = np.concatenate([[0], np.cumsum(gains[buckets])])[ends], np.diff(ends)
        mean = np.floor_divide(np.diff(sums), np.maximum(n, 1))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(mean, pa.int64())], fields=list(kinds))

    return weigh


def weights(steps: Column, gains: DataFrame, n_buckets: int = N_BUCKETS) -> Column:
    """A struct of ``n_features`` and ``weight``, the mean gain of a row's n-grams, rounded down; 0 without n-grams.

    The table of gains has ``n_buckets`` rows, so it goes to the tasks whole.
    """
    by_bucket = np.zeros(n_buckets, np.int64)
    for row in gains.collect():
        by_bucket[row.bucket] = row.gain
    return F.arrow_udf(_weighing(by_bucket), "struct<n_features:bigint,weight:bigint>")(steps)


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number above 0 and below 1 that seed and key fix; a null key counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document.

    Scores are weights with Gumbel noise that seed and doc_id fix, so the highest are a draw without replacement with odds
    that grow with the weight. Of the documents with ``min_words`` words or more, ``percent`` in a hundred are drawn and
    ranked by score, ties by smaller doc_id (null first), then fewer features; the others' rank is null.

    A null text is an empty one: 0 features, weight 0. Repeated rows are documents of their own with the same score and
    places of their own. An empty ``docs`` gives no rows; with an empty ``target`` all gains follow the source alone.
    Other columns of either table are not looked at.
    """
    small_batches(docs.sparkSession)
    found = text_features(F.col("text")).alias("found")
    own = materialise(docs.select("doc_id", found).select("doc_id", "found.*"), "features")
    aim = target.select(found).select("found.*")
    gains = materialise(bucket_gains(bucket_counts(own), bucket_counts(aim)), "gains")
    weighed = own.select("doc_id", "n_words", weights(F.col("steps"), gains).alias("w")).select("doc_id", "n_words", "w.*")
    noise = F.floor(-1000 * F.log(-F.log(uniform(F.col("doc_id"), seed)))).cast("long")
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise), "scored")
    discard(own, gains)
    able = F.coalesce(F.col("n_words") >= min_words, F.lit(False))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features")]
    placed = prefix_scan(scored.where(able), [], order, {"rank": F.lit(1).cast("long")})
    drawn = F.col("rank") <= F.expr(f"{percent} * rank_total DIV 100")
    cols = ["doc_id", "n_features", "weight", "score"]
    ranked = placed.select(*cols, F.when(drawn, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~able).select(*cols, F.lit(None).cast("long").alias("rank")))
