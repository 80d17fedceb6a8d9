"""Sharding by histogram sort.

Rows are ordered by (hash of the group, id, tie). Candidate boundaries ("probes") are counted exactly: one distributed
pass gives the bytes between neighbouring probes and the least and greatest key there. The interval that holds a target
gets new probes, until every splitter meets the tolerance; then one exchange puts every row in its place.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.numbering import ROWS_PER_SALT, number_within
from evalspark.plans.scratch import materialise

Key = tuple[int, int, int]
LEAST = -(2**63)
#: Allowed distance of a splitter from its target, as a share of a shard's bytes.
TOLERANCE = 0.005
#: New probes for each unmet splitter in a pass.
PROBES = 12


def _range_of(probes: list[Key]):
    """An Arrow function: how many probes are not above each key, by one binary search over the whole batch."""
    cuts = np.array(probes, np.int64).reshape(-1, 3)

    def below(h: pa.Array, k: pa.Array, t: pa.Array) -> pa.Array:
        key = [np.asarray(x, np.int64) for x in (h, k, t)]
        lo, hi = np.zeros(len(h), np.int64), np.full(len(h), len(cuts), np.int64)
        while len(cuts) and (open_ := lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(cuts) - 1)
            c = cuts[mid]
            up = (c[:, 0] < key[0]) | (c[:, 0] == key[0]) & ((c[:, 1] < key[1]) | (c[:, 1] == key[1]) & (c[:, 2] <= key[2]))
            lo, hi = np.where(open_ & up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
        return pa.array(lo)

    return F.arrow_udf(below, "bigint")


def count_between(keyed: DataFrame, probes: list[Key]) -> list[tuple[int, int, int, Key, Key]]:
    """For each range between probes that has rows: its number, bytes, rows, least and greatest key.

    At most one row for each probe and one more comes to the driver.
    """
    rows = (
        keyed.select(_range_of(probes)("h", "k", "t").alias("r"), "size", F.struct("h", "k", "t").alias("key"))
        .groupBy("r").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
    )
    return sorted((x.r, x["size"], x.n, tuple(x.lo), tuple(x.hi)) for x in rows)


def _between(lo: Key, hi: Key, n: int) -> list[Key]:
    """Up to ``n`` probes above ``lo`` and not above ``hi``: at edges of groups, else of ids, else of ties."""
    level = next(i for i in range(3) if lo[i] != hi[i])
    a, b = lo[level], hi[level]
    at = sorted({max(a + 1, a + (b - a) * j // n) for j in range(1, n + 1)})
    return [(*lo[:level], x, *([LEAST] * (2 - level))) for x in at]


def splitters(keyed: DataFrame, targets: list[float], slack: float, whole: float) -> list[Key]:
    """A key for each target such that the rows below it hold the target's bytes, to within ``slack``, or half a group
    of at most ``whole`` bytes, or half a row. Only groups of more bytes are cut.

    The first probes cut the space of hashes evenly. Every pass either meets a target or shrinks its interval, which
    ends when a group that stays whole or one key is left; then its nearer side is taken. Targets are few (the shards),
    and so are the ranges of a pass: PROBES for each target that is still open.
    """
    found: dict[int, Key] = {}
    large: set[int] = set()  # hashes of groups to be cut; a group is seen as one range before any of its rows is a probe
    start = 4 * (len(targets) + 1)
    probes: list[Key] = [(LEAST + 2**64 * i // start, LEAST, LEAST) for i in range(1, start)]
    while len(found) < len(targets):
        counted = count_between(keyed, probes)
        below, ends = 0, []
        for r, size, _, lo, hi in counted:
            ends.append((below, below + size, r, lo, hi))
            below += size
        starts = [e[0] for e in ends]
        new: set[Key] = set()
        for i, target in enumerate(targets):
            if i in found:
                continue
            lower, upper, r, lo, hi = ends[bisect_right(starts, target) - 1]
            before, after = lo, (hi[0], hi[1], hi[2] + 1)
            if lo[0] == hi[0] and upper - lower > whole:
                large.add(lo[0])
            small_group = lo[0] == hi[0] and lo[0] not in large
            if min(abs(target - lower), abs(upper - target)) <= slack or small_group or lo == hi:
                found[i] = before if target - lower <= upper - target else _snap(after, r, probes)
            else:
                new.update([lo, *_between(lo, hi, PROBES), after])
        probes = sorted(new)
    return [found[i] for i in range(len(targets))]


def _snap(after: Key, r: int, probes: list[Key]) -> Key:
    """The probe that ends range ``r``, or the key just above its greatest one if no probe does."""
    return probes[r] if r < len(probes) else after


def histogram_sort(
    df: DataFrame, group: Column, row_id: Column, size: Column, n_shards: int, tolerance: float = TOLERANCE
) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1), ``slot`` (gapless in the shard) and ``size``: shards of equal bytes.

    Equal groups lie side by side in one shard: only a group that exceeds a whole shard is cut. So a shard can be off by
    half of the groups at its two ends, and by half of the largest row at a cut; ``shard_balance`` tells. Null ids come first;
    repeated rows are told apart by a tie number that is fixed when the keyed rows are written. An empty ``df`` gives
    an empty result; with fewer rows than shards some shards stay empty. In a shard slots follow the order of groups; a
    piece of it with more rows than one task should number is dealt to several, each in order.
    """
    key = {"h": F.xxhash64(group), "k": F.coalesce(row_id.cast("long"), F.lit(LEAST)), "t": F.monotonically_increasing_id()}
    keyed = materialise(df.withColumns({"size": size.cast("long"), **key}), "keyed")
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    cuts: list[Key] = []
    if rows:
        targets, shard_bytes = [total * i / n_shards for i in range(1, n_shards)], total / n_shards
        cuts = sorted(splitters(keyed, targets, tolerance * shard_bytes, shard_bytes))
    placed = keyed.withColumn("shard", _range_of(cuts)("h", "k", "t").cast("int"))
    bits = max(0, math.ceil(math.log2(max(1, rows / ROWS_PER_SALT))))
    piece = F.shiftright("h", 64 - bits) if bits else F.lit(0)  # pieces in the order of hashes
    return number_within(placed, "shard", piece, [F.col(c) for c in "hkt"], "slot").drop("h", "k", "t")


def shard_balance(placed: DataFrame, n_shards: int) -> DataFrame:
    """shard, rows, bytes and deviation (of the bytes from an even share, as a part of it) of every shard, empty ones
    included, from rows with ``shard`` and ``size``; deviations are 0 for an empty table."""
    held = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    every = placed.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard")).join(held, "shard", "left").na.fill(0, ["rows", "bytes"])
    total = F.broadcast(held.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total")))  # one row
    share = F.col("total") / n_shards
    deviation = F.when(F.col("total") > 0, (F.col("bytes") - share) / share).otherwise(0.0)
    return every.join(total, F.lit(True)).select("shard", "rows", "bytes", deviation.alias("deviation"))


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: shards hold nearly equal bytes. A null text has no bytes (size 16, checksum 0). Other columns are
    ignored.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    digest = docs.select(
        "doc_id", F.xxhash64(body).alias("text_hash"), F.octet_length(body).alias("n_bytes"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
    )
    placed = histogram_sort(digest, F.col("text_hash"), F.col("doc_id"), F.col("n_bytes") + 16, n_shards)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)
