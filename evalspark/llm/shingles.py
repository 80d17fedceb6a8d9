"""Shingle sets of whole texts: their fingerprints, the classes of equal sets, and which classes can have a link.

Texts are shingled three times, since sets are wider than the texts they come from: once for fingerprints, once for the
tokens that elimination looks at, and once for the sets of the classes that are left, a fifth of all or less.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.batches import small_batches
from evalspark.llm.bytesets import mixed, shingle_sets, slices
from evalspark.plans.scratch import materialise, materialise_buckets

#: Links need 100 * intersection >= 75 * union.
NUM, DEN = 75, 100
WIDTH = 5
#: Extra share of tokens that elimination looks at, in hundredths of a set.
SLACK = 10
#: The most common tokens that a slice of text reports, and the most that are known everywhere (8 bytes each).
SLICE_COMMON, COMMON = 256, 1 << 16
#: Classes of more copies than this are known everywhere, the most copied ones of them (16 bytes each).
COPIES, COPIED = 64, 1 << 14
#: Bytes of sets that a bucket is meant to hold.
BUCKET_BYTES = 1 << 26
#: Bits of a class's sketch.
SKETCH = 1024
#: Segments for each token of a band's smallest set; bands below FINE have a segment for each token.
SEGMENTS, FINE = 0.75, 128


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches of about 1 MB of a column of texts or bytes."""
    for batch in batches:
        for a, b in slices(batch.column(column)):
            yield batch.slice(a, b - a)


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def fingerprints(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set: sums of two scramblings of its tokens."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mixed(tokens ^ np.uint64(salt)), out=sums[1:])
        out.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
    return out[0], out[1]


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the tokens in each of SKETCH buckets. Two sketches differ in no more bits than their sets in tokens."""
    bucket = (mixed(tokens ^ np.uint64(0x9E6C63D0876A9F35)) >> np.uint64(32)) % np.uint64(SKETCH)
    return np.packbits(np.bincount(bucket.astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8).tobytes()


def band_of(size: int) -> int:
    return size.bit_length() - 1


def views(size: int) -> list[tuple[int, int]]:
    """(band, differences that a partner of at most this size may have) for each band that such partners are in."""
    band = band_of(size)
    out = [(band, 2 * size * (DEN - NUM) // (DEN + NUM))]
    if -(-NUM * size // DEN) < (1 << band):
        out.append((band - 1, (size + (1 << band) - 1) * (DEN - NUM) // (DEN + NUM)))
    return out


def segments_of(tokens: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The set's tokens ordered by segment, and the start of each segment that isn't empty."""
    if (1 << band) < FINE:
        return tokens, np.arange(len(tokens))
    scrambled = mixed(tokens ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(int(SEGMENTS * (1 << band)))
    order = np.argsort(scrambled, kind="stable")
    seg = scrambled[order]
    return tokens[order], np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])


def short_bands(tokens: np.ndarray) -> int:
    """A bit for each band in which the set has fewer segments than it must probe (differences + 1)."""
    return sum(1 << band for band, differ in views(len(tokens)) if len(segments_of(tokens, band)[1]) <= differ)


def _first_of_class(lo: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lo), bool)
    out[np.unique(lo, return_index=True)[1]] = True
    return out


def _common_here(tokens: np.ndarray, ends: np.ndarray, lo: np.ndarray) -> list[int]:
    """The tokens that most classes of a slice have, if at least two have them."""
    sizes = np.diff(ends)
    seen = np.sort(tokens[np.repeat(_first_of_class(lo), sizes)])
    starts = np.flatnonzero(np.r_[True, seen[1:] != seen[:-1]]) if len(seen) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[starts, len(seen)])
    several = np.flatnonzero(counts > 1)
    top = several[np.argsort(-counts[several], kind="stable")[:SLICE_COMMON]]
    return seen[starts[top]].view(np.int64).tolist()


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text; the first of a slice also carries the tokens that several classes of the slice have."""
    for batch in sliced(batches):
        tokens, ends = shingle_sets(batch.column("text"), WIDTH)
        lo, hi = fingerprints(tokens, ends)
        common = pa.array([_common_here(tokens, ends, lo)] + [None] * (len(lo) - 1), pa.list_(pa.int64()))
        cols = [batch.column("doc_id"), batch.column("text_hash"), longs(np.diff(ends)), longs(lo), longs(hi), common]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "n_shingles", "lo", "hi", "common"])


MEMBERS = "doc_id long, text_hash long, n_shingles long, lo long, hi long, common array<long>"


@dataclass
class Corpus:
    """``members``: a row for each text with its fingerprint; ``classes``: a row for each set that is not empty, with
    the number of its texts and the least doc_id among them; rows without a doc_id are in no class.

    ``common`` are tokens of which each is proven to be in several classes; ``copied`` are (lo, least doc_id) of much
    copied classes. Both lists are bounded and only save work: results don't depend on what is in them.
    """

    members: DataFrame
    classes: DataFrame
    common: np.ndarray
    copied: tuple[np.ndarray, np.ndarray]


def corpus(texts: DataFrame) -> Corpus:
    """The members and classes of ``texts`` (doc_id, text_hash, text)."""
    small_batches(texts.sparkSession)
    rows = texts.select("doc_id", "text_hash", "text").mapInArrow(_members, MEMBERS)
    members = materialise(rows, "members")
    named = members.where("n_shingles > 0 AND doc_id IS NOT NULL")
    least = named.groupBy("lo", "hi", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    classes = materialise(least, "classes")
    by_slices = members.select(F.explode("common").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    common = [r.token for r in by_slices.orderBy(F.desc("n"), "token").limit(COMMON).select("token").collect()]
    copied = classes.where(F.col("n") > COPIES).orderBy(F.desc("n"), "lo").limit(COPIED).select("lo", "doc_id").collect()
    copied.sort(key=lambda r: r.lo)
    arrays = np.array([r.lo for r in copied], np.int64), np.array([r.doc_id for r in copied], np.int64)
    return Corpus(members.drop("common"), classes, np.sort(np.array(common, np.int64).view(np.uint64)), arrays)


def _among(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of ``x`` is in the sorted ``known``, and where."""
    if not len(known):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x, at


def _first_tokens(common: np.ndarray, copied: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(token, lo, n) of each set's first tokens, combined inside a slice before they are shuffled.

        Tokens stand in the order of their hashes, but common ones after all others. Those that come first all the same
        are counted here (n = how many), as others are known to have them. Of the rest, a token of one class here comes
        as it is (n = 0); one of several classes comes once, as evidence (n = -1), and its classes count it like a
        common one. So no token is shuffled more than once for each slice, and those of nearly all slices aren't at
        all. Of a much copied class only the copies with its least doc_id speak.
        """
        for batch in sliced(batches):
            tokens, ends = shingle_sets(batch.column("text"), WIDTH)
            sizes = np.diff(ends)
            lo = fingerprints(tokens, ends)[0]
            doc_id = batch.column("doc_id").to_numpy()
            often, at = _among(lo, copied[0])
            speaks = ~often
            speaks[often] = doc_id[often] == copied[1][at[often]]
            speaks[speaks] = _first_of_class(lo[speaks])
            take = np.where(speaks, sizes - (-(-NUM * sizes // DEN)) + (-(-SLACK * sizes // 100)), 0)
            own = np.repeat(np.arange(len(sizes)), sizes)
            known = _among(tokens, common)[0]
            order = np.argsort(own * 2 + known, kind="stable")
            use = order[np.arange(len(tokens)) - ends[own] < take[own]]
            token, doc, known = tokens[use], own[use], known[use]
            counts = np.bincount(doc[known], minlength=len(sizes))
            token, doc = token[~known], doc[~known]
            order = np.argsort(token, kind="stable")
            token, doc = token[order], doc[order]
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
            lens = np.diff(np.r_[starts, len(token)])
            many = lens > 1
            counts += np.bincount(doc[np.repeat(many, lens)], minlength=len(sizes))
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    longs(np.concatenate([token[starts], mixed(lo[seen].view(np.uint64))])),
                    longs(np.concatenate([lo[doc[starts]], lo[seen]])),
                    longs(np.concatenate([np.where(many, -1, 0), counts[seen]])),
                ],
                ["token", "lo", "n"],
            )

    return run


def survivors(texts: DataFrame, found: Corpus) -> DataFrame:
    """Classes that may have a link: cid, lo, hi, n_shingles, doc_id (of one document with that set), mass.

    In any order of all tokens, two linked sets share a known number of their first ones. A class with fewer of those
    that any other class has there can have no link. The window meets a token at most once for each slice of text, and
    not at all those that are in very many slices.
    """
    by_token = Window.partitionBy("token")
    rows = texts.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(
        _first_tokens(found.common, found.copied), "token long, lo long, n long"
    )
    several = F.min("lo").over(by_token) < F.max("lo").over(by_token)
    judged = rows.select("lo", "n", several.alias("several"), F.min("n").over(by_token).alias("evidence"))
    shared = (F.col("n") == 0) & (F.col("several") | (F.col("evidence") < 0))
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    hit = F.when(F.col("n") > 0, F.col("n")).when(shared, one).otherwise(none)
    counts = judged.groupBy("lo").agg(F.sum(hit).alias("hits")).where("hits > 0")
    # a partner may be smaller by NUM / DEN, and so may its extra share
    needed = F.greatest(one, F.ceil(F.col("n_shingles") * (SLACK * NUM) / (100.0 * DEN) - 1e-9))
    left = found.classes.join(counts, "lo").where(F.col("hits") >= needed)
    # how much of a class others have: greatest for the original of a group of edited copies
    left = left.select("lo", "hi", "n_shingles", "doc_id", F.round(F.col("hits") / F.col("n_shingles"), 3).alias("mass"))
    return materialise(left.withColumn("cid", F.monotonically_increasing_id()), "survivors")


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        tokens, ends = shingle_sets(batch.column("text"), WIDTH)
        lo, hi = fingerprints(tokens, ends)
        same = np.flatnonzero((lo == batch.column("lo").to_numpy()) & (hi == batch.column("hi").to_numpy()))
        own = [tokens[ends[i] : ends[i + 1]] for i in same]
        cid, mass = (batch.column(c).take(pa.array(same)) for c in ("cid", "mass"))
        blobs, sketches = (pa.array([f(x) for x in own], pa.binary()) for f in (np.ndarray.tobytes, sketch))
        short = pa.array([short_bands(x) for x in own], pa.int64())
        cols = [cid, longs(np.diff(ends)[same]), mass, blobs, sketches, short]
        yield pa.RecordBatch.from_arrays(cols, ["cid", "size", "mass", "tokens", "sketch", "short"])


SETS = "cid long, size long, mass double, tokens binary, sketch binary, short long"


def class_sets(texts: DataFrame, left: DataFrame) -> DataFrame:
    """The sets of the classes ``left``: cid, size, mass, tokens, sketch and short (``short_bands``).

    They are bucketed by cid: pairs come to them, and the tokens of all sets are shuffled this once only. Spark reads a
    bucketed table in place if it has at least as many buckets as a shuffle has partitions. The classes grow with the
    corpus, so they are hashed and not broadcast, and the texts need no sort.
    """
    n_bytes = left.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0] * 8
    buckets = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))
    chosen = left.select("doc_id", "cid", "lo", "hi", "mass").hint("shuffle_hash")
    rows = texts.select("doc_id", "text").join(chosen, "doc_id")
    sets = rows.select("text", "cid", "lo", "hi", "mass").mapInArrow(_sets, SETS)
    return materialise_buckets(sets.repartition(buckets, "cid").dropDuplicates(["cid"]), "sets", "cid", buckets)
