"""Exact similarity join on word shingles by universe partition and pigeonhole.

A document's set is its distinct five-word shingles, as 64-bit hashes. Equal sets form one class. Then:

1. *Elimination.* In the order of hashes, two linked sets share a known number of their first tokens. Classes with too
   few tokens there that any other class has can have no link and leave; most documents do.
2. *Segments.* For a band of sizes the universe of tokens is cut into segments by hash. Two linked sets differ in at
   most H tokens, so of any H + 1 segments that are not empty one is equal in both. All segments are indexed by their
   content.
3. *Allocation.* A class must probe H + 1 segments. Those that no other class has cost nothing; of the others it takes
   the ones with the fewest members. Members of a segment first meet only a hub each; a segment whose members are then
   in one component needs no further comparison and costs nothing either. Where a class would still have to probe
   crowded segments it chooses again, and segments of several tokens with a one-deletion neighbourhood count twice:
   each of them bears one difference.
4. *Verification.* Candidates are compared exactly: pairs with hubs, then all members of different components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.bytesets import mixed
from evalspark.llm.graph import components
from evalspark.llm.shingles import DEN, NUM, SKETCH, class_sets, corpus, longs, segments_of, sliced, survivors, views
from evalspark.plans.scratch import discard, materialise

#: Least hashes by which classes meet before segments are made.
FIRST_KEYS = 8
#: Segments of more members than this are compared by families, in blocks of about BLOCK members and COLUMNS tokens.
CROWDED, BLOCK, COLUMNS = 32, 512, 4096

def _differing(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = (np.frombuffer(b"".join(v.as_py() for v in c), np.uint8).reshape(-1, SKETCH // 8) for c in (a, b))
    return pa.array(np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64))


def _min_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least of each set's tokens in FIRST_KEYS scramblings."""
    salts = mixed(np.arange(1, FIRST_KEYS + 1, dtype=np.uint64))
    for batch in sliced(batches, "tokens"):
        blobs = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("tokens")]
        if blobs:
            least = np.array([mixed(blob ^ salt).min() for blob in blobs for salt in salts]) + np.tile(salts, len(blobs))
            place = pa.array(np.repeat(np.arange(len(blobs)), FIRST_KEYS))
            cols = [longs(least), *(batch.column(c).take(place) for c in ("cid", "size", "mass"))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "cid", "size", "mass"])


def first_links(sets: DataFrame) -> DataFrame:
    """Links of classes with the class of the greatest mass of those that share a least hash.

    Most links are found so, and cheaply. What matters for the result comes after: segments, which now need to be
    searched only where they are in several components.
    """
    rows = sets.select("tokens", "cid", "size", "mass").mapInArrow(
        _min_hashes, "key long, cid long, size long, mass double"
    )
    named = rows.withColumns({"comp": F.col("cid"), "probe": F.lit(True)})
    return materialise(verified(hub_pairs(named), sets), "links")


def _segment_rows(deletions: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, cid, size, band, gap, seg, gone, comp, mass): the content of each segment.

        With deletions also without each of its tokens (gone = 1), and whether the segment may count twice (it has
        several tokens) and whether the class chooses again in that band.
        """
        for batch in sliced(batches, "tokens"):
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            rows, again, twice = [], [], []
            masks = batch.column("bands").to_pylist() if deletions else [0] * len(batch)
            of_row = zip(batch.column("cid").to_pylist(), batch.column("tokens"), masks)
            for at_row, (cid, blob, mask) in enumerate(of_row):
                tokens = np.frombuffer(blob.as_buffer(), np.uint64)
                for band, differ in views(len(tokens)):
                    ordered, starts = segments_of(tokens, band)
                    lens = np.diff(np.r_[starts, len(ordered)])
                    piece = mixed(ordered + np.uint64(band))
                    sums = np.add.reduceat(piece, starts)
                    key, seg, gone = sums, np.arange(len(starts)), np.zeros(len(starts), np.int64)
                    if deletions:
                        long_ = np.repeat(lens > 1, lens)
                        of = np.repeat(np.arange(len(starts)), lens)[long_]
                        key, seg = np.concatenate([key, sums[of] - piece[long_]]), np.concatenate([seg, of])
                        gone = np.concatenate([gone, np.ones(len(of), np.int64)])
                    n = len(key)
                    rows.append(np.full(n, at_row))
                    again.append(np.full(n, bool(mask >> band & 1)))
                    twice.append(lens[seg] > 1)
                    whole = (cid, len(tokens), band, differ + 1 - len(starts))
                    for at, x in enumerate((mixed(key), *(np.full(n, v) for v in whole), seg, gone)):
                        cols[at].append(x)
            if not rows:
                continue
            place = pa.array(np.concatenate(rows))
            arrays = [longs(np.concatenate(c)) for c in cols] + [batch.column(c).take(place) for c in ("comp", "mass")]
            names = ["key", "cid", "size", "band", "gap", "seg", "gone", "comp", "mass"]
            if deletions:
                arrays += [pa.array(np.concatenate(twice)), pa.array(np.concatenate(again))]
                names += ["twice", "hard"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


SEGMENT_ROWS = "key long, cid long, size long, band long, gap long, seg long, gone long, comp long, mass double"


def with_components(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the component of each class by the links so far: its own id without one."""
    joined = rows.join(components(links), F.col("cid") == F.col("node"), "left")
    return joined.withColumn("comp", F.coalesce("comp", "cid")).drop("node")


def plain_allocation(sets: DataFrame) -> DataFrame:
    """Rows (key, cid, size, band, probe, crowd, mass, comp) of segments that classes of several components share.

    ``sets`` has the component of each class. Segments whose members are all in one component need no search and are
    free. ``gap`` is what a class must probe beyond its segments: H + 1 less their number. With c segments that aren't
    free it must probe gap + c of those, and takes the least crowded. A class with fewer than H + 1 segments probes all
    it has here and meets its whole bands besides (``whole_bands``).
    """
    found = sets.select("cid", "tokens", "comp", "mass").mapInArrow(_segment_rows(False), SEGMENT_ROWS)
    rows = found.drop("seg", "gone")
    crowds = rows.groupBy("key").agg(F.count(F.lit(1)).alias("crowd"), F.min("comp").alias("a"), F.max("comp").alias("b"))
    shared = rows.join(crowds.where("a < b").select("key", "crowd"), "key")
    own = Window.partitionBy("cid", "band")
    rank = F.row_number().over(own.orderBy("crowd", "key"))
    probe = rank <= F.col("gap") + F.count(F.lit(1)).over(own)
    return materialise(shared.select("key", "cid", "size", "band", probe.alias("probe"), "crowd", "mass", "comp"), "segments")


def whole_bands(sets: DataFrame) -> DataFrame | None:
    """Each band in which some class has fewer than H + 1 segments, as one segment that all its classes have and the
    short ones probe: (key, cid, size, probe, crowd, mass). None where no class is short.

    Hashing fills far more segments than that (by 7 standard deviations at the least size), so there normally is none.
    """
    mask = sets.agg(F.bit_or("short")).first()[0]
    if not mask:
        return None
    high = F.length(F.bin("size")).cast("long") - 1
    lower = F.ceil(F.col("size") * NUM / DEN) < F.pow(F.lit(2.0), high)
    in_bands = F.when(lower, F.array(high, high - 1)).otherwise(F.array(high))
    rows = sets.select("cid", "size", "short", F.explode(in_bands).alias("band"))
    bit = F.expr("shiftleft(1L, cast(band as int))")
    rows = rows.where(bit.bitwiseAND(F.lit(mask)) != 0)
    crowds = rows.groupBy("band").agg(F.count(F.lit(1)).alias("crowd"))
    key, probe = F.xxhash64("band", F.lit("whole band")).alias("key"), (bit.bitwiseAND(F.col("short")) != 0).alias("probe")
    # a row for each band: 63 at most
    return rows.join(F.broadcast(crowds), "band").select(
        key, "cid", "size", probe, "crowd", F.lit(0.0).alias("mass")
    )


def choosing_again(rows: DataFrame) -> DataFrame:
    """The rows of segments that must still be searched, with ``hard``: the class chooses again in that band.

    Those are classes that would probe a crowded segment. Classes of which more segments are crowded than they must
    probe are edited copies: what the edits changed lies one token from the crowd as well, so they have nothing cheaper
    to choose and stay as they are.
    """
    live = rows.join(unsettled(rows).select("key"), "key")
    own = Window.partitionBy("cid", "band")
    crowded = F.count_if(F.col("crowd") > CROWDED).over(own)
    probes = F.count_if(F.col("probe") & (F.col("crowd") > CROWDED)).over(own)
    few = crowded <= F.col("size") * (2 * (DEN - NUM)) / (DEN + NUM)
    return materialise(live.withColumn("hard", (probes > 0) & few), "unsettled")


def neighbourhoods(live: DataFrame, sets: DataFrame) -> DataFrame:
    """Segments of the zone by content and by content less a token (``_segment_rows``).

    The zone are the members of segments that a class which chooses again probed before: all its partners in other
    components are among them.
    """
    met_before = live.where("probe AND hard").select("key").distinct()
    bit = F.when(F.col("hard"), F.expr("shiftleft(1L, cast(band as int))")).otherwise(F.lit(0).cast("long"))
    zone = live.join(met_before, "key", "left_semi").groupBy("cid").agg(
        F.max("comp").alias("comp"), F.max("mass").alias("mass"), F.bit_or(bit).alias("bands")
    )
    schema = SEGMENT_ROWS + ", twice boolean, hard boolean"
    rows = sets.select("cid", "tokens").join(zone, "cid").mapInArrow(_segment_rows(True), schema)
    return materialise(rows, "neighbourhoods")


def neighbourhood_members(near: DataFrame) -> DataFrame:
    """(key, n_full, n_gone) of contents that several components have: segments with it, and with a token more."""
    counted = near.groupBy("key").agg(
        F.count_if(F.col("gone") == 0).alias("n_full"), F.count_if(F.col("gone") == 1).alias("n_gone"),
        F.min("comp").alias("a"), F.max("comp").alias("b"),
    )
    return materialise(counted.where("a < b").select("key", "n_full", "n_gone"), "neighbourhood-members")


def second_choice(live: DataFrame, near: DataFrame, members: DataFrame) -> DataFrame:
    """(cid, band, seg, key, again): the H + 1 cheapest counts of each class that chooses again.

    A segment probed for equal content bears no difference and counts once; probed also for content that differs by one
    token (``again`` = 1) it bears one and counts twice; a segment of one token never does, as a partner that lacks the
    token has nothing there to be found by. The price is the number of members that the probe would meet, none where
    they are all in one component.
    """
    chooser = near.where("hard")
    at, none = ["cid", "band", "seg", "gap", "twice"], F.lit(0).cast("long")
    crowds = live.where("hard").select("cid", "band", "key", (F.col("crowd") - 1).alias("others"))
    # what meets no other component is free: only the rest is joined with its members
    plain = chooser.where("gone = 0").join(crowds, ["cid", "band", "key"], "left")
    free = plain.select(*at, "key", F.coalesce("others", none).alias("once"), none.alias("more"))
    full = F.col("gone") == 0
    equal, meets = F.when(full, F.col("n_full") - 1).otherwise(0), F.when(full, F.col("n_gone")).otherwise(F.col("n_full"))
    met = chooser.join(members, "key")
    priced = met.select(*at, F.when(full, F.col("key")).alias("key"), equal.alias("once"), meets.alias("more"))
    prices = free.unionByName(priced).groupBy(*at).agg(
        F.max("key").alias("key"), F.max("once").alias("once"), F.sum("more").alias("more")
    )
    # the second count never costs less than the first, so it is never taken alone
    both = F.when(F.col("twice"), F.array(F.col("once"), F.greatest("once", "more"))).otherwise(F.array("once"))
    counts = prices.select("cid", "band", "seg", "key", "gap", F.posexplode(both).alias("again", "price"))
    own = Window.partitionBy("cid", "band")
    rank = F.row_number().over(own.orderBy("price", "again", "key"))
    segments = F.count_if(F.col("again") == 0).over(own)
    chosen = counts.withColumn("taken", rank <= F.col("gap") + segments).where("taken")
    return materialise(chosen.select("cid", "band", "seg", "key", "again"), "allocation")


SEARCHED = ["key", "cid", "size", "probe", "crowd", "mass", "comp"]


def cheaper_allocation(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (key, cid, size, probe, crowd, mass, comp) of the segments that are still to be searched.

    ``rows`` are labelled with the components found through hubs. A segment whose members are all in one component
    needs no search. Classes that would probe a crowded one of the others choose again, now with one-deletion
    neighbourhoods, which get keys of their own that hold contents and contents less a token alike. What they choose
    is searched in three parts: segments that were searched anyway, segments that nobody probed before (the zone has
    all members that are to be met there), and neighbourhoods.
    """
    live = choosing_again(rows)
    near = neighbourhoods(live, sets)
    members = neighbourhood_members(near)
    chosen = second_choice(live, near, members)
    first = chosen.where("again = 0").select("cid", "band", "key", F.lit(True).alias("first"))
    second = chosen.where("again = 1").select("cid", "band", "seg", F.lit(True).alias("second"))
    no = F.lit(False)
    kept = live.join(first, ["cid", "band", "key"], "left")
    kept = kept.withColumn("probe", F.when(F.col("hard"), F.coalesce("first", no)).otherwise(F.col("probe")))
    unseen = first.select("key").distinct().join(live.select("key").distinct(), "key", "left_anti")
    priced_at = members.where("n_full > 1").join(unseen, "key").select("key", F.col("n_full").alias("crowd"))
    brought = near.where("gone = 0").join(priced_at, "key").join(first, ["cid", "band", "key"], "left")
    brought = brought.withColumn("probe", F.coalesce("first", no))
    probed = near.where("hard").join(second.drop("second"), ["cid", "band", "seg"], "left_semi").select("key").distinct()
    met = members.join(probed, "key").select("key", (F.col("n_full") + F.col("n_gone")).alias("crowd"))
    around = near.join(met, "key").join(second, ["cid", "band", "seg"], "left")
    around = around.withColumns({"probe": F.coalesce("second", no), "key": F.xxhash64("key", F.lit("neighbourhood"))})
    parts = kept.select(*SEARCHED).unionByName(brought.select(*SEARCHED)).unionByName(around.select(*SEARCHED))
    out = materialise(parts, "allocated")
    discard(live, near, members, chosen)
    return out


def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    def one(x, y) -> int:
        x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
        at = np.searchsorted(y, x)
        return int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0

    return pa.array([one(x, y) for x, y in zip(a, b)], pa.int64())


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (x, y) of classes that link, by exact comparison.

    Pairs whose sketches differ in more bits than linked sets may in tokens are out before any tokens are moved.
    """

    def with_sets(pairs: DataFrame, *names: str) -> DataFrame:
        for side, at in (("1", "x"), ("2", "y")):
            own = sets.select(*[F.col(n).alias(n + side) for n in ("cid", *names)])
            pairs = pairs.join(own, F.col(at) == F.col("cid" + side)).drop("cid" + side)
        return pairs

    may = F.floor((F.col("size1") + F.col("size2")) * (DEN - NUM) / (DEN + NUM) + 1e-9)
    differing = F.arrow_udf(_differing, "bigint")(F.col("sketch1"), F.col("sketch2"))
    close = with_sets(pairs, "size", "sketch").where(differing <= may).select("x", "y", "size1", "size2")
    both = F.arrow_udf(_common, "bigint")(F.col("tokens1"), F.col("tokens2"))
    joined = with_sets(materialise(close, "close-pairs"), "tokens").select("x", "y", "size1", "size2", both.alias("both"))
    return joined.where(DEN * F.col("both") >= NUM * (F.col("size1") + F.col("size2") - F.col("both"))).select("x", "y")


def _near(a: Column, b: Column) -> Column:
    return DEN * F.least(a, b) >= NUM * F.greatest(a, b)


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def hub_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of a probing member of a segment with the segment's hub, if they are in different components.

    The hub is the member of the greatest mass, so that a group of edited copies meets the text it was made from.
    """
    hub = F.max_by(F.struct("cid", "size", "comp"), F.struct("mass", "cid")).alias("hub")
    met = rows.where("probe").join(rows.groupBy("key").agg(hub), "key")
    apart = (F.col("comp") != F.col("hub.comp")) & _near(F.col("size"), F.col("hub.size"))
    return _pairs(met.where(apart).select(F.col("cid").alias("x"), F.col("hub.cid").alias("y")))


def unsettled(rows: DataFrame) -> DataFrame:
    """(key, family) of segments that are probed and have members in several components; ``family`` is the component
    of the member with the greatest mass."""
    by_key = rows.groupBy("key").agg(
        F.min("comp").alias("a"), F.max("comp").alias("b"), F.bool_or("probe").alias("p"),
        F.max(F.struct("mass", "comp")).alias("heaviest"),
    )
    return by_key.where("a < b AND p").select("key", F.col("heaviest.comp").alias("family"))


def open_pairs(rows: DataFrame) -> DataFrame:
    """In segments of at most CROWDED members: pairs in different components of which the larger (by size, then id)
    probes the segment.

    That is enough: what a class probes is chosen to meet every partner of at most its own size.
    """
    few = rows.where(F.col("crowd") <= CROWDED).join(unsettled(rows).select("key"), "key")
    cols = lambda s: [F.col(c).alias(f"{c}{s}") for c in ("cid", "size", "comp")]
    order = F.struct("size2", "cid2") < F.struct("size1", "cid1")
    differ = (F.col("comp1") != F.col("comp2")) & order & _near(F.col("size1"), F.col("size2"))
    met = few.where("probe").select("key", *cols(1)).join(few.select("key", *cols(2)), "key").where(differ)
    return _pairs(met.select(F.col("cid1").alias("x"), F.col("cid2").alias("y")))


def _block_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between two blocks of a family, by products of 0/1 matrices over the tokens that both blocks have.

    Of the links of a class with the members of one component the first is returned.
    """
    x, y, nx, ny, cx, cy = (t.column(c).to_numpy() for c in ("cid", "size", "comp") for t in (left, right))
    empty = pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64())})
    if not len(x) or not len(y):
        return empty
    tokens = [[np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("tokens")] for t in (left, right)]
    flat_ = [np.concatenate(t) for t in tokens]
    owner = [np.repeat(np.arange(len(t)), [len(v) for v in t]) for t in tokens]
    shared = np.intersect1d(*flat_)
    both = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(shared), COLUMNS):
        part = shared[at : at + COLUMNS]
        hot = []
        for t, o, n in zip(flat_, owner, (len(x), len(y))):
            place = np.minimum(np.searchsorted(part, t), len(part) - 1)
            hit = part[place] == t
            m = np.zeros((n, len(part)), np.float32)
            m[o[hit], place[hit]] = 1
            hot.append(m)
        both += hot[0] @ hot[1].T  # whole numbers below 2 ** 24, so exact
    smaller = (ny[None, :] < nx[:, None]) | (ny[None, :] == nx[:, None]) & (y[None, :] < x[:, None])
    ok = (DEN * both.astype(np.int64) >= NUM * (nx[:, None] + ny[None, :] - both.astype(np.int64))) & (cx[:, None] != cy[None, :]) & smaller
    i, j = np.nonzero(ok)
    first = np.unique(np.stack([x[i], cy[j]], 1), axis=0, return_index=True)[1] if len(i) else i
    return pa.table({"x": pa.array(np.minimum(x[i], y[j])[first]), "y": pa.array(np.maximum(x[i], y[j])[first])})


def family_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components in segments of more than CROWDED members, without making a row for each pair.

    Segments whose heaviest member is in one component form a family. Pairs across components have a member outside
    the family's largest component, so the probing members out of it are compared with all members, and its probing
    members with those out of it: block against block, so that a task holds two blocks, and only links come out.
    """
    crowded = rows.where(F.col("crowd") > CROWDED).join(unsettled(rows), "key")
    by_class = crowded.groupBy("family", "cid", "size", "comp").agg(F.bool_or("probe").alias("probe"))
    members = materialise(by_class, "families")
    parts = members.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")
    )

    def blocks_of(n: Column) -> Column:
        return F.ceil(n / BLOCK).cast("int")

    def block(n: Column) -> Column:
        return F.pmod(F.xxhash64("cid"), n).cast("int")

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    n_all, n_out, out = F.col("n_all"), F.col("n_out"), F.col("out")
    blocks = parts.where("most < all").select(
        "family", "main", blocks_of(F.col("all")).alias("n_all"), blocks_of(F.col("all") - F.col("most")).alias("n_out")
    )
    placed = members.join(blocks, "family").withColumn("out", F.col("comp") != F.col("main"))
    placed = placed.join(sets.select("cid", "tokens"), "cid")
    at = ["family", "kind", "i", "j"]
    cols = [*at, "cid", "size", "comp", "tokens"]
    mine, other = F.when(out, n_out).otherwise(n_all), F.when(out, n_all).otherwise(n_out)
    kind = F.when(out, 0).otherwise(1)
    left = placed.where("probe").withColumns({"kind": kind, "i": block(mine)}).withColumn("j", every(other)).select(*cols)
    against_all = placed.withColumns({"kind": F.lit(0), "j": block(n_all)}).withColumn("i", every(n_out))
    against_out = placed.where(out).withColumns({"kind": F.lit(1), "j": block(n_out)}).withColumn("i", every(n_all))
    right = against_all.select(*cols).unionByName(against_out.select(*cols))
    # renamed columns are new ones, since both sides come from the same table
    return left.groupBy(*at).cogroup(right.toDF(*cols).groupBy(*at)).applyInArrow(_block_links, "x long, y long")


def linked_classes(sets: DataFrame) -> DataFrame:
    """Links (x, y) that connect the same components as all links between classes do."""
    links = first_links(sets)
    rows = plain_allocation(with_components(sets, links))
    before, links = links, materialise(links.unionByName(verified(hub_pairs(rows), sets)), "links")
    last, rows = rows, materialise(with_components(rows.drop("comp"), links), "labelled")
    discard(before, last)
    left = cheaper_allocation(rows, sets)
    whole = whole_bands(sets)
    if whole is not None:
        left = left.unionByName(materialise(with_components(whole, links), "whole-bands"))
    found = verified(open_pairs(left), sets).unionByName(family_links(left, sets))
    out = materialise(links.unionByName(found), "links")
    discard(rows, left, links)
    return out


def text_hash(text: Column) -> Column:
    """Tells apart the texts of one doc_id."""
    return F.xxhash64(text)


def _grouped(docs: DataFrame) -> DataFrame:
    """The rows of ``near_duplicates`` with text_hash, the set's fingerprint (lo, hi) and comp: its component's number,
    null where its class has no link."""
    texts = docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash"))
    found = corpus(texts)
    left = survivors(texts, found)
    sets = class_sets(texts, left)
    comps = components(linked_classes(sets))
    discard(sets)
    classes = left.join(comps, F.col("cid") == F.col("node")).select("lo", "hi", "comp", F.col("doc_id").alias("rep"))
    least = classes.groupBy("comp").agg(F.min("rep").alias("least"))
    by_class = classes.join(least, "comp").select("lo", "hi", "least", "comp")
    root = F.coalesce("least", "doc_id").alias("root")
    roots = found.classes.join(by_class, ["lo", "hi"], "left").select("lo", "hi", "comp", root)
    named = found.members.join(roots, ["lo", "hi"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("root"))
    component = F.when(F.col("doc_id").isNull(), None).otherwise(own).cast("long").alias("component_id")
    return named.select("doc_id", "text_hash", "n_shingles", "lo", "hi", "comp", component)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, or its own).

    Texts without words (null, empty or blank) have an empty set and link with nothing. Equal sets link, so copies and
    repeated rows share a component. Rows without a doc_id are counted but not linked: their component is null. If one
    doc_id has several texts, each row belongs to its own text's component. An empty table gives an empty result;
    other columns are ignored. Sets are compared by 64-bit token hashes and equal sets found by 128 bits of them.
    """
    return _grouped(docs).select("doc_id", "n_shingles", "component_id")


def leaders(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of one text of each component, that with the smallest doc_id, and of each text without words.

    Components are told apart by themselves and not by their component_id, which two of them share where one doc_id
    has several texts. Rows without a doc_id are left out.
    """
    rows = _grouped(docs).where("doc_id IS NOT NULL")
    linked = F.col("comp").isNotNull()
    group = F.struct("comp", F.when(~linked, F.col("lo")).alias("lo"), F.when(~linked, F.col("hi")).alias("hi")).alias("component")
    first = rows.where("n_shingles > 0").groupBy(group).agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
    return first.select("least.doc_id", "least.text_hash").unionByName(rows.where("n_shingles = 0").select("doc_id", "text_hash").distinct())
