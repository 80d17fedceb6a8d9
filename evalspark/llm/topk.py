"""Exact top-k inner-product search by ball trees.

Candidates are dealt to shards; each shard builds one ball tree. A query first searches one shard, and its k-th score
there is shared with all other shards, where it prunes from the start. Inside a shard a query first goes down to its
best leaf; with the k-th score from there branches are bounded at inner nodes, and the leaves that are left are visited
in the order of their inner-product upper bound, until the next bound is below the query's current k-th score.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.plans.scratch import materialise

LEAF = 128
#: The most bytes of vectors in a shard, which bounds a task's memory to a few times as much; smaller tables get a shard
#: for each core.
SHARD_BYTES = 1 << 27
#: Queries that search a tree together.
QUERY_BLOCK = 512
_NONE, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Whole numbers below this are exact as floats, whose products are faster.
EXACT = 2.0**53
RESULT = "query_id long, vec_id long, score long"


@dataclass
class BallTree:
    """``points`` are whole numbers, as floats where all products of them are exact; ``peak`` is the greatest of them."""

    ids: np.ndarray
    points: np.ndarray
    peak: float
    centers: np.ndarray
    radii: np.ndarray
    children: list[tuple[int, int] | None]
    spans: list[tuple[int, int]]


def build(ids: np.ndarray, rows: np.ndarray) -> BallTree:
    """Halve along the widest dimension until leaves are small; equal points are halved as well."""
    order = np.argsort(ids, kind="stable")
    points = rows.astype(float)
    centers, radii, children, spans = [], [], [], []
    stack = [(0, len(ids), -1, 0)]
    while stack:
        lo, hi, parent, side = stack.pop()
        own = points[order[lo:hi]]
        center = own.mean(axis=0)
        centers.append(center)
        radii.append(math.sqrt(((own - center) ** 2).sum(axis=1).max()))
        children.append(None)
        spans.append((lo, hi))
        me = len(centers) - 1
        if parent >= 0:
            children[parent] = (me, -1) if side == 0 else (children[parent][0], me)
        if hi - lo > LEAF and own.shape[1]:
            widest = int(np.ptp(own, axis=0).argmax())
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, widest], mid)]
            stack += [(lo + mid, hi, me, 1), (lo, lo + mid, me, 0)]
    peak = float(np.abs(rows).max(initial=0))
    kept = points if peak**2 * max(1, rows.shape[1]) < EXACT else rows
    return BallTree(ids[order], kept[order], peak, np.array(centers), np.array(radii), children, spans)


@dataclass
class _Asked:
    """Queries that search a tree together, with the best found so far."""

    ids: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    floors: np.ndarray
    best: np.ndarray
    best_id: np.ndarray

    def bars(self, at: np.ndarray) -> np.ndarray:
        """What a score must reach to matter: the current k-th score or the one shared from another shard."""
        return np.maximum(self.best[at, -1], self.floors[at]).astype(float)


def _bounds(tree: BallTree, asked: _Asked, node: int, at: np.ndarray) -> np.ndarray:
    """Upper bounds on the inner products of the queries ``at`` with the points below a node."""
    own = asked.vectors[at] @ tree.centers[node] + asked.norms[at] * tree.radii[node]
    return own + 1e-7 * (1 + np.abs(own))


def _visit(tree: BallTree, asked: _Asked, leaf: int, at: np.ndarray, exact: bool) -> None:
    """Merge the scores of a leaf's points into the best of the queries ``at``."""
    lo, hi = tree.spans[leaf]
    points, vectors = tree.points[lo:hi], asked.vectors[at]
    if exact:
        scores = np.rint(vectors @ points.T).astype(np.int64)
    else:
        scores = vectors.astype(np.int64) @ points.astype(np.int64).T
    found = np.broadcast_to(tree.ids[lo:hi], scores.shape)
    scores = np.where(found == asked.ids[at][:, None], _NONE, scores)
    all_scores = np.concatenate([asked.best[at], scores], axis=1)
    all_ids = np.concatenate([asked.best_id[at], found], axis=1)
    all_ids = np.where(all_scores == _NONE, _LAST, all_ids)
    # the order by score downwards, then by id: ~x reverses a long without overflow
    top = np.lexsort((all_ids, ~all_scores), axis=1)[:, : asked.best.shape[1]]
    asked.best[at], asked.best_id[at] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)


def _by_node(nodes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(nodes, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(nodes[order])) + 1):
        if len(group):
            yield int(nodes[group[0]]), group


def _first_leaves(tree: BallTree, asked: _Asked) -> np.ndarray:
    """The leaf that each query reaches by taking the child with the greater bound."""
    at = np.zeros(len(asked.ids), np.int64)
    while True:
        inner = [(node, group) for node, group in _by_node(at) if tree.children[node] is not None]
        if not inner:
            return at
        for node, group in inner:
            left, right = tree.children[node]
            at[group] = np.where(_bounds(tree, asked, left, group) >= _bounds(tree, asked, right, group), left, right)


def _open_leaves(tree: BallTree, asked: _Asked, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, leaf, bound) that branch and bound leaves open: a branch goes where its bound misses a query's bar."""
    every = np.arange(len(asked.ids))
    out, stack = [], [(0, every, np.full(len(every), np.inf))]
    while stack:
        node, at, above = stack.pop()
        bound = np.minimum(above, _bounds(tree, asked, node, at))
        on = bound >= asked.bars(at)
        at, bound = at[on], bound[on]
        if tree.children[node] is None:
            new = seen[at] != node
            out.append((at[new], np.full(int(new.sum()), node), bound[new]))
        elif len(at):
            stack += [(child, at, bound) for child in tree.children[node]]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (every[:0], every[:0], np.zeros(0))


def search(
    tree: BallTree, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The best (score, id) of each query, at most ``k``; scores below a query's floor may be missing."""
    peak = float(np.abs(queries).max(initial=0))
    exact = tree.points.dtype == float and tree.peak * peak * max(1, queries.shape[1]) < EXACT
    vectors = queries.astype(float) if exact else queries
    norms = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    best = np.full((len(ids), k), _NONE, np.int64)
    asked = _Asked(ids, vectors, norms, floors, best, np.full((len(ids), k), _LAST, np.int64))
    seen = _first_leaves(tree, asked)
    for leaf, group in _by_node(seen):
        _visit(tree, asked, leaf, group, exact)
    query, leaf, bound = _open_leaves(tree, asked, seen)
    # each query's leaves by falling bound, then all queries' first ones, second ones, ...
    order = np.lexsort((leaf, -bound, query))
    query, leaf, bound = query[order], leaf[order], bound[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    order = np.argsort(place, kind="stable")
    for step in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
        step = step[bound[step] >= asked.bars(query[step])]
        for node, group in _by_node(leaf[step]):
            _visit(tree, asked, node, query[step][group], exact)
    return asked.best, asked.best_id


def _searching(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard, candidates before queries: one tree at a time is in memory."""
        shard, parts, tree = None, [], None
        for batch in batches:
            shards, kinds, ids = (batch.column(c).to_numpy() for c in ("shard", "kind", "id"))
            floors = batch.column("floor").fill_null(int(_NONE)).to_numpy()
            vectors = batch.column("vec")
            keys = shards * 2 + kinds
            for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1):
                if not len(part):
                    continue
                a, b = int(part[0]), int(part[-1]) + 1
                if shards[a] != shard:
                    shard, parts, tree = shards[a], [], None
                width = len(vectors[a].as_py())
                rows = vectors.slice(a, b - a).flatten().to_numpy().reshape(b - a, width)
                if kinds[a] == 0:
                    parts.append((ids[a:b], rows))
                    continue
                if tree is None and parts:
                    tree, parts = build(*(np.concatenate(x) for x in zip(*parts))), []
                for at in range(0, b - a if tree is not None else 0, QUERY_BLOCK):
                    own = slice(at, at + QUERY_BLOCK)
                    scores, found = search(tree, ids[a:b][own], rows[own], floors[a:b][own], k)
                    keep = scores != _NONE
                    asked = np.broadcast_to(ids[a:b][own][:, None], scores.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (asked, found, scores)], ["query_id", "vec_id", "score"])

    return run


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of each component, x as double; null for a vector that is null or holds null or not finite ones."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(embedding, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the ``k`` best other rows of ``vectors`` (vec_id, vec).

    Rows with a null id or vector take no part. Vectors are compared with those of the same length. A query's own rows
    (same id) are no candidates for it; repeated rows of others each count, ties go to the smaller id; an id that is
    asked twice is one query, with the least of its vectors. Scores are exact while they fit a long. Fewer than ``k``
    candidates give fewer rows; an empty table gives none.
    """
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    rows = materialise(usable.select(F.col("vec_id").cast("long").alias("id"), "vec", is_query.alias("q")), "vectors")
    n, components = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(8 * components / SHARD_BYTES), min(cores, math.ceil(n / 4096)))
    base = F.size("vec").cast("long") * shards
    none = F.lit(None).cast("long")
    shard = (base + F.pmod(F.xxhash64("id"), F.lit(shards))).alias("shard")
    candidates = rows.select(shard, F.lit(0).cast("long").alias("kind"), "id", "vec", none.alias("floor"))
    first = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards))
    queries = rows.where("q").groupBy("id").agg(F.min("vec").alias("vec"))
    one = F.lit(1).cast("long").alias("kind")

    def searched(asked: DataFrame) -> DataFrame:
        dealt = candidates.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind", "id")
        return dealt.mapInArrow(_searching(k), RESULT)

    begun = materialise(searched(queries.select((base + first).alias("shard"), one, "id", "vec", none.alias("floor"))), "first-shard")
    bars = begun.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    if shards > 1:
        others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda x: x != first))
        again = queries.join(bars, F.col("id") == F.col("query_id"), "left").select("id", "vec", "floor", others.alias("other"))
        begun = begun.unionByName(searched(again.select((base + F.col("other")).alias("shard"), one, "id", "vec", "floor")))
    # at most k rows of each shard for a query
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return begun.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``top_k`` over quantised ``embeddings``; the queries are the rows whose vec_id is divisible by ``every``."""
    return top_k(embeddings.select("vec_id", quantised(F.col("embedding")).alias("vec")), F.col("vec_id") % every == 0, k)
