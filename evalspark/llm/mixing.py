"""Mixing sources to target weights by iterative proportional fitting.

Token counts of (source, language, topic) cells are raked to the three target marginals under the bound that a cell
can't give more tokens than it has; documents are then sampled, each with its cell's calibrated probability.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.batches import small_batches
from evalspark.llm.bytesets import word_counts
from evalspark.plans.scratch import materialise

#: Level for whatever isn't named by the targets.
OTHER = "*"


@dataclass(frozen=True)
class MixTargets:
    """Named shares of tokens; unnamed levels together keep the share they have.

    The number of cells is bounded by the names given here: (sources + 1) * (languages + 1) * (topics + 1).
    """

    sources: dict[str, float] = field(default_factory=lambda: {f"src{i}": 1.0 for i in range(20)})
    langs: dict[str, float] = field(default_factory=lambda: {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14})
    topics: dict[str, float] = field(default_factory=lambda: {"licence": 0.02, "table": 0.03, "marked": 0.03, "contact": 0.02, "prose": 0.9})
    #: Topic -> strings, one of which the text must hold; the first topic that fits is taken, else ``prose``.
    topic_words: tuple[tuple[str, tuple[str, ...]], ...] = (("licence", ("License",)), ("table", (" | ",)), ("marked", ("***", "###")), ("contact", ("@",)))
    #: Share of all tokens that the sample is meant to hold.
    fraction: float = 0.5
    seed: int = 11


def _count(texts: pa.Array) -> pa.Array:
    return pa.array(word_counts(texts))


def token_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the whole text; 0 for a null one."""
    return F.arrow_udf(_count, "bigint")(text)


def level(value: Column, named: dict[str, float]) -> Column:
    return F.when(value.isin(*named), value).otherwise(F.lit(OTHER))


def topic_of(text: Column, targets: MixTargets) -> Column:
    topic = F.lit("prose")
    for name, words in reversed(targets.topic_words):
        holds = F.lit(False)
        for w in words:
            holds = holds | text.contains(w)
        topic = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(topic)
    return topic


def cell_columns(targets: MixTargets) -> dict[str, Column]:
    return {
        "c_source": level(F.col("source"), targets.sources),
        "c_lang": level(F.col("lang"), targets.langs),
        "c_topic": level(topic_of(F.col("text"), targets), targets.topics),
        "n_tokens": token_count(F.col("text")),
    }


def _shares(names: list[str], have: np.ndarray, targets: dict[str, float]) -> np.ndarray:
    """Target share of each level: unnamed and empty levels keep theirs, the named ones share the rest."""
    out = np.where([n in targets for n in names], [targets.get(n, 0.0) for n in names], 0.0) * (have > 0)
    rest = sum(h for n, h in zip(names, have) if n not in targets) / have.sum()
    named = out.sum()
    return np.where([n in targets for n in names], out / named * (1 - rest) if named else 0.0, have / have.sum())


def rake(tokens: np.ndarray, margins: list[np.ndarray], fraction: float, sweeps: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Weights with the given margins (shares of ``fraction`` of all tokens), at most ``tokens`` in each cell.

    Plain proportional fitting, but cells that have reached their bound stay there and the others make up for them.
    Where the bounds make the margins impossible, the last sweep's weights are returned; ``margin_gap`` tells.
    """
    total = tokens.sum() * fraction
    w = tokens * fraction
    for _ in range(sweeps):
        last = w
        for axis, share in enumerate(margins):
            other = tuple(i for i in range(tokens.ndim) if i != axis)
            full = w >= tokens * (1 - 1e-12)
            held, free = np.where(full, w, 0).sum(axis=other), np.where(full, 0, w).sum(axis=other)
            goal = share * total
            grow = (goal - held) / np.where(free > 0, free, 1)
            shrink = goal / np.where(held + free > 0, held + free, 1)
            too_much = np.expand_dims(shrink < 1, other)
            w = np.where(too_much, w * np.expand_dims(shrink, other), np.where(full, w, w * np.expand_dims(grow, other)))
            w = np.minimum(w, tokens)
        if np.abs(w - last).max() <= tolerance * max(total, 1):
            break
    return w


def margin_gap(w: np.ndarray, margins: list[np.ndarray], fraction: float, tokens: np.ndarray) -> float:
    """The largest distance of a level's weight from its target, as a share of all weight that was asked for."""
    total = max(float(tokens.sum() * fraction), 1e-300)
    axes = [tuple(i for i in range(w.ndim) if i != axis) for axis in range(w.ndim)]
    return max(float(np.abs(w.sum(axis=other) - share * total).max() / total) for other, share in zip(axes, margins))


def calibrate(cells: DataFrame, targets: MixTargets) -> DataFrame:
    """Each cell with its sampling probability; ``cells`` has c_source, c_lang, c_topic and n_tokens by document.

    The cell table is summed by Spark. Its size is bounded by the names in ``targets``, so it is raked on the driver
    and comes back as a table that may be broadcast.
    """
    spark = cells.sparkSession
    rows = cells.groupBy("c_source", "c_lang", "c_topic").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()
    schema = "c_source string, c_lang string, c_topic string, tokens long, docs long, target_tokens double, probability double, margin_gap double"
    if not rows:
        return spark.createDataFrame([], schema)
    names = [sorted({r[i] for r in rows}) for i in range(3)]
    tokens = np.zeros([len(n) for n in names])
    at = [tuple(n.index(r[i]) for i, n in enumerate(names)) for r in rows]
    for place, r in zip(at, rows):
        tokens[place] = r.tokens
    if tokens.sum() == 0:
        return spark.createDataFrame([(*r, 0.0, targets.fraction, 0.0) for r in rows], schema)
    wanted = (targets.sources, targets.langs, targets.topics)
    margins = [_shares(names[i], tokens.sum(axis=tuple(j for j in range(3) if j != i)), wanted[i]) for i in range(3)]
    w = rake(tokens, margins, targets.fraction)
    gap = margin_gap(w, margins, targets.fraction, tokens)
    out = [(*r, float(w[p]), float(w[p] / tokens[p]) if tokens[p] else targets.fraction, gap) for p, r in zip(at, rows)]
    return spark.createDataFrame(out, schema)


def uniform(doc_id: Column, text_hash: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the id (by the text's hash if the id is null) and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id.cast("long"), text_hash), F.lit(seed)), 11) * F.lit(2.0**-53)


CELL = ["c_source", "c_lang", "c_topic"]


def mix_weights(docs: DataFrame, targets: MixTargets = MixTargets()) -> DataFrame:
    """One row per document: doc_id, its cell, n_tokens, probability, weight (1 / probability), kept and margin_gap.

    ``margin_gap`` is the same in all rows: how far the raked weights miss a target at most (``margin_gap``), which is
    more than rounding only where the cells don't hold enough tokens for the targets.

    Null sources and languages and unnamed ones fall in the level ``*``; null and empty texts have no tokens and are
    kept with probability ``fraction`` if their cell has no tokens either; repeated rows share one decision; an empty
    table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    cells = materialise(docs.select("doc_id", F.xxhash64("text").alias("h"), *[c.alias(n) for n, c in cell_columns(targets).items()]), "cells")
    p = calibrate(cells, targets).select(*CELL, "probability", "margin_gap")
    out = cells.join(F.broadcast(p), CELL)
    return out.select(
        "doc_id", F.col("c_source").alias("source_level"), F.col("c_lang").alias("lang_level"), F.col("c_topic").alias("topic"), "n_tokens", "probability",
        F.when(F.col("probability") > 0, 1 / F.col("probability")).alias("weight"), (uniform(F.col("doc_id"), F.col("h"), targets.seed) < F.col("probability")).alias("kept"), "margin_gap",
    )


def sample_mix(docs: DataFrame, targets: MixTargets = MixTargets()) -> DataFrame:
    """The sampled documents, with their own columns, whatever those are called.

    Null and empty texts have no tokens and are kept with their cell's probability (``fraction`` where the cell has no
    tokens); rows with a null doc_id are sampled by their text; repeated rows stay or go together; an empty table gives
    an empty result.
    """
    small_batches(docs.sparkSession)
    cols = cell_columns(targets)
    p = calibrate(docs.select(*[cols[n].alias(n) for n in (*CELL, "n_tokens")]), targets).select(*CELL, "probability")
    # the row travels as one struct, so that no column of docs can clash with the cells'
    rows = docs.select(F.struct("*").alias("doc"), *[cols[c].alias(c) for c in CELL]).join(F.broadcast(p), CELL)
    taken = uniform(F.col("doc.doc_id"), F.xxhash64("doc.text"), targets.seed) < F.col("probability")
    return rows.where(taken).select("doc.*")
