"""How far the sources of a language diverge in their terms.

Partitions fold whole documents into stripes, a hash table from term to document frequency and counts by source. A table
that has grown too large is spilled as rows, and stripes are merged by language and term. What stands in the merged
stripes gives the divergences: every term a source uses more than its language, and every ordered pair of sources.

All arithmetic is on whole numbers and exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.batches import small_batches
from evalspark.operators.joins import small
from evalspark.plans.scratch import materialise

#: Fixed: what a term is made of, on UTF-8 bytes: ASCII letters and all bytes of other characters.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Fixed: capitals that are lowered.
_LOWERED = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
MIN_DOCS = 3
TOP_TERMS = 200
#: Shares are whole numbers of this unit.
UNIT = 1_000_000_000
#: Counts that a task's stripes hold before they are spilled.
SPILL_CELLS = 600_000
#: Terms in a row of spilled stripes that goes to Spark at once.
_ROWS = 10_000
#: Pairs of counts that are compared at once.
_PAIRS = 1 << 20
STRIPE = "lang string, term string, docs long, cells array<struct<source:string,n:long>>"
_STRIPE = pa.schema([
    ("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()),
    ("cells", pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))),
])


class Stripes:
    """Terms of each language with the number of their documents and their counts by source.

    A stripe is kept column-wise, as its places in a counter of documents and in one counter for each source, so that
    counting stays in C and a term costs no object of its own; ``spill`` puts stripes together.
    """

    def __init__(self) -> None:
        self.docs: dict[str, Counter[bytes]] = {}
        self.counts: dict[str, dict[str, Counter[bytes]]] = {}
        self.cells = 0

    def fold(self, text: bytes, lang: str, source: str) -> None:
        words = TERM.findall(text.translate(_LOWERED))
        own = self.counts.setdefault(lang, {}).setdefault(source, Counter())
        before = len(own)
        own.update(words)
        self.cells += len(own) - before
        self.docs.setdefault(lang, Counter()).update(set(words))

    def spill(self) -> Iterator[pa.RecordBatch]:
        """All stripes as rows; the table is empty then."""
        docs, counts = self.docs, self.counts
        self.docs, self.counts, self.cells = {}, {}, 0
        for lang, seen in docs.items():
            row = {term: i for i, term in enumerate(seen)}
            by_source = list(counts.pop(lang).items())
            at = np.concatenate([np.fromiter(map(row.__getitem__, c), np.int64, len(c)) for _, c in by_source])
            n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for _, c in by_source])
            source = np.repeat(np.arange(len(by_source)), [len(c) for _, c in by_source])
            order = np.argsort(at, kind="stable")
            names = pa.array([s for s, _ in by_source], pa.string()).take(pa.array(source[order]))
            cells = pa.StructArray.from_arrays([names, pa.array(n[order])], fields=list(_STRIPE.field("cells").type.value_type))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(row)))])
            terms, k = pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(np.fromiter(seen.values(), np.int64, len(seen)))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells)
            whole = pa.RecordBatch.from_arrays([pa.array([lang] * len(row), pa.string()), terms, k, lists], schema=_STRIPE)
            for a in range(0, len(row), _ROWS):
                yield whole.slice(a, _ROWS)


def _folding(spill_cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = Stripes()
        for batch in batches:
            for text, lang, source in zip(*(batch.column(k) for k in range(3))):
                stripes.fold(text.as_buffer().to_pybytes(), lang.as_py(), source.as_py())
                if stripes.cells >= spill_cells:
                    yield from stripes.spill()
        yield from stripes.spill()

    return fold


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def term_stripes(docs: DataFrame, spill_cells: int = SPILL_CELLS) -> DataFrame:
    """lang, term, docs and cells (source, n) of every term of every whole text; null text, lang and source are empty."""
    small_batches(docs.sparkSession)
    folded = docs.select(_blank("text"), _blank("lang"), _blank("source")).mapInArrow(_folding(spill_cells), STRIPE)
    # both groupings stand on one exchange: rows are as many as tasks and spills have terms
    dealt = folded.repartition("lang", "term")
    none = F.array(F.struct(F.lit(None).cast("string").alias("source"), F.col("docs").alias("n")))
    cells = dealt.select("lang", "term", F.explode(F.concat("cells", none)).alias("cell"))
    sums = cells.groupBy("lang", "term", F.col("cell.source").alias("source")).agg(F.sum("cell.n").alias("n"))
    cell = F.when(F.col("source").isNotNull(), F.struct("source", "n"))
    merged = sums.groupBy("lang", "term").agg(F.max(F.when(F.col("source").isNull(), F.col("n"))).alias("docs"), F.collect_list(cell).alias("cells"))
    return merged.select("lang", "term", "docs", "cells")


def share(count: Column, whole: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / whole), exact for any whole numbers."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.call_function("div", top, whole.cast("decimal(19,0)")).cast("long") + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most UNIT + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _pairing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For merged stripes with the shares of their sources: by language and ordered pair of sources that share a term,
    what the shared terms add beyond what each source adds where the other lacks the term."""
    sums: Counter[tuple[str, str, str]] = Counter()
    for batch in batches:
        langs, cells = batch.column(0).dictionary_encode(), batch.column(1)
        sizes = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        names, p, p0 = (cells.flatten().field(k) for k in range(3))
        names, p, p0 = names.dictionary_encode(), p.to_numpy(), p0.to_numpy()
        lang, source, n_names = langs.indices.to_numpy().astype(np.int64), names.indices.to_numpy().astype(np.int64), len(names.dictionary)
        firsts, ends, at = np.cumsum(sizes) - sizes, np.cumsum(sizes**2), 0
        known = langs.dictionary.to_pylist(), names.dictionary.to_pylist()
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
            m = sizes[at:to]
            stripe = np.repeat(np.arange(at, to), m**2)
            place = np.arange(len(stripe)) - np.repeat(np.cumsum(m**2) - m**2, m**2)
            a, b = firsts[stripe] + place // sizes[stripe], firsts[stripe] + place % sizes[stripe]
            value = _gap(p[a], p[b]) - _gap(p[a], p0[b]) - _gap(p0[a], p[b]) + _gap(p0[a], p0[b])
            pair = (lang[stripe] * n_names + source[a]) * n_names + source[b]
            order = np.argsort(pair, kind="stable")
            starts = np.flatnonzero(np.diff(pair[order], prepend=-1))
            totals = np.add.reduceat(value[order], starts) if len(starts) else value[:0]
            for key, total in zip(pair[order][starts].tolist(), totals.tolist()):
                rest, other = divmod(key, n_names)
                if rest % n_names != other:
                    sums[known[0][rest // n_names], known[1][rest % n_names], known[1][other]] += total
            at = to
        if len(sums) >= SPILL_CELLS:
            yield _sums(sums)
            sums = Counter()
    yield _sums(sums)


_PAIR = "lang string, source string, item string, value long"


def _sums(sums: Counter[tuple[str, str, str]]) -> pa.RecordBatch:
    cols = list(zip(*sums)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(sums.values(), pa.int64())], ["lang", "source", "item", "value"])


def _pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every ordered pair of a language's groups.

    Terms that both sources have are compared stripe by stripe. Where only one has the term, the other's share is the
    same for all such terms, so each source's histogram of counts is enough; what is left are terms that neither has.
    """
    terms = cells.groupBy("lang", "source", "n", "p").agg(F.count(F.lit(1)).alias("k"))
    held = terms.groupBy("lang", "source").agg(F.sum("k").alias("held"))
    own = groups.join(held, ["lang", "source"], "left").select("lang", "source", "p0", "v", F.coalesce("held", F.lit(0)).alias("held"))
    other = small(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")))
    met = terms.join(other, "lang").where("source <> item")
    there = met.select("lang", "source", "item", (F.col("k") * gap(F.col("p"), F.col("q0"))).alias("value"))
    back = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("k") * gap(F.col("q0"), F.col("p"))).alias("value"))
    sides = small(own.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("held").alias("other_held")))
    both = own.join(sides, "lang").where("source <> item")
    rest = F.when(F.col("v") > 0, (F.col("v") - F.col("held") - F.col("other_held")) * gap(F.col("p0"), F.col("q0"))).otherwise(0)
    base = both.select("lang", "source", "item", rest.cast("long").alias("value"))
    stripes = cells.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("cells"))
    shared = stripes.where(F.size("cells") > 1).select("lang", "cells").mapInArrow(_pairing, _PAIR)
    every = there.unionByName(back).unionByName(base).unionByName(shared)
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: divergences of each group of a language and a source.

    A language keeps the terms in at least ``min_docs`` of its documents; V is their number. A group gives each kept term
    the share p = 1 + floor(UNIT * (count + 1) / (N + V)), N being its count of kept terms, and so does the language as a
    whole. Part ``pair`` has each other source of the language with the sum over all kept terms of floor((p - q)^2 / q),
    q being the other's share (0 if V is 0); part ``term`` has the ``top_terms`` kept terms that the group uses, with a
    share above the language's, by floor((p - q)^2 / q). Ranks run from 1 by falling value, then by the item.

    Null text, lang and source are empty strings; groups without any term are listed. Repeated rows are documents of
    their own. An empty table gives no rows; other columns and doc_id are not looked at.
    """
    own = docs.select("text", "lang", "source")
    total = F.aggregate("cells", F.lit(0).cast("long"), lambda x, c: x + c["n"])
    kept = materialise(term_stripes(own).where(F.col("docs") >= min_docs).select("lang", "term", total.alias("total"), "cells"), "stripes")
    flat = kept.select("lang", "term", "total", F.explode("cells").alias("c")).select("lang", "term", "total", "c.*")
    used = flat.groupBy("lang", "source").agg(F.sum("n").alias("used"))
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_used"))
    groups = own.select(_blank("lang").alias("lang"), _blank("source").alias("source")).distinct()
    groups = groups.join(used, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["used", "v", "lang_used"])
    first = F.when(F.col("v") > 0, share(F.lit(0), F.col("used") + F.col("v")))
    groups = materialise(groups.withColumn("p0", first), "groups")
    cells = flat.join(small(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("used") + F.col("v")))
    q = share(F.col("total"), F.col("lang_used") + F.col("v"))
    terms = cells.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    pairs = _pair_values(cells, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    ranked = terms.select("*", rank).where(F.col("rank") <= top_terms)
    return pairs.select("*", rank).unionByName(ranked)
