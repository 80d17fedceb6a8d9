"""Quality rules by distribution divergence.

Each document's histograms of character classes and of its language's common words are held against the language's
references by Jensen-Shannon distance. References are sums over all documents of the language that pass the base
rules, taken again over those that lie near the first sums, so that junk doesn't shape them, and mixed with what all
languages share. They are a few rows (one for each listed language and one for all others), whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.batches import small_batches
from evalspark.llm.docstats import CLASSES, COMMON_WORDS, N_COMMON, document_stats
from evalspark.plans.scratch import materialise

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Largest Jensen-Shannon distances (base 2, 0 to 1) that a clean document may have.
MAX_CLASS_DISTANCE = 0.34
MAX_WORD_DISTANCE = 0.30
#: A histogram is judged only from so many characters or words on.
MIN_CLASS_CHARS = 200
MIN_HIST_WORDS = 100
#: How many documents of its own weigh as much in a language's reference as what all languages share.
SHARED_DOCS = 20


def profile_key(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit("*"))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; null if either is empty or sums to 0."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def term(x: Column, y: Column) -> Column:
        p, q = x.cast("double") / total(counts), y.cast("double") / total(reference)
        m = (p + q) / 2
        return F.struct(p.alias("p"), q.alias("q"), m.alias("m"))

    terms = F.zip_with(counts, reference, term)
    divergence = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + (part(t["p"], t["m"]) + part(t["q"], t["m"])) / 2)
    return F.when((total(counts) > 0) & (total(reference) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def references(stats: DataFrame, lang: str, s: str) -> DataFrame:
    """One row for each profile: shares of histograms over its documents that pass the base rules.

    The shares of n own documents count n / (n + SHARED_DOCS), those of all profiles together the rest, so that a thin
    language is judged as well, and by much the same reference as before when it grows. Bins of common words go by
    rank, so they can be shared between languages; the profile ``*`` has no such words.
    """
    classes, words = range(len(CLASSES)), range(N_COMMON + 1)
    sums = [F.sum(F.col(s)["class_hist"][i]).alias(f"c{i}") for i in classes]
    sums += [F.sum(F.col(s)["word_hist"][i]).alias(f"w{i}") for i in words]
    own = stats.where(~base_failed(F.col(s))).groupBy(profile_key(F.col(lang)).alias("__profile"))
    own = materialise(own.agg(F.count(F.lit(1)).alias("__docs"), *sums), "profile-sums")
    listed = F.col("__profile") != "*"
    # a row for each profile, so a handful stand in this window
    together = Window.partitionBy(F.lit(0))
    every_c = F.array(*[F.sum(f"c{i}").over(together) for i in classes])
    every_w = F.array(*[F.sum(F.when(listed, F.col(f"w{i}")).otherwise(0)).over(together) for i in words])
    weight = F.col("__docs") / (F.col("__docs") + SHARED_DOCS)

    def mixed(mine: Column, all_: Column) -> Column:
        return F.zip_with(_shares(mine), _shares(all_), lambda x, y: weight * x + (1 - weight) * y)

    own = own.withColumns({"__c": every_c, "__w": every_w})
    return own.select(
        "__profile", mixed(F.array(*[f"c{i}" for i in classes]), F.col("__c")).alias("__class_ref"),
        mixed(F.array(*[f"w{i}" for i in words]), F.col("__w")).alias("__word_ref"),
    )


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def refined_references(stats: DataFrame, lang: str, s: str) -> DataFrame:
    """References over the documents that the first references keep; a few rows, written once."""
    first = materialise(references(stats, lang, s), "first-references")
    near = judged(stats, first, lang, s, "__near").where(F.col("__near")["kept"]).drop("__near")
    return materialise(references(near, lang, s), "references")


def judged(stats: DataFrame, refs: DataFrame, lang: str, s: str, out: str) -> DataFrame:
    """Adds ``out``: a struct of base_failed, class_distance, word_distance and kept.

    The references are broadcast: at most one row for each listed language and one more.
    """
    c = F.col(s)
    joined = stats.withColumn("__key", profile_key(F.col(lang))).join(F.broadcast(refs), F.col("__key") == F.col("__profile"), "left")
    known = F.col("__profile").isNotNull()
    chars = F.aggregate(c["class_hist"], F.lit(0).cast("long"), lambda a, x: a + x)
    by_class = F.when(known & (chars >= MIN_CLASS_CHARS), js_distance(c["class_hist"], F.col("__class_ref")))
    by_word = F.when(known & (F.col("__profile") != "*") & (c["n_words"] >= MIN_HIST_WORDS), js_distance(c["word_hist"], F.col("__word_ref")))
    near = [F.coalesce(F.col(d), F.lit(0.0)) <= m for d, m in (("__class_d", MAX_CLASS_DISTANCE), ("__word_d", MAX_WORD_DISTANCE))]
    verdict = F.struct(
        base_failed(c).alias("base_failed"), F.col("__class_d").alias("class_distance"), F.col("__word_d").alias("word_distance"),
        (~base_failed(c) & near[0] & near[1]).alias("kept"),
    )
    return (
        joined.withColumn("__class_d", by_class).withColumn("__word_d", by_word).withColumn(out, verdict)
        .drop("__key", "__profile", "__class_ref", "__word_ref", "__class_d", "__word_d")
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, both distances, base_failed and kept.

    Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words, so they fail the base rules; repeated rows
    and ties are judged alike, each row by itself; an empty table gives an empty result. A language that isn't listed
    (or null) shares the profile ``*``, which has class histograms only. Other columns of ``docs`` are ignored. The
    counts are written once without the texts, and both passes read them.
    """
    small_batches(docs.sparkSession)
    stats = materialise(docs.select("doc_id", "lang", document_stats(F.col("text"), F.col("lang")).alias("s")), "docstats")
    out = judged(stats, refined_references(stats, "lang", "s"), "lang", "s", "v")
    return out.select(
        "doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", "v.base_failed", "v.kept",
        F.round("v.class_distance", 9).alias("class_distance"), F.round("v.word_distance", 9).alias("word_distance"),
    )


def keep_clean(docs: DataFrame) -> DataFrame:
    """The documents that ``quality_rules`` keeps, with their own columns, whatever those are called.

    Null and empty texts go, as they fail the base rules; repeated rows are each judged alike, those with a null doc_id
    too; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    counts = document_stats(F.col("text"), F.col("lang")).alias("s")
    stats = materialise(docs.select("lang", counts), "docstats")
    # the row travels as one struct, so that no column of docs can clash with the rules'
    rows = docs.select(F.struct("*").alias("doc"), "lang", counts)
    return judged(rows, refined_references(stats, "lang", "s"), "lang", "s", "v").where("v.kept").select("doc.*")
